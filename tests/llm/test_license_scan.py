import math
import re

import pytest

from corpusloom.llm import license_scan as L
from corpusloom.llm.common import read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contained(words, templates, threshold, telling):
    """{label: largest containment} over runs of words half as long again as the template."""
    out = {}
    for label, t in templates.items():
        t = WORD.findall(t.translate(LOW))
        width, t = math.ceil(L.WINDOW * len(t)), set(t)
        for i in range(max(1, len(words) - width + 1)) if t else ():
            block = set(words[i : i + width])
            if (share := len(block & t) / len(t)) >= threshold - 1e-9 and block >= set(telling.get(label, ())):
                out[label] = max(out.get(label, 0), share)
    return out


def brute(text, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    words, places, base = WORD.findall((text or "").translate(LOW)), [], set()
    for p, label in L.PHRASES.items():
        at = [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places += at
        base |= {label} if at else set()
    more = contained(words, templates, threshold, L.TELLING)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(more))), 1.0 if base else max(more.values(), default=0.0))


def test_query(spark, data):
    got = {r.doc_id: tuple(r)[1:] for r in L.op4_license_scan(spark, data).collect()}
    assert got == {r.doc_id: brute(r.text) for r in read(spark, data, "documents").collect()}
    assert any(v[1] for v in got.values())


def test_phrases_and_templates(spark, awkward):
    texts = ["CC BY cc by, cc-by. All Rights\nreserved all rights reserved", "cc byx xcc by", "gnu general public license version 3 this work is under the", "released under mit license", "the the mit license released under", "all rights reserved " * 50, None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in awkward.collect()]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: str(r)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)
    assert L.scan(awkward.limit(0)).count() == 0 and L.scan(awkward).count() == awkward.count()


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_thresholds(spark, threshold):
    """All candidates that the filters leave, against all runs of words."""
    import random

    random.seed(int(10 * threshold))
    templates = {f"t{k}": " ".join(random.choices("abcdefghijkl", k=random.randint(1, 9))) for k in range(12)}
    telling = {f"t{k}": (random.choice(templates[f"t{k}"].split()),) for k in range(4)}
    rows = [(i, "\n".join(" ".join(random.choices("abcdefghijklmn", k=random.randint(0, 12))) for _ in range(4))) for i in range(60)]
    sets = L.template_words(templates)
    places = L.marked(spark.createDataFrame(rows, "doc_id long, text string"), sorted({w for s in sets.values() for w in s}))
    got = {(r.doc_id, r.label): round(r.score, 9) for r in L.similar_blocks(places, sets, threshold, telling).collect()}
    assert got == {(i, k): round(v, 9) for i, text in rows for k, v in contained(WORD.findall(text), templates, threshold, telling).items()}


def test_each_template_has_its_own_label(spark):
    """No template meets another, except where one phrase stands in it."""
    lines = [*L.TEMPLATES.values(), "Licensed under CC BY 4.0"]
    got = [r.labels for r in sorted(L.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect(), key=lambda r: r.doc_id)]
    own = [",".join(sorted({k, *(label for p, label in L.PHRASES.items() if f" {p} " in f" {' '.join(WORD.findall(v.translate(LOW)))} ")})) for k, v in L.TEMPLATES.items()]
    assert got == [*own, "cc-by"]


def test_long_lines(spark):
    """Words of a template scattered over a long line are no statement."""
    scattered = " x x x x x ".join("Released under the MIT License".split())
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame([(0, scattered * 300), (1, "x " * 50_000 + "Released under the MIT License" + " y" * 50_000), (2, "released mit " * 20_000)], "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(3)] == ["", "mit", ""] and got[1].n_words == 100_005


def test_no_python_in_the_plan(spark, data):
    plan = L.op4_license_scan(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_wrapped_statements(spark):
    """Statements broken over lines are found, also inside long paragraphs."""
    wrapped = {
        "mit-grant": "x\n\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the Software), to deal",
        "bsd": "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:",
        "cc0": "z " * 500 + "\nTo the extent possible under law, the author has waived\nall copyright and related or neighboring\nrights to this work" + "\nz" * 500,
        "mpl-2.0": "This Source Code Form is subject to the terms of\nthe Mozilla Public License, v. 2.0",
        "": "Permission is hereby granted, free of charge, to any",
    }
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(wrapped.values())), "doc_id long, text string")).collect()}
    assert {i: r.labels for i, r in got.items()} == dict(enumerate(wrapped))
    assert [got[i].score for i in range(5)] == [1.0, 1.0, 1.0, 1.0, 0.0]


def test_clashing_columns(spark):
    rows = [(1, "All rights reserved", 5, "x", "y", 3)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string, hash int, places string, base string, score int")).collect()
    assert [tuple(r) for r in got] == [(1, *brute(rows[0][1]))]
