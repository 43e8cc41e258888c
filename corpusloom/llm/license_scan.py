"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z in lower case. The blocks of a text that may meet a template
are its runs of consecutive words half as long again as the template (WINDOW), wherever lines break, so wrapped statements are found and
words scattered over a long line are not. A block meets a template if it holds at least `threshold` of the template's distinct
words (overlap >= need, the least whole number of words that is so much), and all of its telling words, which set it
apart from its kin. Words are ordered from rare to frequent by the number of texts of the whole corpus that hold them (then by the
word). Three filters, none of which loses a block:

* prefix: a block with `need` words of the template holds one of its size - need + 1 rarest;
* length: a text with fewer distinct words of the template than `need` can't meet it;
* position: with its rarest common word at place i of the template, at most size - i words are left to share.

Texts are read and split once: what leaves that scan is, for each row, the places of words that any template has. Candidates come from
an equi-join of those words with the index of prefixes; only the places around such a word are then compared, exactly.
Templates are a parameter of bounded size (MOST_WORDS words, checked); their index is broadcast. Labels, not texts, are shuffled.

Beside the templates, three fixed phrases are counted at all their places. A phrase that stands is contained whole, so its
containment, and with it the score, is 1; otherwise the score is the largest containment of a template that is met, or 0. Null and empty
texts have no words. Very long texts and lines are scanned whole; a candidate looks at no more words than its template asks for.
Repeated rows get equal results each. Empty tables give no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import UPPER, column, read, written

#: Phrases (words joined by one space) and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short license statements by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "rights-reserved": "All rights reserved",
}
#: Words without which a template isn't met: they tell it from others of its kind.
TELLING = {"apache-2.0": ("apache",), "cc-by-nc": ("nc",), "cc-by-sa": ("sa",), "gpl-notice": ("gnu",), "mit": ("mit",), "mpl-2.0": ("mozilla",)}
THRESHOLD = 0.8
#: Words of a block, in lengths of the template.
WINDOW = 1.5
#: Distinct words of all templates together, at most.
MOST_WORDS = 20_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER.decode(), UPPER.decode().lower()))


def spaced(low: Column) -> Column:
    """The words with one space before, between and after."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, GAP, " ")), F.lit(" "))


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    """The words of each template that has any, in order, by the rule for texts."""
    import re

    out = {k: [x for x in re.split(GAP, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if x] for k, t in templates.items()}
    if sum(map(len, out.values())) > MOST_WORDS:
        raise ValueError(f"the templates have more than {MOST_WORDS} words; scan with parts of them")
    return {k: v for k, v in out.items() if v}


def _index(sets: dict[str, list[str]], rank: dict[str, int], threshold: float, telling: dict[str, tuple[str, ...]]) -> list[tuple]:
    """(word, label, place, distinct words, need, width, template, telling) of the prefixes of the templates."""
    import math

    index = []
    for label, all_ in sets.items():
        s = sorted(set(all_), key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(s) - 1e-9))
        index += [(w, label, i, len(s), need, math.ceil(WINDOW * len(all_)), s, list(telling.get(label, ()))) for i, w in enumerate(s[: len(s) - need + 1])]
    return index


def marked(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """A row for each document: words, places of the phrases, and (at, word) of the words of the templates; written, so that texts are read once."""
    text = column(docs, "text", "string")
    given = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.xxhash64(text).alias("hash"), spaced(lowered(text)).alias("s"))
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    # Split where a phrase starts (places may share the space between them): words before a place are the spaces before it less one.
    parts = {label: F.when(F.col("s").contains(f" {p} "), F.split("s", f"(?<= )(?={p} )")) for p, label in PHRASES.items()}
    at = F.transform(F.split(F.trim("s"), " "), lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("at"), w.alias("word"))))
    given = given.select("doc_id", "hash", F.filter(at, lambda x: x.isNotNull()).alias("places"), F.when(F.trim("s") == "", 0).otherwise(spaces(F.col("s")) - 1).alias("n_words"), *(x.alias(k) for k, x in parts.items()), spaces(F.col("s")).alias("spaces"))
    return written(given.select(
        "doc_id", "hash", "places", F.col("n_words").cast("long").alias("n_words"),
        sum((F.coalesce(F.size(F.col(f"`{k}`")) - 1, F.lit(0)) for k in parts), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(spaces(F.element_at(F.col(f"`{k}`"), 1)) - 1 for k in parts)).cast("long").alias("first_word"),
        F.greatest(*(F.col("spaces") - spaces(F.element_at(F.col(f"`{k}`"), -1)) - 1 for k in parts)).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"`{k}`").isNotNull(), F.lit(k)) for k in parts)))).alias("base"),
    ), "licenses")


def similar_blocks(rows: DataFrame, sets: dict[str, list[str]], threshold: float = THRESHOLD, telling: dict[str, tuple[str, ...]] = TELLING) -> DataFrame:
    """(doc_id, hash, label, score): for each text and template that one of its blocks meets, the largest containment."""
    spark, vocabulary = rows.sparkSession, sorted({w for s in sets.values() for w in s})
    if not vocabulary:
        return spark.createDataFrame([], "doc_id long, hash long, label string, score double")
    held = rows.filter(F.size("places") > 0).select("doc_id", "hash", "places", F.array_distinct("places.word").alias("held"))
    counts = {r["word"]: r["n"] for r in held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each word of the templates at most
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    index = _index(sets, rank, threshold, telling)
    prefixes = spark.createDataFrame(index, "word string, label string, place int, template_size int, need int, width int, template array<string>, telling array<string>")
    rare = F.array(*map(F.lit, sorted({row[0] for row in index})))
    found = held.select("doc_id", "hash", "places", "held", F.explode(F.array_intersect("held", rare)).alias("word")).join(F.broadcast(prefixes), "word")
    met = found.filter((F.col("template_size") - F.col("place") >= F.col("need")) & (F.size(F.array_intersect("held", "template")) >= F.col("need")) & (F.size(F.array_except("telling", "held")) == 0))
    own = F.filter("places", lambda p: F.array_contains("template", p["word"]))
    met = met.withColumn("own", own).select("doc_id", "hash", "label", "template_size", "need", "width", "telling", "word", "own")
    # around each place of the prefix's word, the template's words that a block with it can hold
    near = F.transform("own", lambda p, i: F.when(p["word"] == F.col("word"), F.filter(F.slice("own", F.greatest(i - F.col("width") + 2, F.lit(1)), 2 * F.col("width") - 1), lambda q: F.abs(q["at"] - p["at"]) < F.col("width"))))
    met = met.select("doc_id", "hash", "label", "template_size", "need", "width", "telling", F.explode(F.filter(near, lambda x: x.isNotNull())).alias("near")).filter(F.size("near") >= F.col("need"))
    # a block may as well begin with a word of the template
    block = lambda p: F.array_distinct(F.transform(F.filter("near", lambda q: (q["at"] >= p["at"]) & (q["at"] < p["at"] + F.col("width"))), lambda q: q["word"]))
    met = met.withColumn("overlap", F.array_max(F.transform("near", lambda p: F.transform(F.array(block(p)), lambda b: F.when(F.size(F.array_except("telling", b)) == 0, F.size(b)).otherwise(0))[0]))).filter("overlap >= need")
    return met.groupBy("doc_id", "hash", "label").agg(F.max(F.col("overlap") / F.col("template_size")).alias("score"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, telling: dict[str, tuple[str, ...]] = TELLING) -> DataFrame:
    """A row for each document: words, places of the phrases, labels of both kinds and the best containment."""
    sets = template_words(templates)
    rows = marked(docs, sorted({w for s in sets.values() for w in s}))
    best = similar_blocks(rows, sets, threshold, telling).groupBy("doc_id", "hash").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    best = best.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    joined = rows.drop("places").join(best, rows["doc_id"].eqNullSafe(best["_id"]) & (rows["hash"] == best["_hash"]), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license scan of all documents."""
    return scan(read(spark, sf_dir, "documents"))
