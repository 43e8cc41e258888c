import random
import re

import numpy as np
import pytest

from corpusloom.llm import decontaminate as D
from corpusloom.llm.common import read, sha256

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, items, window):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found, longest = WORD.findall((t or "").translate(LOW)), set(), set(), []
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= s
                    for i, u in items:
                        v = WORD.findall((u or "").translate(LOW))
                        for j in range(len(v) - n + 1) if n == min(window, len(v)) else ():
                            if v[j : j + n] == w[k : k + n]:
                                m = n
                                while k + m < len(w) and j + m < len(v) and w[k + m] == v[j + m]:
                                    m += 1
                                longest.append((-m, k))
        out.append((len(w), len(hit), sorted(found), [min(longest)[1], -min(longest)[0]] if longest else []))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_shards_against_brute_force(seed):
    random.seed(seed)
    letters, window = "abcdef"[: random.randint(1, 6)], random.randint(1, 6)
    texts = [" ".join(random.choices(letters, k=random.randint(0, 50))) for _ in range(6)]
    items = [(str(k), " ".join(random.choices(letters, k=random.randint(0, 12)))) for k in range(random.randint(0, 5))]
    tests = D.build_tests([(i, t.encode()) for i, t in items], window)
    m = D.matches([t.encode() for t in texts], tests)
    got = []
    for d in range(len(texts)):
        longest = [[int(f), int(n)] for e, f, n in zip(*m.longest, strict=True) if e == d]
        got.append((int(m.n_words[d]), int(m.ranges[2][m.ranges[0] == d].sum()), sorted({tests.item_ids[i] for i in m.items[1][m.items[0] == d]}), longest[0] if longest else []))
    assert got == brute(texts, items, window)


def test_suffix_array():
    rng = np.random.default_rng(2)
    s = np.concatenate([rng.integers(1, 3, 200), np.zeros(210, int)]).astype(np.int32)
    sa = D.suffix_array(s, np.arange(200), 200)
    rest = [tuple(s[p : p + 200]) for p in sa]
    assert rest == sorted(rest)


def test_query(spark, data):
    docs = [(r.doc_id, r.text) for r in read(spark, data, "documents").collect()]
    items = [(str(r.item_id), r.text) for r in read(spark, data, "benchmark").collect()]
    want = {d: (n, h, len(i), sha256(",".join(i).encode()), h > 0, x[1] if x else 0, x[0] if x else None) for (d, _), (n, h, i, x) in zip(docs, brute([t for _, t in docs], items, 10), strict=True)}
    got = {r.doc_id: tuple(r)[1:] for r in D.op2_decontaminate(spark, data).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_blocks_of_items_change_nothing(spark, data):
    docs, items = read(spark, data, "documents").select("doc_id", "text"), read(spark, data, "benchmark")
    one = D.search(docs, items).collect()
    many = D.search(docs, items, block_bytes=2000).collect()
    assert sorted(one, key=str) == sorted(many, key=str) and any(r._longest for r in one)


def test_awkward_rows(spark, awkward, tmp_path):
    items = spark.createDataFrame([(None, "six"), (1, None), (2, ""), (3, "ONE two"), (3, "ONE two"), (4, "CC by all")], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = awkward.drop(*D.FOUND.names)
    got = {(r.source, r._words, tuple(r._items)) for r in D.search(plain, items).collect()}
    assert ("s3", 6, ("", "3")) in got
    kept = D.keep(spark, awkward, str(tmp_path))
    assert kept.columns == awkward.columns
    assert {r.source for r in awkward.collect()} - {r.source for r in kept.collect()} == {"s3", "s4", "s5", "s6", "s12"}
    assert D.search(plain, items.limit(0)).filter("size(_spans) > 0").count() == 0
    assert D.search(plain.limit(0), items).count() == 0


def test_more_words_than_two_million():
    """Numbers beyond 21 bits order and match as smaller ones do."""
    big = " ".join(f"b{i:x}" for i in range(2_200_000))
    small = [" ".join(f"s{k}x{j}" for j in range(10)) for k in range(300)]
    tests = D.build_tests([("big", big.encode()), *((str(k), t.encode()) for k, t in enumerate(small))])
    m = D.matches([*(f"intro {t} end".encode() for t in small), b"b20ffff b210000 b210001"], tests)
    assert sorted(zip(*(x.tolist() for x in m.items), strict=True)) == [(k, k + 1) for k in range(300)]
    assert m.ranges[1].tolist() == [1] * 300 and m.longest[2].tolist() == [10] * 300


def test_one_word_many_times():
    """Places are not paired: 20,000 places against 10,000 take little memory."""
    import tracemalloc

    tests = D.build_tests([("a", b"w " * 10_000), ("b", b"w " * 30), ("c", b"w w w")])
    tracemalloc.start()
    m = D.matches([b"w " * 20_000, b"w w", b"x " + b"w " * 12], tests)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    assert list(zip(*(x.tolist() for x in m.ranges), strict=True)) == [(0, 0, 20_000), (2, 1, 12)]
    assert list(zip(*(x.tolist() for x in m.longest), strict=True)) == [(0, 0, 10_000), (2, 1, 12)]
    assert list(zip(*(x.tolist() for x in m.items), strict=True)) == [(0, 0), (0, 1), (0, 2), (2, 0), (2, 1), (2, 2)]


def test_merged():
    assert D.merged([5, 2, 0, 3, 7, 1, 2, 2]) == [0, 4, 5, 3]
