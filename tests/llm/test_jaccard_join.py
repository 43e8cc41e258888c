import random
import re

import numpy as np
import pytest

from corpusloom.llm import jaccard_join as J
from corpusloom.llm.common import read

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, p):
    sets, up = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= p * len(a | b):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(root(i), []).append((0, 0) if d is None else (1, d))
    low = {k: min(v) for k, v in low.items()}
    return sorted(((d, len(sets[i]), low[root(i)][1] if low[root(i)][0] else None) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, n=120):
    r = random.Random(seed)
    base = [[str(r.randint(0, 10**6)) for _ in range(m)] for m in (8, 20, 60, 150)]
    out = []
    for _ in range(n):
        b = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
            b[r.randrange(len(b))] = str(r.randint(0, 10**6))
        out.append(" ".join(b[: len(b) - r.choice([0, 0, 1, 2])]))
    out += [" ".join(r.choices("ab", k=r.randint(0, 25))) for _ in range(n // 2)]
    return list(enumerate(out))


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_components_against_brute_force(spark, width, percent, seed):
    rows = near_copies(seed)
    got = J.linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width, percent)


def test_split_buckets_change_nothing(spark, monkeypatch):
    rows = near_copies(4, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(J, "HOT", 6)
    monkeypatch.setattr(J, "PIVOTS", 1)
    monkeypatch.setattr(J, "CELL", 5)
    assert sorted(map(tuple, J.linked_components(docs, 3, 90).collect()), key=str) == brute(rows, 3, 90)


def test_query(spark, data):
    rows = [(r.doc_id, r.text) for r in read(spark, data, "documents").collect()]
    assert sorted(map(tuple, J.op9_jaccard_join(spark, data).collect()), key=str) == brute(rows, 3, 90)


def test_signatures_meet():
    """Any two linked sets share a signature of an instance where one is native, whatever the allotment."""
    rng = np.random.default_rng(7)
    for percent in (90, 80):
        for crowd in (10, 10**9):
            bands = J.Bands(percent)
            bands.allot({b: crowd for b in range(60)})
            assert crowd == 10 or any(bands.spare.values())
            for _ in range(150):
                n = int(rng.integers(1, 400))
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                most = bands.differences(2 * len(a))
                drop, add = int(rng.integers(0, most // 2 + 1)), int(rng.integers(0, most // 2 + 1))
                b = np.unique(np.r_[a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)])
                common = len(np.intersect1d(a, b))
                if not len(b) or len(common_ := np.setxor1d(a, b)) == 0 or 100 * common < percent * (len(a) + len(b) - common):
                    continue
                assert len(common_) <= bands.differences(len(a) + len(b))
                sa, na = bands.signatures(a)
                sb, nb = bands.signatures(b)
                both = np.intersect1d(sa, sb)
                assert set(both) & (set(sa[na]) | set(sb[nb]))


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)) for n in rng.integers(1, 3000, 2))
        x, y = J.folded([J.sketch_of(s) for s in (a, b)])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_words_in_pieces(monkeypatch):
    data = " ".join("".join(random.Random(i).choices("abcé", k=i % 9)) for i in range(900)).encode() + b"x" * 9000
    whole = J.word_hashes(data)
    monkeypatch.setattr(J, "PIECE", 50)
    assert all((p == q).all() for p, q in zip(whole, J.word_hashes(data), strict=True))
    assert len(whole[0]) == len(data.split()) and len(set(whole[1])) == len(set(data.split()))


def test_awkward_rows(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(map(tuple, J.linked_components(awkward).collect()), key=str) == brute(rows, 3, 90)
    assert J.linked_components(awkward.limit(0)).count() == 0
    kept = J.keep_one(spark, awkward, "")
    assert kept.columns == awkward.columns
    gone = {r.source for r in awkward.collect()} - {r.source for r in kept.collect()}
    assert gone in ({"s3", "s5", "s9"}, {"s4", "s5", "s9"})
    assert J.keep_one(spark, awkward.limit(0), "").count() == 0


def test_split_buckets_without_a_first_pair(spark, monkeypatch):
    """A first pass that yields nothing doesn't end the search where buckets are split."""
    rows = [(i, " ".join(f"w{k}" for k in range(40)) + f" own{i}") for i in range(12)]
    real = J._pairs
    monkeypatch.setattr(J, "HOT", 6)
    monkeypatch.setattr(J, "CELL", 4)
    monkeypatch.setattr(J, "_pairs", lambda cells, percent, grid: real(cells, percent, grid) if grid else real(cells, percent, grid).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, J.linked_components(docs, 3, 90).collect()), key=str) == brute(rows, 3, 90)


def test_places_inside_long_words():
    """Bytes that change places at any distance make another word, as do runs whose differences cancel in a polynomial."""
    for gap in (1, 4095, 4096, 8192, 3 * 4096, 100_000):
        a, b = (x + b"x" * (gap - 1) + y for x, y in ((b"a", b"b"), (b"b", b"a")))
        assert J.word_hashes(a)[1][0] != J.word_hashes(b)[1][0], gap
    thue = "a"
    for _ in range(14):
        thue += thue.translate(str.maketrans("ab", "ba"))
    assert J.word_hashes(thue.encode())[1][0] != J.word_hashes(thue.translate(str.maketrans("ab", "ba")).encode())[1][0]


def test_long_words_are_not_linked(spark):
    words = ["a" + "x" * 4095 + "b", "b" + "x" * 4095 + "a", "x" * 9000, "x" * 9001]
    rows = [(i, w) for i, w in enumerate(words + words)]
    got = J.linked_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 90)


def look_alikes(n):
    """Texts of which each two share two thirds: they meet in buckets and are not linked."""
    shared = [f"s{i}" for i in range(60)]
    return [" ".join([*shared, *(f"u{k}_{i}" for i in range(28))]) for k in range(n)]


@pytest.mark.parametrize("hot,cell", [(8, 6), (8, 1000)])
def test_crowded_buckets(spark, monkeypatch, hot, cell):
    """A bucket of more than 3 * HOT classes that is one component, and one of look-alikes, some with near copies."""
    monkeypatch.setattr(J, "HOT", hot)
    monkeypatch.setattr(J, "CELL", cell)
    base = [f"b{i}" for i in range(150)]
    near = [" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(3, 3 + 3 * hot + 5)]
    alike = look_alikes(3 * hot + 5)
    rows = list(enumerate([*near, *alike, *(t + " end" for t in alike[::3])]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    real = J.apart
    monkeypatch.setattr(J, "apart", lambda *a: seen.append(real(*a)) or seen[-1])
    assert sorted(map(tuple, J.linked_components(docs, 3, 90).collect()), key=str) == brute(rows, 3, 90)
    assert seen


def test_one_component_is_not_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(J, "HOT", 8)
    base = [f"b{i}" for i in range(150)]
    rows = list(enumerate(" ".join([*base[:k], "new", *base[k + 1 :]]) for k in range(3, 40)))
    seen = []
    real = J.apart
    monkeypatch.setattr(J, "apart", lambda *a: seen.append(real(*a)) or seen[-1])
    got = J.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert {r.component_id for r in got.collect()} == {0}
    assert seen[0].count() == 0


def test_buckets_as_a_stream(spark):
    """Of sorted rows in batches of any size, the same buckets."""
    r = random.Random(3)
    rows = sorted({(r.randint(0, 9), 2 * r.randint(0, 6) + (r.random() < 0.1)) for _ in range(70)} | {(50, 7), (60, 2), (60, 4), (70, 3), (70, 8)})
    want = sorted(x for x in rows if len([y for y in rows if y[0] == x[0]]) > 1 and any(y[1] & 1 for y in rows if y[0] == x[0]))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "2", "3", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = sorted(map(tuple, J.buckets(spark.createDataFrame([x for x in rows for _ in range(r.randint(1, 3))], "sig long, key long")).collect()))
        assert got == want, size
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_rows_without_an_id_are_compared(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (7, text + " x"), (None, "other " + text[:30]), (None, "other " + text[:30])]
    kept = J.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted((r.doc_id or -1, r.text[:5]) for r in kept.collect()) == [(-1, "other"), (7, "w0 w1")]
