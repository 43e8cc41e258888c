"""Operators against plain Python: total order, packing, splits, spelling, slots, and rules with errors."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import codecs as K
from corpusloom.functions import images as I
from corpusloom.functions import scripts as S
from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import lookup as L
from corpusloom.operators import ordering as O
from corpusloom.operators import planning as P
from corpusloom.operators import scoring as R


def widths(n, seed):
    r = random.Random(seed)
    return [(i, r.choice([0, 1, 3, 3, 3, 7, 20, 55, 120, 1000])) for i in range(n)]


def test_places_in_the_total_order(spark):
    rows = widths(500, 1)
    got = O.ranked(spark.createDataFrame(rows, "id long, w long").repartition(7), "w", "id").collect()
    want = {i: k for k, (w, i) in enumerate(sorted((w, i) for i, w in rows))}
    assert {r.id: r.place for r in got} == want
    assert O.ranked(spark.createDataFrame([], "id long, w long"), "w", "id").count() == 0


@pytest.mark.parametrize("budget,most", [(60, 8), (200, 5), (1, 3), (10**6, 64), (21, 1)])
def test_packing_is_the_fold(spark, budget, most):
    rows = widths(300, budget)
    got = {r.id: r.batch for r in P.packed(spark.createDataFrame(rows, "id long, w long").repartition(5), "w", "id", budget, most).collect()}
    batch = held = 0
    for w, i in sorted((w, i) for i, w in rows):
        if held and (held >= most or (held + 1) * w > budget):
            batch, held = batch + 1, 0
        held += 1
        assert got[i] == batch, (i, w)


@pytest.mark.parametrize("drop", [True, False])
def test_shuffled_batches_hold_every_row_once(spark, drop):
    rows = widths(107, 3)
    got = P.shuffled_width_batches(spark.createDataFrame(rows, "id long, w long"), "w", "id", 4, 5, drop).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.batch, []).append(r.w)
    assert len({r.id for r in got}) == len(got) == (104 if drop else 107)
    assert sorted(map(len, sizes.values())) == [3] * (not drop) + [4] * 26
    assert sorted({r.turn for r in got}) == list(range(len(sizes)))


def test_capped_split_on_repeated_ids(spark):
    rows = [("7", g) for g in "aab"] + [(str(i), "a") for i in range(300)] + [(str(i), "b") for i in range(300)] + [(None, "a"), ("7", None)]
    got = P.capped_split(spark.createDataFrame(rows, "id string, g string").repartition(3), "g", "id", 0.5, 10).collect()
    assert sorted(map(str, ((r.id, r.g) for r in got))) == sorted(map(str, rows))
    for g in "ab":
        val = sorted(r.id for r in got if r.g == g and r.split == "val")
        import hashlib

        want = sorted(i for i, h in rows if h == g and i is not None and int(hashlib.md5(i.encode()).hexdigest(), 16) % 1000 < 500)[:10]
        assert val == want


def test_spelling_within_two_edits(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abc", k=r.randint(2, 8))) for _ in range(60)]
    entries = ["".join(r.choices("abcd", k=r.randint(2, 8))) for _ in range(60)]
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    got = {x.word: (x.distance, x.best) for x in C.spelling(one(words), one(entries), 2).collect()}

    def edit(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    want = {}
    for w in set(words):
        near = min(((edit(w, e), e) for e in set(entries)))
        if near[0] <= (1 if len(w) <= 4 else 2):
            want[w] = near
    assert got == want and len(want) > 20


def test_corrections(spark):
    dictionary = spark.createDataFrame([("latin", "hello"), ("latin", "help"), ("hindi", "नमस्ते"), ("latin", "x1y")], "script string, word string")
    rows = [("Helo!!", 0.2, "latin", "hello!!", True), ("Helo", 0.5, "latin", "Helo", False), ("he", 0.1, "latin", "he", False), ("hel1o", 0.1, "latin", "hel1o", False), ("Hello.", 0.1, "latin", "Hello.", False), ("zzzzzz", 0.1, "latin", "zzzzzz", False), ("नमसते।", 0.1, "hindi", "नमस्ते।", True), ("helo", 0.1, "hindi", "helo", False), ("a..", 0.1, "latin", "a..", False), ("hexlxo", 0.0, "latin", "hello", True)]
    got = C.corrected(spark.createDataFrame([r[:3] for r in rows], "text string, confidence double, script string"), dictionary)
    assert {r.text: (r.result, r.corrected) for r in got.collect()} == {r[0]: r[3:] for r in rows}
    assert tuple(C.correction_counts(got).first()) == (3, 9, 10)


def test_centers_in_blocks(spark):
    r = random.Random(2)
    v = spark.createDataFrame([(i, i % 6, [r.random() for _ in range(4)]) for i in range(60)], "id long, label int, v array<double>")
    centers = R.centroids(v, "label", "v")
    got = [sorted(map(tuple, R.near_centers(v, centers, "id", "v", "label", n).collect())) for n in (2, 1000)]
    assert got[0] == got[1] and len(got[0]) == 60


def test_slots_stop_when_all_are_taken(spark):
    rows = [(i, -i, leaf, float((i * leaf) % 5)) for i in range(20) for leaf in (1, 2)]
    got = P.greedy_slots(spark.createDataFrame(rows, "it long, w long, leaf int, s double"), "it", "w", "leaf", "s", 3).collect()
    assert sorted((r.leaf, r.slot) for r in got) == [(x, k) for x in (1, 2) for k in range(3)] and {r.item for r in got} == set(range(6))


def test_what_is_an_error(spark):
    with pytest.raises(ValueError, match="klingon"):
        S.allowed(["thai", "klingon"])
    ids = F.create_map(F.lit("a"), F.lit(1))
    with pytest.raises(Exception, match="not in the vocabulary: b"):
        spark.createDataFrame([(["a", "b"],)], "t array<string>").select(K.strict_numbers(F.col("t"), ids)).collect()


def test_scripts(spark):
    rows = spark.createDataFrame([("ab яю",), ("яю ab",), ("", ), (None,), ("٣ 3 abc",), ("﷽a",)], "x string")
    assert [r[0] for r in rows.select(T.script(F.col("x")).alias("s")).collect()] == ["latin", "cyrillic", "latin", "latin", "latin", "arabic"]
    every = [(s, i, gi) for s, _, i, gi, _ in S.MEMBERS]
    assert len(every) == 26 and [i for _, i, _ in every] == list(range(26)) and set(S.SCRIPTS) == {s for s, _, _ in every}
    at = spark.createDataFrame([("nothing",)], "s string").select(S.placed(F.col("s")).alias("p")).first().p
    assert (at.group, at.script_id) == ("latin", 0)


def test_codecs_of_all_scripts(spark):
    """Every character of every vocabulary comes back, and so does each spelled one."""
    codecs = {s: K.codec_of(s, ["का"] if s == "devanagari" else [], {"丁": (3, "一")}) for s in S.SCRIPTS}
    rows = []
    for s, c in codecs.items():
        import unicodedata

        own = [t for t in c.tokens if unicodedata.normalize(c.form, t) == t]
        rows += [(s, t) for t in own[:: max(1, len(own) // 60)]] + [(s, t) for t in list(c.spelled)[::500]]
    df = spark.createDataFrame(rows, "script string, text string")
    assert K.broken_trips(df, codecs).count() == 0
    sizes = {s: c.size for s, c in codecs.items()}
    assert all(sizes[s] <= K.FUSED[s][0] for s in K.FUSED) and sizes["korean"] <= K.KOREAN_SIZE and sizes["han_kana"] <= K.HAN_SIZE
    assert K.codec_of("klingon").size == 0
    full = K.hangul_codec([chr(0xAC00 + 28 * i + 1) for i in range(3000)])
    assert full.size == K.KOREAN_SIZE


def test_decoding_skips_what_has_no_number(spark):
    codecs = {"latin": K.codec_of("latin")}
    got = spark.createDataFrame([([34, 0, 99999, -3, 35], "latin"), (None, "latin"), ([1], "klingon")], "n array<int>, s string").select(K.decoder(codecs)(F.col("n"), F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == ["AB", None, ""]


def test_colours_and_widths(spark):
    row = spark.createDataFrame([(100, 64, [(0, 0, 0, 10, 10, 10), (0, 0, 0, 200, 200, 200)])], "w int, h int, d array<struct<ir: int, ig: int, ib: int, pr: int, pg: int, pb: int>>")
    got = row.select(I.input_width(F.col("w"), F.col("h")).alias("w"), I.input_width(F.lit(1), F.lit(1000)).alias("least"), I.first_readable(F.col("d"))["pr"].alias("pr"), I.first_readable(F.slice("d", 1, 1))["pr"].alias("last")).first()
    assert tuple(got) == (52, 4, 200, 10)


def test_clean_words(spark):
    assert spark.range(1).select(T.clean_word(F.lit("  «漢字», ")).alias("x")).first().x == "漢字"


def test_enough(spark):
    few, asked = spark.createDataFrame([("a",), ("b",)], "word string"), []
    more = lambda: asked.append(1) or spark.createDataFrame([("b",), ("c",)], "word string")
    assert P.enough(few, more, 2).count() == 2 and not asked
    assert sorted(r.word for r in P.enough(few, more, 3).collect()) == ["a", "b", "c"] and asked


def test_large_dimensions_are_not_broadcast(spark, monkeypatch):
    rows, dim = spark.range(10).withColumnRenamed("id", "k"), spark.createDataFrame([(1, 5), (2, 6)], "k long, v int")
    monkeypatch.setattr(L, "BROADCAST_ROWS", 1)
    got = L.looked_up(rows, dim, "k", "v", 0)
    assert {r.k: r.v for r in got.collect()} == {k: {1: 5, 2: 6}.get(k, 0) for k in range(10)}


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Cluster
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        O.shared_folder(Session)


def test_lists_grow_once(spark, tmp_path):
    from corpusloom.operators import vocabulary as V

    path = str(tmp_path / "lists")
    append = lambda df, where: df.write.mode("append").parquet(where)
    words = spark.createDataFrame([("a", "xx"), ("a", "xx"), ("a", "y"), ("b", "zz")], "script string, word string")
    assert sorted(map(tuple, V.grow_lists(words, path, append, dry=True).collect())) == [("a", 1), ("b", 1)]
    assert sorted(map(tuple, V.grow_lists(words, path, append).collect())) == [("a", 1), ("b", 1)]
    assert V.grow_lists(words, path, append).count() == 0 and spark.read.parquet(path).count() == 2


def test_vocabulary(spark):
    from corpusloom.operators import vocabulary as V

    v = V.built(spark, V.script_characters("thai"), ["th", "a"])
    tokens = [r.token for r in v.orderBy("token_id").collect()]
    assert tokens[0] == V.BLANK and tokens[1:96] == V.ASCII and tokens[-1] == "th" and len(set(tokens)) == len(tokens) == V.size(v)


def test_registry():
    from corpusloom.functions import registry as G

    with pytest.raises(ValueError, match="strip is registered"):
        G.register("strip")(lambda c: c)
