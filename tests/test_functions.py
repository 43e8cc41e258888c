"""Column functions and codecs against plain Python, with other scripts, nulls and empty texts."""

import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import codecs as K
from corpusloom.functions import text as T
from corpusloom.operators import scoring as S


def values(spark, rows, kind, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").select(column(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_words(spark):
    assert values(spark, ["Ab, c  de1f «gh» x​yz", "", None, "a" * 16], "string", T.words) == [["Ab", "de", "gh", "yz"], [], None, []]


def test_bigrams(spark):
    assert values(spark, ["abc", "a", "", "안녕a"], "string", T.bigrams) == [["ab", "bc"], [], [], ["안녕", "녕a"]]


@pytest.mark.parametrize("text,script", [("hello", "latin"), ("привет x", "cyrillic"), ("ab नमस्ते", "devanagari"), ("ひら漢", "han_kana"), ("123 !", "latin"), ("αβ ab", "greek"), ("ab αβ", "latin"), ("한국어", "korean"), ("ab 12 తె", "latin"), ("తెలుగు", "telugu"), ("ភាសា x", "khmer"), ("[]{}^ ", "latin"), ("😀a😀", "emoji"), (None, "latin")])
def test_script(spark, text, script):
    assert values(spark, [text], "string", T.script) == [script]


def test_in_script(spark):
    assert values(spark, ["abc", "abя", "12", "é1"], "string", lambda c: T.in_script(c, "latin")) == [True, False, False, True]


def test_md5_mod(spark):
    keys = ["", "a", "7", "чай"]
    assert values(spark, keys, "string", T.md5_mod) == [int(hashlib.md5(k.encode()).hexdigest(), 16) % 1000 for k in keys]


def test_hangul(spark):
    text = "가각힣a"
    parts = values(spark, list(text), "string", K.hangul_parts)
    assert [p and tuple(p) for p in parts] == [(0, 0, 0), (0, 0, 1), (18, 20, 27), None]
    back = spark.createDataFrame([tuple(p) for p in parts if p], "l int, v int, t int").select(K.hangul_syllable(F.col("l"), F.col("v"), F.col("t"))).collect()
    assert sorted(r[0] for r in back) == sorted("가각힣")


def test_normal_forms(spark):
    texts = ["é", "ﬁ", "", None]
    assert values(spark, texts, "string", K.nfc) == [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert values(spark, texts, "string", K.nfkc) == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_clusters(spark):
    assert values(spark, ["नमस्ते", "é", "", None], "string", K.grapheme_clusters) == [["न", "म", "स्ते"], ["é"], [], None]
    assert values(spark, ["aé", "éz"], "string", K.cluster_codec({"a": 1, "é": 2, "e": 3})) == [[1, 2], [2]]


def test_greedy_and_decode(spark):
    assert values(spark, ["them\na"], "string", lambda c: K.greedy_bigrams(c, ["th", "em", "h"])) == [["th", "em", "\n", "a"]]
    assert values(spark, [[1, 0, 3, 9, 2]], "array<int>", lambda c: K.decode(c, F.array(F.lit("x"), F.lit("y"), F.lit("z")))) == ["xzy"]


def test_collapse(spark):
    assert values(spark, [[0, 5, 5, 0, 5, 7, 7], [], None], "array<int>", S.collapsed) == [[5, 5, 7], [], None]


def test_confidence(spark):
    row = spark.createDataFrame([([0, 5, 5, 7], [0.9, 0.5, 0.8, 0.5])], "f array<int>, p array<double>").select(S.path_confidence(F.col("f"), F.col("p"))).first()
    assert abs(row[0] - 0.5) < 1e-6


def test_masked_argmax(spark):
    row = spark.createDataFrame([([3.0, 9.0, 5.0], [True, False, True])], "s array<double>, a array<boolean>").select(S.masked_argmax(F.col("s"), F.col("a"))).first()
    assert row[0] == 2


def test_title_parts(spark):
    assert values(spark, ["Ab cd–ef (x)"], "string", T.title_parts) == [["Ab cd–ef", "Ab", "cd", "ef"]]
