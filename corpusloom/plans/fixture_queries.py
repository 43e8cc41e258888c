"""Queries over small inline tables: codecs and scripts of all kinds, routing, scoring, label files, and other shapes that the driver's tables lack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import codecs as K
from corpusloom.functions import images as I
from corpusloom.functions import registry as G
from corpusloom.functions import scripts as S
from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import lookup as L
from corpusloom.operators import ordering as O
from corpusloom.operators import planning as P
from corpusloom.operators import scoring as R
from corpusloom.operators import vocabulary as V
from corpusloom.plans.corpus_queries import _GAPS, _W
from corpusloom.sources import tables as B

_KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return "[" + ", ".join(map(_literal, x)) + "]" if isinstance(x, list) else str(x)


class Fixture:
    """Rows as a DataFrame and as a common table expression."""

    def __init__(self, schema: str, rows: list[tuple]) -> None:
        self.schema, self.rows = schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self, name: str) -> str:
        fields = [f.split(" ") for f in self.schema.split(", ")]
        kind = lambda k: _KINDS[k[6:-1]] + "[]" if k.startswith("array<") else _KINDS[k]
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"{name} AS (SELECT {', '.join(f'c{i}::{kind(k)} AS {n}' for i, (n, k) in enumerate(fields))} FROM (VALUES {rows}) t({', '.join(f'c{i}' for i in range(len(fields)))}))"


#: A text of each script, all of whose characters its codec knows.
TEXTS = Fixture("script string, text string", [
    ("latin", "Naïve Čeština, 12!"), ("cyrillic", "Привет, мир"), ("greek", "Καλημέρα ἀγάπη"), ("arabic", "مرحبا بكم"), ("hebrew", "שלום עולם"), ("han_kana", "ひらカナ一二"), ("korean", "한국어 가각힣"),
    ("devanagari", "नमस्ते भारत"), ("gurmukhi", "ਪੰਜਾਬੀ"), ("gujarati", "ગુજરાતી"), ("bengali", "বাংলা"), ("odia", "ଓଡ଼ିଆ"), ("kannada", "ಕನ್ನಡ"), ("telugu", "తెలుగు"), ("malayalam", "മലയാളം"), ("tamil", "தமிழ் நாடு"), ("sinhala", "සිංහල"),
    ("thai", "สวัสดี"), ("lao", "ສະບາຍດີ"), ("burmese", "မြန်မာ"), ("khmer", "ភាសាខ្មែរ"), ("emoji", "ok «x»"), ("armenian", "Հայերեն"), ("georgian", "ქართული"), ("ethiopic", "አማርኛ"), ("tibetan", "བོད་ཡིག"),
])
#: Clusters that the fusion codecs of these texts have tokens for.
CLUSTERS = {"devanagari": ["स्ते", "भा"], "tamil": ["ழ்", "நா"], "korean": ["한", "국"], "han_kana": ["漢"]}
#: Look-alikes of ideographs: (which, leaf).
ALIKE = {"丁": (3, "一"), "丂": (0, "二")}
#: The script that each text's characters vote for, where it isn't that of its codec.
VOTED = {"emoji": "latin"}

ROUTES = Fixture("pred_group int, true_group int, pred_script int, true_script int, target_len int, frames int", [
    (0, 0, 0, 0, 5, 10), (0, 1, 0, 0, 5, 10), (1, 1, 1, 0, 5, 10), (1, 1, 1, 1, 11, 10), (1, 1, 1, 1, 10, 10), (2, 2, 0, 0, 0, 10), (2, 2, 0, 0, 1, 1), (3, 2, 1, 1, 0, 0), (5, 5, 2, 2, 3, 2), (5, 5, 2, 3, 3, 2),
])
SCORES = Fixture("id int, scores array<double>, true_script int", [(1, [0.1, 0.9, 0.3], 0), (2, None, 4), (3, [2.0, 2.0], 1), (4, [-1.0, -0.5], 0)])
PREDICTIONS = Fixture("true_group int, true_script int, pred_group int, pred string, ref string", [
    (0, 0, 0, "hello", "Hello "), (0, 0, 0, "helo", "hello"), (0, 1, 1, "", "wrong"), (0, 1, 0, "", "abc"), (1, 0, 1, "xyz", "xyz"), (1, 0, 13, "skip", "skip"), (1, 0, 0, "abc", "abc"), (2, 0, 2, "aaaaaaaaaa", "bb"), (2, 0, 2, "", ""),
])
SETS = Fixture("name string, ref string, pred string", [("a", "One", "one"), ("a", "two", "to"), ("a", "three", "three "), ("b", "x", "y"), ("b", "zz", "zz"), ("b", "q", "q"), ("b", "w", "w"), ("b", "e", "e"), ("b", "r", "r"), ("b", "t", "t")])
BOXES = Fixture("page int, x1 double, y1 double, x2 double, y2 double, height int", [
    (1, 0.5, 0.10, 0.6, 0.14, 1000), (1, 0.1, 0.11, 0.2, 0.15, 1000), (1, 0.1, 0.20, 0.3, 0.24, 1000), (1, 0.4, 0.19, 0.5, 0.23, 1000), (1, 0.0, 0.30, 0.9, 0.38, 1000), (2, 0.3, 0.5, 0.4, 0.5, 100), (2, 0.1, 0.5, 0.2, 0.5, 100),
])
FONTS = Fixture("script string, path string", [("latin", f"/f/{n}.ttf") for n in ("Caveat-1", "caveat-2", "Dancing-x", "indie-f", "Kalam", "Roboto", "Lobster", "Noto", "Serif", "Mono", "Sans")] + [("thai", "/f/NotoThai.ttf"), ("thai", "/f/kalam-th.ttf"), ("lao", "/f/special-lao.ttf")])
COVERED = Fixture("char string, font string", [("a", "f1"), ("a", "f2"), ("a", "f1"), ("b", "f2"), ("z", "f3")])
CJK = Fixture("word string", [("漢字",), ("かな",), ("カナ漢",), ("abc",), ("한국",), ("漢",), ("㐀㐁一",), ("ーー",), ("一一二",), ("a" * 16 + "漢",)])
#: Row-major channel values of pictures: one dark stroke on white, plain paper, one pixel, none, coloured corners.
PICTURES = Fixture("id int, width int, r array<int>, g array<int>, b array<int>", [
    (1, 4, [255, 255, 255, 255, 255, 0, 10, 255, 255, 255, 255, 255], [255, 255, 255, 255, 255, 0, 10, 255, 255, 255, 255, 255], [255, 255, 255, 255, 255, 0, 10, 255, 255, 255, 255, 255]),
    (2, 2, [200, 205, 210, 199], [200, 205, 210, 199], [200, 205, 210, 199]), (3, 1, [7], [7], [7]), (4, 0, [], [], []),
    (5, 3, [0, 90, 255, 250, 0, 255, 0, 20, 0], [0, 90, 255, 0, 0, 255, 0, 20, 0], [0, 90, 255, 0, 255, 255, 0, 20, 0]),
])
ARRAYS = Fixture("id int, a array<string>, b array<string>", [(1, ["x", "y"], ["y"]), (2, ["x"], ["z"]), (3, [], ["x"]), (4, None, ["x"]), (5, ["x", None], [None])])
GRID = (["क", "ख"], ["", "ा", "ि"], ["", "ं"])
HAN_COUNTS = Fixture("word string, n long", [("漢字", 5), ("一漢", 2), ("字字", 1), ("かな", 9), ("人", 6), ("口", 1), ("山", 1), (None, 3)])
LISTED = Fixture("script string, word string", [("devanagari", w) for w in ("नमस्ते", "न 1", "नa", "abc", "12", "नग;", "नя")] + [("thai", "สวัสดี"), ("thai", "ก"), ("latin", "�naïve"), ("latin", "9lives"), ("latin", "naïve"), ("latin", "b" * 16)])
RUNNING = Fixture("id int, text string", [(1, "«Привет», мир! hello (мир-труд) 12 мир…"), (2, "x​мир да"), (3, ""), (4, "\"да\" 'нет' #тег#")])
MARKUP = Fixture("id int, markup string, html string", [(1, "see [[alpha]] and [[beta|b]] [[ alpha ]]", "<tr><td>ab</td><td class='x'>c</td><td><b>def</b></td></tr>"), (2, "[[x", "<td>sixteen letters!</td><td>fifteen letters</td>"), (3, "", "")])
REPLIES = Fixture("kind string, json string", [
    ("sentences", '{"results": [{"text": "one"}, {"text": ""}, {"other": 1}, {"text": "two"}]}'), ("sentences", "broken"),
    ("books", '{"results": [{"formats": {"text/html": "a.html", "text/plain; charset=utf-8": "a.txt"}}, {"formats": {"text/plain": "b.zip"}}, {"formats": {"text/plain": "c.txt"}}]}'),
    ("text", '{"text": "In the beginning"}'), ("text", "{}"),
])
LINES = Fixture("kind string, value string", [
    ("text", "a.png first label"), ("text", "  b.png\tsecond "), ("text", "lonely"), ("text", ""),
    ("json", '[{"image": "c.png", "text": "third"}, {"image": "d.png"}, {"text": "x"}]'), ("json", '{"image": "e.png", "text": "no list"}'), ("json", "["),
    ("words", "# comment ok 1 2 3 4 5 6 x"), ("words", "a01-0 ok 154 1 2 3 4 AT move"), ("words", "a01-1 err 154 1 2 3 4 AT stop"), ("words", "a01-2 ok 154 1 2 3 4 AT x"), ("words", "a01-3 ok 1 short"), ("words", "a01-4 ok 154 1 2 3 4 AT B two"),
])
FILES = Fixture("path string", [("/d/one.jpeg",), ("/d/one.jpg",), ("/e/one.png",), ("/d/two.jpg",), ("/d/three.gif",), ("/d/four.JPEG",)])
LABELS = Fixture("stem string, label string", [("one", "1"), ("two", " 22 "), ("three", "3"), ("four", ""), ("five", "x" * 60)])
STORE = Fixture("key string, value string", [("num-samples", "3"), ("image-000000001", "i1"), ("label-000000001", "l1"), ("label-000000002", "l2"), ("image-000000003", "i3"), ("label-000000003", "l3"), ("image-000000004", "i4"), ("label-000000004", "l4"), ("image-000000000", "i0"), ("label-000000000", "l0")])
PIXELS = Fixture("id int, r int, g int, b int", [(1, 0, 0, 0), (2, 255, 255, 255), (3, 255, 0, 0), (4, 0, 255, 0), (5, 0, 0, 255), (6, 128, 128, 128), (7, 10, 20, 30), (8, 200, 100, 50)])
INKS = Fixture("id int, ir int, ig int, ib int, pr int, pg int, pb int", [(1, 0, 0, 0, 255, 255, 255), (2, 100, 100, 100, 150, 150, 150), (3, 255, 0, 0, 0, 0, 255), (4, 0, 100, 0, 0, 210, 0)])
FRAMES = Fixture("id int, classes int, path string, f1 array<double>, f2 array<double>, f3 array<double>, f4 array<double>", [
    (1, 3, "1,2", [0.1, 0.8, 0.1, 9.0], [0.2, 0.7, 0.1, 0.0], [0.9, 0.0, 0.1, 0.0], [0.1, 0.2, 0.7, 5.0]), (2, 4, "3,1", [0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0, 1.0], [0.0, 1.0, 0.0, 0.0], [1.0, 1.0, 0.0, 0.0]), (3, 1, "", [0.1, 5.0, 5.0, 5.0], [0.1, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]),
])
LOSSES = Fixture("group int, loss double, target_len int", [(0, 2.0, 4), (0, 4.0, 2), (1, 9.0, 3), (2, 1.5, 0), (2, 2.5, 1)])
NAMES = Fixture("name string", [("Hindi",), ("bangla",), ("punjabi",), ("tamil",), ("klingon",), ("ORIYA",)])
SYLLABLES = Fixture("id int, parts array<string>", [(1, ["가", "ᆨ", "나", "a"]), (2, ["각", "ᆨ"]), (3, ["ᆨ", "하", "ᇂ", "ᆨ"]), (4, [])])
KOREAN = Fixture("word string", [("한국",), ("한글",), ("국가",), ("학교",), ("한",), ("abc",)])
GRAPHEMES = Fixture("text string, expected array<string>", [("नमस्ते न", ["न", "म", "स्ते", " ", "न"]), ("ée", ["é", "e"]), ("தமிழ்", ["த", "மி", "ழ்"]), ("", [])])
TOKENS = Fixture("token string", [("a",), (" ",), ("",), ("́",), (" ",), ("क",), ("ि",), ("\x01",), ("汉",)])
FILLED = {"thai": ("กขคงจ", "ะิีุู", "์"), "khmer": ("កខគឃងច", "ាិីឹ", "្"), "hebrew": ("אבגד", "ְֱֲ", "־")}


def script_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script of a text of each kind, its group and numbers."""
    got = TEXTS.frame(spark).select("text", T.script(F.col("text")).alias("script"))
    at = S.placed(F.col("script"))
    return got.select("text", "script", at["group"].alias("group_name"), at["script_id"].alias("script_id"), at["group_id"].alias("group_id"), at["local_id"].alias("local_id"))


def _codecs() -> dict[str, K.Codec]:
    return {s: K.codec_of(s, CLUSTERS.get(s, []), ALIKE) for s in S.SCRIPTS}


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of each script encoded and decoded."""
    codecs = _codecs()
    return TEXTS.frame(spark).select("script", "text", K.decoder(codecs)(K.encoder(codecs)(F.col("text"), F.col("script")), F.col("script")).alias("decoded"))


def codec_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that their codec doesn't give back: of a script that is not theirs."""
    wrong = TEXTS.frame(spark).withColumn("script", F.when(F.col("script") == "thai", "lao").otherwise(F.col("script")))
    return K.broken_trips(wrong, _codecs()).select("script", "text")


_NUMBERED = Fixture("script string, text string, expected array<int>", [
    ("latin", "A é", [34, 1, 168]), ("latin", "日A", [34]), ("latin", "é", [168]), ("klingon", "A", []), ("latin", None, None), ("cyrillic", "Ab", []), ("korean", "가", [152]), ("korean", "각", [152, 125]), ("devanagari", "भा", [218]), ("han_kana", "Ａ", []), ("emoji", "A", [34]),
])


def codec_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of known texts: unknown characters and scripts give none, composed forms are one."""
    codecs = _codecs()
    rows = _NUMBERED.frame(spark)
    ids = K.encoder(codecs)(F.col("text"), F.col("script"))
    return rows.select("script", "text", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


def hangul_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Hangul syllable through the codec without frequent ones: number of tokens, and what comes back."""
    codecs = {"korean": K.hangul_codec()}
    all_ = spark.range(K.SYLLABLES).select(F.col("id"), K.code_point_char(F.lit(K.HANGUL) + F.col("id")).alias("syllable"), F.lit("korean").alias("script"))
    ids = all_.withColumn("ids", K.encoder(codecs)(F.col("syllable"), F.col("script")))
    return ids.select("id", F.size("ids").cast("long").alias("n"), K.decoder(codecs)(F.col("ids"), F.col("script")).alias("decoded"))


def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of plain vocabularies whose ranges are wholly assigned, and the groups' tables of sizes."""
    sizes = spark.createDataFrame([(s, K.codec_of(s).size) for s in ("latin", "emoji", "unknown") if s != "unknown"], "script string, size int")
    return L.vocabulary_table(sizes).select("group_id", "group", F.array_join("scripts", ",").alias("scripts"), F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"))


def joined_consonants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joining sign before each letter of a script's range."""
    rows = spark.createDataFrame([(s, *v) for s, v in K.JOINERS.items()], "script string, sign int, first int, last int")
    each = rows.select("script", K.code_point_char(F.col("sign")).alias("sign"), F.explode(F.sequence("first", "last")).alias("cp")).withColumn("letter", K.code_point_char(F.col("cp")))
    return each.filter(S.assigned(F.col("letter"))).select("script", F.concat("sign", "letter").alias("pair"))


def three_part_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most frequent syllables with a tail."""
    counts = C.three_part_counts(KOREAN.frame(spark))
    return counts.orderBy(F.desc("n"), "syllable").limit(2)


def merged_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables and the tails after them."""
    return SYLLABLES.frame(spark).select("id", F.array_join(K.merged_tails(F.col("parts")), "").alias("text"))


def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grapheme clusters by number."""
    return C.cluster_counts(GRAPHEMES.frame(spark))


def cluster_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of clusters of several code points."""
    return C.multi_share(C.cluster_counts(GRAPHEMES.frame(spark)))


def fusion_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fits a vocabulary of 9 beside five base characters: two sure entries, then the most frequent clusters."""
    clusters = Fixture("cluster string, count long, cp_len int", _FUSIONS).frame(spark)
    return C.fusions(clusters, list("abcde"), ["ab", "zz"], 9)


_FUSIONS = [("ab", 90, 2), ("bc", 50, 2), ("cd", 50, 2), ("ax", 80, 2), ("a", 99, 1), ("de", 10, 2), ("abc", 50, 3)]


def routing_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.routing(ROUTES.frame(spark))


def valid_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ROUTES.frame(spark).filter(R.valid_target(F.col("target_len"), F.col("frames"))).select("true_group", "target_len", "frames")


def script_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best script of each row's scores, the true one where there are none."""
    return SCORES.frame(spark).select("id", R.script_of_group(F.col("scores"), F.col("true_script")).alias("script_id"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best place and confidence of scores."""
    p = R.predicted(F.col("scores"))
    return SCORES.frame(spark).filter("scores IS NOT NULL").select("id", p["best"].alias("best"), F.round(p["confidence"], 6).alias("confidence"))


def script_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and places of scripts that decoding is restricted to."""
    return spark.createDataFrame(S.allowed(["thai", "greek", "khmer"]), "group_id int, local_id int")


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active scripts of one group."""
    return L.members_of(TEXTS.frame(spark).select("script"), "script", "south_indic")


def word_accuracy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.word_levels(PREDICTIONS.frame(spark), 13)


def benchmark_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.set_accuracy(SETS.frame(spark)).select("name", F.round("word_accuracy", 6).alias("word_accuracy"), F.round("char_accuracy", 6).alias("char_accuracy"), "n")


def benchmark_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.weighted_average(R.set_accuracy(SETS.frame(spark)))


def loss_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.regional_loss(LOSSES.frame(spark))


def frame_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best class of each frame among the first classes, collapsed."""
    rows = FRAMES.frame(spark).select("id", R.frame_path(F.array("f1", "f2", "f3", "f4"), F.col("classes")).alias("path"))
    return rows.select("id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.reading_order(BOXES.frame(spark)).select("page", "x1", "y1", "line", "order")


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each page in reading order."""
    rows = O.reading_order(BOXES.frame(spark)).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "x1"))), lambda v: v["x1"]).alias("x"))
    return rows.select("page", F.array_join(F.col("x").cast("array<string>"), ",").alias("boxes"))


def style_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each language and style."""
    sizes = C.count_by(B.table(spark, sf_dir, "documents"), "lang")
    return P.style_targets(sizes, "n", {k: v[0] for k, v in L.STYLES.items()}).select("lang", "n", "style", "style_target")


def chunks_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 100 ids of which the labels table has no document."""
    chunk = F.floor(F.col("doc_id") / 100).alias("chunk")
    return P.missing_chunks(B.table(spark, sf_dir, "documents").select(chunk).distinct(), B.table(spark, sf_dir, "labels").filter("toxic = 1").select(chunk), "chunk")


def styled_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts of each script and kind."""
    fonts, out = FONTS.frame(spark), None
    for kind in ("all", "regular", "handwriting", "display"):
        some = L.styled_fonts(fonts, "script", "path", kind).select(F.lit(kind).alias("kind"), "script", "path")
        out = some if out is None else out.union(some)
    return out


def char_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = COVERED.frame(spark)
    return L.fonts_of_chars(fonts, spark.createDataFrame([("a",), ("b",), ("c",)], "char string"), "char", "font").select("char", F.array_join("fonts", ",").alias("fonts"))


def renderable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.renderable(TOKENS.frame(spark), "token")


def cjk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return CJK.frame(spark).select("word", S.has_han(w).alias("han"), S.has_kana(w).alias("kana"), S.cjk_word(w).alias("valid"), F.array_join(S.han_chars(w), "").alias("chars"), S.word_list_of(w).alias("list"))


def han_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.han_coverage(CJK.frame(spark))


def listed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a script's list takes."""
    w, out = F.col("word"), None
    for name in ("devanagari", "thai", "latin"):
        some = LISTED.frame(spark).filter(F.col("script") == name).filter(S.list_word(w, name))
        out = some if out is None else out.union(some)
    return out


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of several scripts at once."""
    return B.word_lists(LISTED.frame(spark), ["latin", "emoji", "greek", "thai"]).select("script", F.array_join("words", ",").alias("words"))


def running_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cyrillic words of running text."""
    return RUNNING.frame(spark).select("id", F.posexplode(T.running_words(F.col("text"), "cyrillic")).alias("place", "word"))


def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different tokens of all documents by the three rules of stripping."""
    docs, out = B.table(spark, sf_dir, "documents"), None
    for ends in T.ENDS_BESIDE:
        some = docs.select(F.explode(T.tokens(F.col("text"), ends)).alias("word")).distinct().agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("word")).alias("chars")).select(F.lit(ends).alias("rule"), "words", "chars")
        out = some if out is None else out.union(some)
    return out


def vocabulary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most frequent pairs inside tokens of documents' text that are of ASCII letters or digits, but not of two digits."""
    counts = C.count_by(B.table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\s\x0b]+")).alias("word")).filter("word <> ''"), "word")
    return C.vocabulary_pairs(C.pair_counts(counts), "A-Za-z0-9").orderBy(F.desc("n"), "pair").limit(30)


def wiki_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MARKUP.frame(spark).select("id", F.explode(T.wiki_links(F.col("markup"))).alias("target"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MARKUP.frame(spark).select("id", F.explode(T.table_cells(F.col("html"))).alias("cell"))


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and addresses in replies of three kinds."""
    of = lambda k: REPLIES.frame(spark).filter(F.col("kind") == k)
    return B.json_sentences(of("sentences")).select(F.lit("sentences").alias("kind"), "text").union(B.json_books(of("books")).select(F.lit("books"), "url")).union(B.json_text(of("text")).select(F.lit("text"), "text"))


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of lines, of JSON lists and of a word index."""
    of = lambda k: LINES.frame(spark).filter(F.col("kind") == k)
    return B.labels_text(of("text")).select(F.lit("text").alias("kind"), "image", "label").union(B.labels_json(of("json"), "value").select(F.lit("json"), "image", "label")).union(B.graded_words(of("words")).select(F.lit("words"), "id", "word"))


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label the first file there is, by ending."""
    return L.first_match(LABELS.frame(spark), FILES.frame(spark), "stem", "path", [".png", ".jpg", ".jpeg"]).select("stem", "path")


def label_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.label_bounds(LABELS.frame(spark), "label").select("stem")


def normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NAMES.frame(spark).select("name", S.normal_name(F.col("name")).alias("script")).filter("script IS NOT NULL")


def store_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a key/value store numbered from 1, of which one lacks its image."""
    pairs = STORE.frame(spark).select("key", F.encode("value", "UTF-8").alias("value"))
    return B.pairs_to_samples(pairs, 1).select("idx", F.decode("image", "UTF-8").alias("image"), "label")


def shard_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as chunks of both splits and read again: rows of each."""
    import uuid

    path = f"{O.shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "lang", P.split_of(F.col("doc_id").cast("string"), 0.1).alias("split"), F.floor(F.col("doc_id") / 500).alias("chunk"))
    B.write_chunks(docs, path, 200)
    both = B.read_shards(spark, path, "train").withColumn("split", F.lit("train")).union(B.read_shards(spark, path, "val").withColumn("split", F.lit("val")))
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def article_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 documents by id: a cap on articles."""
    return B.first_articles(B.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


def chosen_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of French and German, English left out."""
    return C.count_by(L.chosen_languages(B.table(spark, sf_dir, "documents"), "lang", ["fr", "de", "en"]), "lang")


def padded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each script's labels, padded to its longest."""
    rows = TEXTS.frame(spark).filter(F.col("script").isin("latin", "emoji")).unionByName(spark.createDataFrame([("latin", "ab"), ("latin", "日"), ("greek", "日")], "script string, text string"))
    codecs = {s: K.codec_of(s) for s in ("latin", "emoji", "greek")}
    got = B.padded_samples(rows.withColumn("ids", K.encoder(codecs)(F.col("text"), F.col("script"))))
    return got.select("script", "text", F.size("ids").alias("width"), "target_len")


def strict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the pairs and characters of words, all of which the vocabulary has."""
    words = spark.createDataFrame([("then",), ("hat",), ("eth",)], "word string")
    ids = F.create_map(*(F.lit(x) for i, t in enumerate(["th", "he", "e", "n", "a", "t", "h"]) for x in (t, i + 1)))
    return words.select("word", F.array_join(K.strict_numbers(K.greedy_bigrams(F.col("word"), ["th", "he"]), ids).cast("array<string>"), ",").alias("ids"))


def lab_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightness and red-green bytes of pixels."""
    at = I.lightness_and_a(F.col("r"), F.col("g"), F.col("b"))
    return PIXELS.frame(spark).select("id", at["l"].alias("l"), at["a"].alias("a"))


def readable_inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return INKS.frame(spark).select("id", I.readable([F.col(c) for c in ("ir", "ig", "ib")], [F.col(c) for c in ("pr", "pg", "pb")]).alias("readable"))


def ink_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of small pictures that stand out from their corners, and whether there are at least two."""
    n = I.ink_pixels(I.grey_levels(F.col("r"), F.col("g"), F.col("b")), F.col("width"))
    return PICTURES.frame(spark).select("id", n.cast("long").alias("n"), (n >= 2).alias("inked"))


def common_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ARRAYS.frame(spark).select("id", L.shares_any(F.col("a"), F.col("b")).alias("any"))


def syllable_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every consonant with every vowel sign and tone of a small grid."""
    return L.combined(spark, *GRID)


def ideograph_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ideographs that fill a vocabulary of 6 beside two base characters."""
    return C.frequent_ideographs(HAN_COUNTS.frame(spark), ["一", "ー"], 6)


def list_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with ideographs or kana, written to one list or the other and read again."""
    import uuid

    path = f"{O.shared_folder(spark).rstrip('/')}/lists-{uuid.uuid4().hex}"
    w = F.col("word")
    B.write_lists(CJK.frame(spark).filter(S.cjk_word(w)).select("word", S.word_list_of(w).alias("list")), path)
    return spark.read.text(path).select("list", F.col("value").alias("word"))


def filler_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up words that show all characters of a script."""
    return L.filler_words(spark, FILLED)


def mixed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark with punctuation and numbers mixed in, for three of four words."""
    words = T.word_rows(B.table(spark, sf_dir, "benchmark")).distinct()
    return words.select("word", L.mixed_with_marks(F.col("word"), F.col("word"), F.lit("latin"), 0.75).alias("mixed"), L.mixed_with_marks(F.col("word"), F.col("word"), F.lit("thai"), 0.75).alias("mixed_any"))


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = C.count_by(T.word_rows(B.table(spark, sf_dir, "documents")), "word").filter("n >= 20 AND word RLIKE '^[A-Za-z]{2,}$'")
    dictionary = counts.select(F.lit("latin").alias("script"), "word")
    words = T.word_rows(B.table(spark, sf_dir, "benchmark")).filter("word RLIKE '^[A-Za-z]{4,15}$'")
    texts = words.select(F.concat(F.left("word", F.lit(1)), F.substring("word", 3, 20), F.lit(".")).alias("text"), (F.length("word") % 4 / F.lit(4.0)).alias("confidence"), F.lit("latin").alias("script")).distinct()
    return C.corrected(texts, dictionary)


def spell_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark without their second letter, corrected within two edits where confidence is low."""
    return _corrected(spark, sf_dir).select("text", "confidence", "result", "corrected")


def spell_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.correction_counts(_corrected(spark, sf_dir))


def counted_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blank, printable ASCII, and the 75 most frequent pairs of ASCII letters and digits in documents."""
    return V.counted(C.count_by(T.word_rows(B.table(spark, sf_dir, "documents")), "word"), "A-Za-z0-9")


def grown_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents and conversations that a list of the benchmark's words lacks."""
    return V.grown([T.word_rows(B.table(spark, sf_dir, t)) for t in ("documents", "conversations")], T.word_rows(B.table(spark, sf_dir, "benchmark")))


def filler_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up words of each script that a new list would get."""
    return V.grow_lists(L.filler_words(spark, FILLED), f"{O.shared_folder(spark)}/no-list-here", lambda *_: None, dry=True)


def named_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions picked by name, applied in turn, and one called from SQL text."""
    G.to_sql(spark)
    rows = RUNNING.frame(spark).select("id", G.applied(F.col("text"), ["without_tags", "clean_word"]).alias("clean"))
    return rows.select("id", "clean", F.expr("corpus_nfc(clean)").alias("form"))


def _draw(salt: str, n: int) -> str:
    """drawn() of a column `word` in SQL."""
    h = f"md5(word || ':{salt}')"
    m, step = 1_000_003, (1 << 32) % 1_000_003
    out = "0"
    for i in range(4):
        out = f"(({out} * {step} + ('0x' || substr({h}, {8 * i + 1}, 8))::BIGINT) % {m})"
    return f"({out} % {n})"


def _mixed_sql(weights: dict[str, int]) -> str:
    one = lambda salt, choices: f"{choices!r}[{_draw(salt, len(choices))} + 1]".replace('"\'"', "''''").replace("'\"'", "'\"'")
    two = lambda x: f"lpad(({x})::VARCHAR, 2, '0')"
    number = f"CASE WHEN {_draw('kind', 10)} < 4 THEN ({_draw('whole', 99999)} + 1)::VARCHAR WHEN {_draw('kind', 10)} < 7 THEN format('{{:,}}', {_draw('commas', 999900)} + 100) ELSE {_draw('units', 10000)} || '.' || {two(_draw('cents', 100))} END"
    d, m, y, sep = two(_draw("day", 31) + " + 1"), two(_draw("month", 12) + " + 1"), f"({_draw('year', 76)} + 1950)", one("separator", ["-", "/", "."])
    made = {
        "end": f"word || {one('end', list('.,;:!?'))}",
        "dash": f"word || {one('dash', ['…', '–', '—'])}",
        "ascii_quote": f"{one('open', list(chr(34) + chr(39) + '('))} || word || {one('close', list(chr(34) + chr(39) + ')'))}",
        "quote": f"CASE {_draw('quote', 4)} WHEN 0 THEN '‘' || word || '’' WHEN 1 THEN '“' || word || '”' WHEN 2 THEN '«' || word || '»' ELSE '„' || word || '“' END",
        "number_before": f"{_draw('before', 10)} || {one('point', list('.)'))} || ' ' || word",
        "number_after": f"word || {one('stroke', list('-/'))} || {_draw('after', 10)}",
        "twice": f"word || {one('joint', list('-/&'))} || left(word, greatest(2, length(word) // 2))",
        "short_number": f"({_draw('short', 999)} + 1)::VARCHAR",
        "number": number,
        "date": f"CASE {_draw('order', 3)} WHEN 0 THEN {d} || {sep} || {m} || {sep} || {y} WHEN 1 THEN {d} || {sep} || {m} || {sep} || {two(y + ' % 100')} ELSE {y} || {sep} || {m} || {sep} || {d} END",
        "price": f"'$' || {number}",
        "telephone": f"lpad({_draw('area', 1000)}::VARCHAR, 3, '0') || '-' || lpad({_draw('line', 10000)}::VARCHAR, 4, '0')",
        "reference": f"{one('sign', list('#*'))} || ({_draw('note', 999)} + 1)",
    }
    at, end, out = _draw("way", sum(weights.values())), 0, "CASE"
    for name, w in weights.items():
        end += w
        out += f" WHEN {at} < {end} THEN {made[name]}"
    mod = "0"
    for i in range(4):
        mod = f"(({mod} * 296 + ('0x' || substr(md5(word || ':mix'), {8 * i + 1}, 8))::BIGINT) % 1000)"
    return f"CASE WHEN {mod} >= 750 THEN word ELSE {out} END END"


_PLACED = ", ".join(f"('{t}', '{v}', '{g}', {i}, {gi}, {k})" for s, t in TEXTS.rows for v in [VOTED.get(s, s)] for n, g, i, gi, k in S.MEMBERS if n == v)
_LIST_CLASS = lambda s: rf"^[\x20-\x7E\p{{Z}}\p{{P}}\p{{Nd}}{S.members(S.SCRIPTS[s])}]*$"
_TOKENS = lambda ends: f"unnest(list_filter(list_transform(regexp_split_to_array(text, '[{T.SEPARATORS.replace(chr(39), chr(39) * 2)}]+'), lambda w: trim(w, '{(T.ENDS + ends).replace(chr(39), chr(39) * 2)}')), lambda w: length(w) BETWEEN 2 AND 15 AND NOT regexp_matches(w, '^\\p{{Nd}}'))) AS word"
_FITS = "CASE kind WHEN 'all' THEN true WHEN 'regular' THEN NOT hand AND NOT disp WHEN 'handwriting' THEN hand ELSE disp END"
_SET = f"{SETS.sql('s')}, n AS (SELECT name, lower(trim(ref)) AS ref, lower(trim(pred)) AS pred FROM s), a AS (SELECT name, 100.0 * count(*) FILTER (WHERE ref = pred) / count(*) AS word_accuracy, 100.0 * sum(greatest(0, length(ref) - levenshtein(pred, ref))) / greatest(sum(length(ref)), 1) AS char_accuracy, count(*) AS n FROM n GROUP BY name)"
_SPELL = f"{_W}, dict AS (SELECT word FROM w WHERE regexp_full_match(word, '[A-Za-z]{{2,}}') GROUP BY word HAVING count(*) >= 20), q AS (SELECT DISTINCT substring(word, 1, 1) || substring(word, 3) || '.' AS text, (length(word) % 4 / 4.0)::DOUBLE AS confidence, lower(substring(word, 1, 1) || substring(word, 3)) AS look FROM bw WHERE regexp_full_match(word, '[A-Za-z]{{4,15}}')), due AS (SELECT DISTINCT look FROM q WHERE confidence < 0.5 AND length(text) >= 3 AND length(look) >= 3 AND look NOT IN (SELECT word FROM dict)), m AS (SELECT look, word, levenshtein(look, word) AS d FROM due JOIN dict ON abs(length(look) - length(word)) <= 2), best AS (SELECT look, arg_min(word, (d, word)) AS best FROM m WHERE d <= CASE WHEN length(look) <= 4 THEN 1 ELSE 2 END GROUP BY look), r AS (SELECT text, confidence, coalesce(best || '.', text) AS result, best IS NOT NULL AS corrected FROM q LEFT JOIN best ON q.look = best.look AND confidence < 0.5)"
_LIN = lambda c: f"CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"
_ROOT = lambda t: f"CASE WHEN {t} > 0.008856 THEN pow({t}, 1 / 3::DOUBLE) ELSE 7.787 * {t} + 16 / 116::DOUBLE END"
_ORDER = f"{BOXES.sql('b')}, h AS (SELECT page, greatest(median((y2 - y1) * height), 1.0) AS line FROM b GROUP BY page), o AS (SELECT page, x1, y1, floor((y1 + y2) / 2 * height / h.line)::BIGINT AS line, x1 + x2 AS x FROM b JOIN h USING (page)), p AS (SELECT page, x1, y1, line, row_number() OVER (PARTITION BY page ORDER BY line, x, y1, x1) - 1 AS \"order\" FROM o)"

SQL = {
    "script_table": f"SELECT * FROM (VALUES {_PLACED}) t(text, script, group_name, script_id, group_id, local_id)",
    "codec_roundtrip": f"WITH {TEXTS.sql('t')} SELECT script, text, nfc_normalize(text) AS decoded FROM t",
    "codec_failures": f"WITH {TEXTS.sql('t')} SELECT 'lao' AS script, text FROM t WHERE script = 'thai' UNION ALL SELECT script, text FROM t WHERE nfc_normalize(text) <> text",
    "codec_numbers": f"WITH {_NUMBERED.sql('t')} SELECT script, text, array_to_string(expected, ',') AS ids FROM t",
    "hangul_codec": "SELECT i AS id, CASE WHEN i % 28 = 0 THEN 1 ELSE 2 END::BIGINT AS n, chr(44032 + i::INTEGER) AS decoded FROM range(11172) t(i)",
    "codec_sizes": "SELECT * FROM (VALUES (0, 'latin', 'latin', '797'), (9, 'emoji', 'emoji', '107')) t(group_id, \"group\", scripts, sizes)",
    "joined_consonants": "SELECT script, chr(sign) || chr(cp) AS pair FROM (SELECT script, sign, unnest(range(first, last + 1))::INTEGER AS cp FROM (VALUES " + ", ".join(f"('{s}', {a}, {b}, {c})" for s, (a, b, c) in K.JOINERS.items()) + r") t(script, sign, first, last)) WHERE regexp_matches(chr(cp), '[\p{L}\p{M}\p{N}\p{P}\p{S}]')",
    "three_part_top": f"WITH {KOREAN.sql('k')}, c AS (SELECT unnest(regexp_extract_all(word, '.')) AS syllable FROM k) SELECT syllable, count(*) AS n FROM c WHERE unicode(syllable) BETWEEN 44032 AND 55203 AND (unicode(syllable) - 44032) % 28 > 0 GROUP BY syllable ORDER BY n DESC, syllable LIMIT 2",
    "merged_tails": "SELECT * FROM (VALUES (1, '각나a'), (2, '각ᆨ'), (3, 'ᆨ핳ᆨ'), (4, '')) t(id, text)",
    "cluster_counts": f"WITH {GRAPHEMES.sql('g')} SELECT cluster, count(*) AS count, length(cluster)::INTEGER AS cp_len FROM (SELECT unnest(expected) AS cluster FROM g) GROUP BY cluster",
    "cluster_rate": f"WITH {GRAPHEMES.sql('g')}, c AS (SELECT unnest(expected) AS cluster FROM g) SELECT count(*) AS clusters, count(*) FILTER (WHERE length(cluster) > 1) AS multi, round(count(*) FILTER (WHERE length(cluster) > 1) / count(*), 6) AS rate FROM c",
    "fusion_slots": "SELECT * FROM (VALUES ('ab', 1), ('zz', 2), ('abc', 3)) t(fusion, rank)",
    "routing_masks": f"WITH {ROUTES.sql('r')} SELECT *, pred_group = true_group AS group_ok, pred_group = true_group AND pred_script = true_script AND target_len <= frames AND target_len > 0 AS decode_ok FROM r",
    "valid_targets": f"WITH {ROUTES.sql('r')} SELECT true_group, target_len, frames FROM r WHERE target_len > 0 AND target_len <= frames",
    "script_override": f"WITH {SCORES.sql('s')} SELECT id, CASE WHEN scores IS NULL THEN true_script ELSE list_position(scores, list_max(scores)) - 1 END::INTEGER AS script_id FROM s",
    "predictions": f"WITH {SCORES.sql('s')} SELECT id, (list_position(scores, list_max(scores)) - 1)::BIGINT AS best, round(exp(list_max(scores)) / list_sum(list_transform(scores, lambda x: exp(x))), 6) AS confidence FROM s WHERE scores IS NOT NULL",
    "script_allow_list": "SELECT * FROM (VALUES (1, 1), (8, 0), (8, 3)) t(group_id, local_id)",
    "group_members": "SELECT unnest(['kannada', 'telugu', 'malayalam', 'tamil', 'sinhala']) AS script",
    "word_accuracy_levels": f"WITH {PREDICTIONS.sql('p')}, n AS (SELECT true_group, true_script, pred_group = true_group AS sent, lower(trim(ref)) AS ref, lower(trim(pred)) AS pred FROM p WHERE pred_group < 13) SELECT true_group, true_script, grouping(true_group, true_script)::INTEGER AS level, count(*) AS words, sum(length(ref))::BIGINT AS chars, round(100.0 * count(*) FILTER (WHERE sent AND ref = pred) / greatest(count(*), 1), 4) AS word_accuracy, round(100.0 * sum(CASE WHEN sent THEN greatest(0, length(ref) - levenshtein(pred, ref)) ELSE 0 END) / greatest(sum(length(ref)), 1), 4) AS char_accuracy FROM n GROUP BY GROUPING SETS ((), (true_group), (true_group, true_script))",
    "benchmark_sets": f"WITH {_SET} SELECT name, round(word_accuracy, 6) AS word_accuracy, round(char_accuracy, 6) AS char_accuracy, n FROM a",
    "benchmark_average": f"WITH {_SET} SELECT round(100.0 * sum(floor(word_accuracy * n / 100)) / sum(n), 6) AS average, sum(n)::BIGINT AS n FROM a",
    "loss_sums": f"WITH {LOSSES.sql('l')}, g AS (SELECT \"group\", sum(loss) AS s, sum(target_len) AS t, avg(loss) AS m FROM l GROUP BY \"group\") SELECT round(sum(s) / greatest(sum(t), 1), 6) AS per_token, round(avg(m), 6) AS mean_of_groups FROM g".replace("AS group,", 'AS "group",'),
    "frame_paths": f"WITH {FRAMES.sql('f')} SELECT id, path FROM f",
    "reading_order": f"WITH {_ORDER} SELECT page, x1, y1, line, \"order\" FROM p",
    "page_rows": f"WITH {_ORDER} SELECT page, string_agg(x1::VARCHAR, ',' ORDER BY \"order\") AS boxes FROM p GROUP BY page",
    "style_plan": "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), s(style, share) AS (VALUES " + ", ".join(f"('{k}', {v[0]}::DOUBLE)" for k, v in L.STYLES.items()) + ") SELECT lang, n, style, greatest(1, floor(n * share))::BIGINT AS style_target FROM n, s",
    "chunks_left": "SELECT DISTINCT doc_id // 100 AS chunk FROM documents WHERE doc_id // 100 NOT IN (SELECT doc_id // 100 FROM labels WHERE toxic = 1)",
    "styled_fonts": f"WITH {FONTS.sql('f')}, k(kind) AS (VALUES ('all'), ('regular'), ('handwriting'), ('display')), x AS (SELECT kind, script, path, regexp_matches(lower(path), '{'|'.join(L.HANDWRITING)}') AS hand, regexp_matches(lower(path), '{'|'.join(L.DISPLAY)}') AS disp FROM f, k), y AS (SELECT *, {_FITS} AS fits FROM x), c AS (SELECT kind, script, count(DISTINCT path) FILTER (WHERE fits) AS n, count(*) FILTER (WHERE NOT hand AND NOT disp) AS r FROM y GROUP BY kind, script) SELECT kind, script, path FROM y JOIN c USING (kind, script) WHERE kind = 'all' OR CASE WHEN n >= 5 THEN fits WHEN r > 0 THEN NOT hand AND NOT disp ELSE true END",
    "char_fonts": f"WITH {COVERED.sql('c')} SELECT char, string_agg(font, ',' ORDER BY font) AS fonts FROM c WHERE char IN ('a', 'b', 'c') GROUP BY char",
    "renderable_tokens": "SELECT unnest(['a', 'क', '汉']) AS token",
    "cjk_checks": f"WITH {CJK.sql('c')}, x AS (SELECT word, regexp_matches(word, '[{S.HAN}]') AS han, regexp_matches(word, '[{S.KANA}]') AS kana, regexp_extract_all(word, '[{S.HAN}]') AS h FROM c) SELECT word, han, kana, length(word) BETWEEN 2 AND 15 AND (han OR kana) AS valid, array_to_string(list_filter(h, lambda v, i: list_position(h, v) = i), '') AS chars, CASE WHEN kana AND NOT han THEN 'japanese' ELSE 'han_kana' END AS list FROM x",
    "han_coverage": f"WITH {CJK.sql('c')}, h AS (SELECT DISTINCT unnest(regexp_extract_all(word, '[{S.HAN}]')) AS c FROM c), n AS (SELECT count(*) FILTER (WHERE unicode(c) >= 19968) AS u, count(*) FILTER (WHERE unicode(c) < 19968) AS e FROM h) SELECT unnest(['unified', 'extension', 'all']) AS block, unnest([u, e, u + e]) AS covered, unnest([20992, 6592, 27584])::BIGINT AS universe, unnest([round(100.0 * u / 20992, 4), round(100.0 * e / 6592, 4), round(100.0 * (u + e) / 27584, 4)]) AS percent FROM n",
    "listed_words": f"WITH {LISTED.sql('l')} SELECT script, word FROM l WHERE length(word) BETWEEN 2 AND 15 AND CASE script " + " ".join(f"WHEN '{s}' THEN regexp_matches(word, '[{S.members(S.SCRIPTS[s])}]') AND regexp_matches(word, '{_LIST_CLASS(s)}')" for s in ("devanagari", "thai", "latin")) + " END",
    "word_lists": "SELECT * FROM (VALUES ('latin', 'naïve'), ('emoji', 'emoji'), ('greek', ''), ('thai', 'สวัสดี')) t(script, words)",
    "running_words": "SELECT * FROM (VALUES (1, 0, 'Привет'), (1, 1, 'мир'), (1, 2, 'мир-труд'), (1, 3, 'мир…'), (2, 0, 'мир'), (2, 1, 'да'), (4, 0, 'да'), (4, 1, 'нет'), (4, 2, 'тег')) t(id, place, word)",
    "token_rules": " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS words, coalesce(sum(length(word)), 0)::BIGINT AS chars FROM (SELECT DISTINCT {_TOKENS(v)} FROM documents)" for k, v in T.ENDS_BESIDE.items()),
    "vocabulary_pairs": "WITH c AS (SELECT word, count(*) AS k FROM (SELECT unnest(regexp_split_to_array(text, '[\\s\\x0b]+')) AS word FROM documents) WHERE word <> '' GROUP BY word), p AS (SELECT substring(word, i, 2) AS pair, k FROM (SELECT word, k, unnest(range(1, length(word))) AS i FROM c)) SELECT pair, sum(k)::BIGINT AS n FROM p WHERE regexp_full_match(pair, '[A-Za-z0-9]{2}') AND NOT regexp_full_match(pair, '[0-9]{2}') GROUP BY pair ORDER BY n DESC, pair LIMIT 30",
    "wiki_links": f"WITH {MARKUP.sql('m')} SELECT DISTINCT id, trim(unnest(regexp_extract_all(markup, '\\[\\[([^\\]|]+)', 1))) AS target FROM m",
    "table_cells": f"WITH {MARKUP.sql('m')} SELECT id, unnest(regexp_extract_all(html, '>([^<>]{{2,15}})</td>', 1)) AS cell FROM m",
    "json_texts": "SELECT * FROM (VALUES ('sentences', 'one'), ('sentences', 'two'), ('books', 'a.txt'), ('books', 'c.txt'), ('text', 'In the beginning'), ('text', '')) t(kind, text)",
    "label_files": "SELECT * FROM (VALUES ('text', 'a.png', 'first label'), ('text', 'b.png', 'second'), ('json', 'c.png', 'third'), ('words', 'a01-0', 'move'), ('words', 'a01-4', 'two')) t(kind, image, label)",
    "first_match": "SELECT * FROM (VALUES ('one', '/e/one.png'), ('two', '/d/two.jpg'), ('four', '/d/four.JPEG')) t(stem, path)",
    "label_bounds": f"WITH {LABELS.sql('l')} SELECT stem FROM l WHERE length(trim(label)) BETWEEN 1 AND 50",
    "normal_names": "SELECT * FROM (VALUES ('Hindi', 'devanagari'), ('bangla', 'bengali'), ('punjabi', 'gurmukhi'), ('tamil', 'tamil'), ('ORIYA', 'odia')) t(name, script)",
    "store_samples": f"WITH {STORE.sql('s')}, n AS (SELECT value::BIGINT AS n FROM s WHERE key = 'num-samples'), i AS (SELECT unnest(range(1, n + 1)) AS idx FROM n) SELECT idx, a.value AS image, b.value AS label FROM i JOIN s a ON a.key = 'image-' || lpad(idx::VARCHAR, 9, '0') JOIN s b ON b.key = 'label-' || lpad(idx::VARCHAR, 9, '0')",
    "shard_roundtrip": "SELECT CASE WHEN ((((('0x' || substr(h, 1, 8))::BIGINT % 1000) * 296 + ('0x' || substr(h, 9, 8))::BIGINT) % 1000 * 296 + ('0x' || substr(h, 17, 8))::BIGINT) % 1000 * 296 + ('0x' || substr(h, 25, 8))::BIGINT) % 1000 < 100 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents) GROUP BY 1",
    "article_cap": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50",
    "chosen_languages": "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('fr', 'de') GROUP BY lang",
    "padded_labels": "SELECT * FROM (VALUES ('latin', 'Naïve Čeština, 12!', 18, 18), ('emoji', 'ok «x»', 6, 6), ('latin', 'ab', 18, 2), ('latin', '日', 18, 0), ('greek', '日', 1, 0)) t(script, text, width, target_len)",
    "strict_numbers": "SELECT * FROM (VALUES ('then', '1,3,4'), ('hat', '7,5,6'), ('eth', '3,1')) t(word, ids)",
    "lab_pixels": f"WITH {PIXELS.sql('p')}, l AS (SELECT id, {_LIN('r')} AS x, {_LIN('g')} AS y, {_LIN('b')} AS z FROM p), c AS (SELECT id, (0.4124564 * x + 0.3575761 * y + 0.1804375 * z) / 0.95047 AS cx, 0.2126729 * x + 0.7151522 * y + 0.0721750 * z AS cy FROM l), f AS (SELECT id, {_ROOT('cx')} AS fx, {_ROOT('cy')} AS fy FROM c) SELECT id, least(255, greatest(0, floor((116 * fy - 16) / 100.0 * 255)))::INTEGER AS l, least(255, greatest(0, floor((500 * (fx - fy) + 128) / 255.0 * 255)))::INTEGER AS a FROM f",
    "readable_inks": f"WITH {INKS.sql('i')} SELECT id, abs(0.299 * ir + 0.587 * ig + 0.114 * ib - 0.299 * pr - 0.587 * pg - 0.114 * pb) > 60 AS readable FROM i",
    "filler_words": "WITH s(script, c, v, j) AS (VALUES " + ", ".join(f"('{k}', {list(c)!r}, {list(v)!r}, '{j}')" for k, (c, v, j) in FILLED.items()) + ") SELECT DISTINCT script, word FROM (SELECT script, unnest(c) || v2 AS word FROM (SELECT script, c, unnest(v) AS v2 FROM s) UNION ALL SELECT script, a || j || unnest(c[1:5]) FROM (SELECT script, c, j, unnest(c[1:10]) AS a FROM s) UNION ALL SELECT script, c[1] || unnest(v) || c[2] FROM s)",
    "mixed_marks": f"WITH {_W} SELECT word, {_mixed_sql(L.MIXES | L.LATIN_MIXES)} AS mixed, {_mixed_sql(L.MIXES)} AS mixed_any FROM (SELECT DISTINCT word FROM bw)",
    "counted_vocabulary": f"WITH {_W}, p AS (SELECT substring(word, i, 2) AS pair FROM (SELECT word, unnest(range(1, length(word))) AS i FROM w)), b AS (SELECT pair, row_number() OVER (ORDER BY n DESC, pair) AS k FROM (SELECT pair, count(*) AS n FROM p WHERE regexp_full_match(pair, '[A-Za-z0-9]{{2}}') GROUP BY pair)) SELECT 0 AS token_id, '∅' AS token UNION ALL SELECT i::INTEGER, chr((31 + i)::INTEGER) FROM range(1, 96) t(i) UNION ALL SELECT (95 + k)::INTEGER, pair FROM b WHERE k <= 75",
    "grown_list": f"WITH {_W}, cw AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[{_GAPS}]+'), lambda w: length(w) BETWEEN 2 AND 15)) AS word FROM conversations) SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM cw) WHERE word NOT IN (SELECT word FROM bw)",
    "filler_growth": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {len({x + y for x in c for y in v} | {x + j + y for x in c[:10] for y in c[:5]} | {c[0] + y + c[1] for y in v})}::BIGINT)" for k, (c, v, j) in FILLED.items()) + ") t(script, added)",
    "named_functions": f"SELECT *, clean AS form FROM (VALUES (1, 'Привет», мир! hello (мир-труд) 12 мир'), (2, {_literal(RUNNING.rows[1][1])}), (3, ''), (4, 'да\" ''нет'' #тег#')) t(id, clean)",
    "spell_correct": f"WITH {_SPELL} SELECT text, confidence, result, corrected FROM r",
    "spell_counters": f"WITH {_SPELL} SELECT count(*) FILTER (WHERE corrected) AS corrected, count(*) FILTER (WHERE confidence < 0.5) AS unsure, count(*) AS total FROM r",
    "ink_pixels": f"WITH {PICTURES.sql('p')}, g AS (SELECT id, width AS w, list_transform(range(1, len(r) + 1), lambda i: 0.299::DOUBLE * r[i] + 0.587::DOUBLE * g[i] + 0.114::DOUBLE * b[i]) AS x FROM p), k AS (SELECT *, list_sort([x[1], x[w], x[len(x) - w + 1], x[len(x)]]) AS c FROM g), n AS (SELECT id, coalesce(len(list_filter(x, lambda v: abs(v - (c[2] + c[3]) / 2) > 30)), 0) AS n FROM k) SELECT id, n, n >= 2 AS inked FROM n",
    "common_entries": f"WITH {ARRAYS.sql('t')} SELECT id, coalesce(len(list_filter(a, lambda v: v IS NOT NULL AND list_contains(b, v))) > 0, FALSE) AS any FROM t",
    "syllable_grid": f"SELECT x || y || z AS word FROM (SELECT unnest({_literal(GRID[0])}) AS x), (SELECT unnest({_literal(GRID[1])}) AS y), (SELECT unnest({_literal(GRID[2])}) AS z)",
    "ideograph_slots": f"WITH {HAN_COUNTS.sql('t')}, c AS (SELECT unnest(regexp_extract_all(word, '[{S.HAN}]')) AS char, n FROM t), s AS (SELECT char, sum(n)::BIGINT AS n FROM c WHERE char NOT IN ('一', 'ー') GROUP BY char) SELECT char, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, char) AS rank FROM s) WHERE rank <= 3",
    "list_outputs": f"WITH {CJK.sql('c')}, x AS (SELECT DISTINCT word, regexp_matches(word, '[{S.HAN}]') AS han, regexp_matches(word, '[{S.KANA}]') AS kana FROM c) SELECT CASE WHEN kana AND NOT han THEN 'japanese' ELSE 'han_kana' END AS list, word FROM x WHERE length(word) BETWEEN 2 AND 15 AND (han OR kana)",
}
QUERIES = {name: globals()[name] for name in SQL}
