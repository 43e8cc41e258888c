"""Queries over dimensions, masks, checks, draws and summary figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import lookup as L
from corpusloom.operators import scoring as S
from corpusloom.plans.corpus_queries import _LETTERS, _W
from corpusloom.plans.dataset_queries import _MD5
from corpusloom.sources.tables import table


def hierarchy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of languages, of sources, and of sources inside their language."""
    return L.local_ids(table(spark, sf_dir, "documents"), "lang", "source")


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality label, or -1."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return L.looked_up(table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id", "quality", -1)


def covering_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item, the languages whose documents have all its letters."""
    of = lambda t, k: table(spark, sf_dir, t).select(k, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"[{_LETTERS}]"), F.lit(0)))).alias("c"))
    return L.covering(of("benchmark", "item_id"), of("documents", "lang"), "item_id", "lang", "c")


def char_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of each letter."""
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"[{_LETTERS}]"), F.lit(0)))).alias("c")).distinct()
    return L.holders_of(rows, "c", "lang")


def document_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents too short, too long, without a letter, or with a wrong character count; several issues a row."""
    docs = table(spark, sf_dir, "documents")
    checks = {"short": F.length("text") < 100, "long": F.length("text") > 10000, "no_letter": ~F.col("text").rlike(f"[{_LETTERS}]"), "count": F.length("text") != F.col("n_chars")}
    return L.issues(docs, "doc_id", checks)


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, greatest, mean and middle length by language."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("greatest"), F.round(F.avg("n_chars"), 4).alias("mean"), F.median("n_chars").alias("middle"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and distinct characters beyond ASCII of each source."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.groupBy("source").agg(F.sum(F.size(F.split("text", "\n"))).alias("n_lines"))
    odd = docs.select("source", F.explode(F.array_distinct(T.chars(F.regexp_replace("text", r"[\x00-\x7F ]", "")))).alias("c")).groupBy("source").agg(F.count_distinct("c").alias("n_chars"))
    return lines.join(odd, "source", "left").select("source", "n_lines", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


def fusion_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary of 400: all letters in order, then the most frequent pairs of letters inside words."""
    words = T.word_rows(table(spark, sf_dir, "documents"))
    words = C.count_by(words, "word")
    base = C.char_counts(words).select(F.col("char").alias("token"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n"))
    pairs = C.pair_counts(words).select(F.col("pair").alias("token"), F.lit(1).alias("kind"), "n")
    best = base.union(pairs).orderBy("kind", F.desc("n"), "token").limit(399)
    from pyspark.sql import Window

    return best.select(F.row_number().over(Window.orderBy("kind", F.desc("n"), "token")).alias("token_id"), "token")


def style_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a style drawn with weights 7, 2 and 1."""
    return table(spark, sf_dir, "documents").select("doc_id", L.weighted_pick(F.col("doc_id"), {"plain": 7, "bold": 2, "slanted": 1}, "style").alias("style"))


def masked_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the largest of each vector's even places."""
    even = F.transform(F.col("embedding"), lambda _, i: i % 2 == 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", S.masked_argmax(F.col("embedding").cast("array<double>"), even).cast("long").alias("best"))


def vector_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each vector that stand out from its corners."""
    return table(spark, sf_dir, "embeddings").select("vec_id", L.contrast(F.col("embedding"), 0.1).cast("long").alias("n"))


def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length over languages of the mean over their sources of the mean over documents."""
    per = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.avg("n_chars").alias("m")).groupBy("lang").agg(F.avg("m").alias("m"))
    return per.agg(F.round(F.avg("m"), 4).alias("mean"))


def conditional_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of labelled documents whose length guesses quality right, the share that isn't toxic, by language."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id").filter((F.col("n_chars") > 2000).cast("int") == F.col("quality"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("toxic") == 0, 1.0).otherwise(0.0)), 6).alias("clean"))


def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of page titles, and pages that have them."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    parts = table(spark, sf_dir, "pages").select("page_id", F.explode(T.title_parts(title)).alias("part"))
    return parts.groupBy("part").agg(F.count_distinct("page_id").alias("n_pages"))


def merged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of documents, benchmark and conversations, and how many of the three hold each."""
    tables = [T.word_rows(table(spark, sf_dir, t)).distinct() for t in ("documents", "benchmark", "conversations")]
    return tables[0].union(tables[1]).union(tables[2]).groupBy("word").agg(F.count(F.lit(1)).alias("tables"))


QUERIES = {f.__name__: f for f in (hierarchy_ids, label_lookup, covering_langs, char_langs, document_issues, length_stats, source_lines, fusion_topn, style_draw, masked_best, vector_contrast, mean_of_means, conditional_accuracy, title_parts, merged_words)}

_OF = f"unnest(regexp_extract_all(text, '[{_LETTERS}]')) AS c"
SQL = {
    "hierarchy_ids": "WITH p AS (SELECT DISTINCT lang, source FROM documents) SELECT lang, source, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS group_id, (row_number() OVER (ORDER BY lang, source) - 1)::INTEGER AS member_id, (row_number() OVER (PARTITION BY lang ORDER BY source) - 1)::INTEGER AS local_id FROM p",
    "label_lookup": "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id)",
    "covering_langs": f"WITH i AS (SELECT DISTINCT item_id, {_OF} FROM benchmark), l AS (SELECT DISTINCT lang, {_OF} FROM documents), n AS (SELECT item_id, count(DISTINCT c) AS need FROM i GROUP BY item_id) SELECT item_id, lang FROM (SELECT item_id, lang, count(DISTINCT c) AS have FROM i JOIN l USING (c) GROUP BY item_id, lang) JOIN n USING (item_id) WHERE have = need",
    "char_langs": f"SELECT c, string_agg(lang, ',' ORDER BY lang) AS holders FROM (SELECT DISTINCT lang, {_OF} FROM documents) GROUP BY c",
    "document_issues": f"WITH x AS (SELECT doc_id, [CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN length(text) > 10000 THEN 'long' END, CASE WHEN NOT regexp_matches(text, '[{_LETTERS}]') THEN 'no_letter' END, CASE WHEN length(text) <> n_chars THEN 'count' END] AS v FROM documents) SELECT doc_id, issue FROM (SELECT doc_id, unnest(v) AS issue FROM x) WHERE issue IS NOT NULL",
    "length_stats": "SELECT lang, min(n_chars) AS least, max(n_chars) AS greatest, round(avg(n_chars), 4) AS mean, median(n_chars) AS middle FROM documents GROUP BY lang",
    "source_lines": "WITH l AS (SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents GROUP BY source), o AS (SELECT source, count(DISTINCT c) AS n_chars FROM (SELECT source, unnest(regexp_extract_all(text, '[^\\x00-\\x7F\\x{00a0}]')) AS c FROM documents) GROUP BY source) SELECT source, n_lines, coalesce(n_chars, 0) AS n_chars FROM l LEFT JOIN o USING (source)",
    "fusion_topn": f"WITH {_W}, b AS (SELECT DISTINCT unnest(regexp_extract_all(word, '(?s).')) AS token FROM w), p AS (SELECT token, count(*) AS n FROM (SELECT substring(word, i, 2) AS token FROM (SELECT word, unnest(range(1, length(word))) AS i FROM w)) GROUP BY token), u AS (SELECT token, 0 AS kind, 0 AS n FROM b UNION ALL SELECT token, 1, n FROM p) SELECT token_id::INTEGER AS token_id, token FROM (SELECT row_number() OVER (ORDER BY kind, n DESC, token) AS token_id, token FROM u) WHERE token_id <= 399",
    "style_draw": f"SELECT doc_id, CASE WHEN u < 700 THEN 'plain' WHEN u < 900 THEN 'bold' ELSE 'slanted' END AS style FROM (SELECT doc_id, {_MD5} AS u FROM (SELECT doc_id, md5(doc_id || ':style') AS h FROM documents))",
    "masked_best": "WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) SELECT vec_id, arg_min(i, (-x, i)) AS best FROM e WHERE i % 2 = 0 GROUP BY vec_id",
    "vector_contrast": "WITH c AS (SELECT vec_id, embedding, list_sort([embedding[1], embedding[2], embedding[-2], embedding[-1]]) AS k FROM embeddings) SELECT vec_id, len(list_filter(embedding, lambda x: abs(x::DOUBLE - (k[2]::DOUBLE + k[3]::DOUBLE) / 2) > 0.1))::BIGINT AS n FROM c",
    "mean_of_means": "SELECT round(avg(m), 4) AS mean FROM (SELECT lang, avg(m) AS m FROM (SELECT lang, source, avg(n_chars) AS m FROM documents GROUP BY lang, source) GROUP BY lang)",
    "conditional_accuracy": "SELECT lang, count(*) AS n, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS clean FROM labels JOIN documents USING (doc_id) WHERE (n_chars > 2000)::INTEGER = quality GROUP BY lang",
    "title_parts": r"WITH t AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\([^()]*\)', '', 'g')) AS title FROM pages) SELECT part, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(list_prepend(title, regexp_split_to_array(title, '[\p{Pd}/·,、\s]+'))) AS part FROM t) WHERE part <> '' GROUP BY part",
    "merged_words": f"WITH {_W}, cw AS (SELECT unnest(list_filter(regexp_split_to_array(text, '[\\s\\x0b\\d[:punct:]\\x{{00a0}}\\x{{00a1}}\\x{{00ab}}\\x{{00bb}}\\x{{00bf}}\\x{{200b}}-\\x{{200d}}\\x{{2010}}-\\x{{2027}}]+'), lambda w: length(w) BETWEEN 2 AND 15)) AS word FROM conversations) SELECT word, count(*) AS tables FROM (SELECT DISTINCT word FROM w UNION ALL SELECT DISTINCT word FROM bw UNION ALL SELECT DISTINCT word FROM cw) GROUP BY word",
}
