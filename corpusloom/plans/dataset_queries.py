"""Queries that prepare datasets and score results. Guesses are stand-ins, as the tables hold no model output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import corpus as C
from corpusloom.operators import planning as P
from corpusloom.operators import scoring as S
from corpusloom.plans.corpus_queries import _W
from corpusloom.sources.tables import table

_MD5 = "((((('0x' || substr(h, 1, 8))::BIGINT % 1000) * 296 + ('0x' || substr(h, 9, 8))::BIGINT) % 1000 * 296 + ('0x' || substr(h, 17, 8))::BIGINT) % 1000 * 296 + ('0x' || substr(h, 25, 8))::BIGINT) % 1000"


def md5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train or validation by the MD5 of the id."""
    return table(spark, sf_dir, "documents").select("doc_id", T.md5_mod(F.col("doc_id").cast("string")).cast("long").alias("bucket"), P.split_of(F.col("doc_id").cast("string"), 0.1).alias("split"))


def stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 documents of each language."""
    return P.first_of_each(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 500)


def val_capped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 validation documents of each source; the rest trains."""
    return P.capped_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 0.1, 20)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = C.count_by(table(spark, sf_dir, "documents"), "lang", "source")
    return P.targets(sizes, "lang", "n", 20000)


def target_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples for each language and source by three rules."""
    return _plan(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in ("balanced", "by_root")})


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each target."""
    return P.chunk_rows(_plan(spark, sf_dir), "by_root", 4, 48).select("lang", "source", F.col("chunk").cast("long").alias("chunk"), F.col("rows").cast("long").alias("rows"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.width_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 32)


def width_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 documents of like length."""
    return _batches(spark, sf_dir)


def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 documents of like length, mixed inside buckets of 10 batches; the last batch goes if it isn't full."""
    return P.shuffled_width_batches(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 8).withColumn("turn", F.col("turn").cast("int"))


def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest size of those batches' kin of 32."""
    return P.batch_sizes(_batches(spark, sf_dir))


def pad_to_batch_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document of a batch lacks of the longest, in multiples of 4."""
    return P.padded(_batches(spark, sf_dir), "n_chars").select("doc_id", "batch", F.col("padded").cast("long").alias("padded"), F.col("pad").cast("long").alias("pad"))


def restored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts batched by length, and each batch's result (the longest of it) back in the order of ids."""
    batches = _batches(spark, sf_dir).withColumn("at", F.col("doc_id"))
    results = P.padded(batches, "n_chars", 1).select("doc_id", F.col("padded").cast("long").alias("longest"))
    return P.restored(batches, results, "doc_id", "at")


def budget_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches under a budget of padded characters."""
    return P.packed(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 100_000, 64)


def greedy_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters dealt to the 4 most frequent letters, the nearest code point first, 24 places each."""
    chars = C.char_counts(C.count_by(T.word_rows(table(spark, sf_dir, "documents")), "word"))
    leaves = chars.orderBy(F.desc("n"), "char").limit(4).select(F.col("char").alias("leaf"))
    scores = chars.crossJoin(F.broadcast(leaves)).withColumn("score", -F.abs(F.ascii("char") - F.ascii("leaf")))  # four rows
    return P.greedy_slots(scores, "char", "n", "leaf", "score", 24).withColumnRenamed("item", "char")


def similar_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors dealt to class means, the most alike first, 24 places each."""
    vectors = table(spark, sf_dir, "embeddings")
    centers = S.centroids(vectors, "label", "embedding")
    scores = S.all_cosines(vectors, centers.select(F.col("label").alias("class"), F.col("center").alias("embedding")), "vec_id", "class", "embedding")
    return P.greedy_slots(scores.withColumn("turn", -F.col("vec_id")), "vec_id", "turn", "leaf", "cosine", 24).withColumnRenamed("item", "vec_id")


def all_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with every class mean, by cosine."""
    vectors = table(spark, sf_dir, "embeddings")
    return S.all_cosines(vectors, S.centroids(vectors, "label", "embedding").select(F.col("label").alias("class"), F.col("center").alias("embedding")), "vec_id", "class", "embedding")


def ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's code points modulo 4 as a best path, collapsed."""
    frames = F.transform(T.chars(F.col("text")), lambda c: F.ascii(c) % 4)
    return table(spark, sf_dir, "benchmark").select("item_id", frames.alias("f")).select("item_id", F.array_join(S.collapsed(F.col("f")).cast("array<string>"), "").alias("path"))


def edit_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character accuracy of each benchmark item's ASCII letters against the next item's."""
    own = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^a-z]", "").alias("truth"))
    pairs = own.join(own.select((F.col("item_id") - 1).alias("item_id"), F.col("truth").alias("guess")), "item_id")
    return S.edit_accuracy(pairs, "truth", "guess", "item_id").select("item_id", F.col("chars").cast("long").alias("chars"), F.col("edits").cast("long").alias("edits"), "accuracy")


def accuracy_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often "longer than 2000" equals the quality label: overall, by language, by language and source."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return S.accuracy_levels(rows, (F.col("n_chars") > 2000).cast("int") == F.col("quality"), "lang", "source")


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return S.near_centers(vectors, S.centroids(vectors, "label", "embedding"), "vec_id", "embedding", "label")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of vectors against the label of the nearest class mean."""
    return S.confusion(_guesses(spark, sf_dir), "label", "guess")


def top_misclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent confusions."""
    return S.confusion(_guesses(spark, sf_dir), "label", "guess").filter("label <> guess").orderBy(F.desc("n"), "label", "guess").limit(10)


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to each class mean."""
    vectors = table(spark, sf_dir, "embeddings")
    centers = S.centroids(vectors, "label", "embedding").withColumnRenamed("label", "class")
    near = S.all_cosines(vectors, centers.withColumnRenamed("center", "embedding"), "vec_id", "class", "embedding").withColumnRenamed("leaf", "class")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("cosine"), "vec_id"))
    return near.withColumn("rank", rank).filter("rank <= 10")


_PLAN = "p AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source), t AS (SELECT *, 20000::BIGINT AS fixed, floor(20000 / count(*) OVER (PARTITION BY lang))::BIGINT AS balanced, floor(20000 * sqrt(n / min(n) OVER (PARTITION BY lang)))::BIGINT AS by_root FROM p)"
_BATCH = "b AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS batch FROM documents)"
_SLOTS = "list_transform(used, lambda u, j: u + CASE WHEN j = list_position(sc, list_max(sc)) THEN 1 ELSE 0 END)"
_CENTERS = "e AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY label, i), c AS (SELECT label AS class, list(x ORDER BY i) AS v FROM m GROUP BY label), s AS (SELECT class, vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS cosine FROM embeddings, c)"
_GUESS = f"{_CENTERS}, g AS (SELECT label, guess FROM (SELECT label, class AS guess, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, class) AS r FROM s) WHERE r = 1), f AS (SELECT label, guess, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM (SELECT label, guess, count(*) AS n FROM g GROUP BY label, guess))"

QUERIES = {f.__name__: f for f in (md5_split, stratified_cap, val_capped_split, target_plan, chunk_plan, width_buckets, shuffled_batches, batch_stats, pad_to_batch_max, restored_order, budget_packing, greedy_slots, similar_slots, all_cosines, ctc_collapse, edit_accuracy, accuracy_grouping_sets, confusion_matrix, top_misclass, cosine_topk)}

SQL = {
    "md5_split": f"SELECT doc_id, bucket, CASE WHEN bucket < 100 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, {_MD5} AS bucket FROM (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents))",
    "stratified_cap": "SELECT doc_id, lang, rank::INTEGER AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 500",
    "val_capped_split": f"WITH v AS (SELECT doc_id, source, {_MD5} < 100 AS val FROM (SELECT doc_id, source, md5(doc_id::VARCHAR) AS h FROM documents)) SELECT doc_id, source, CASE WHEN val AND row_number() OVER (PARTITION BY source, val ORDER BY doc_id) <= 20 THEN 'val' ELSE 'train' END AS split FROM v",
    "target_plan": f"WITH {_PLAN} SELECT * FROM t",
    "chunk_plan": f"WITH {_PLAN}, k AS (SELECT lang, source, by_root, least(5000, greatest(500, floor(by_root / 12)))::BIGINT AS size FROM t), x AS (SELECT *, unnest(range(greatest(1, ceil(by_root / size)::BIGINT))) AS chunk FROM k) SELECT lang, source, chunk, least(size, by_root - chunk * size) AS rows FROM x",
    "width_buckets": f"WITH {_BATCH} SELECT doc_id, n_chars, batch FROM b",
    "shuffled_batches": "WITH p AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 80 AS bucket, count(*) OVER () AS total FROM documents), k AS (SELECT bucket, row_number() OVER (ORDER BY md5('bucket:' || bucket), bucket) - 1 AS b FROM (SELECT DISTINCT bucket FROM p WHERE bucket < total // 80)), m AS (SELECT doc_id, n_chars, total, (coalesce(b, total // 80) * 80 + row_number() OVER (PARTITION BY p.bucket ORDER BY md5('row:' || doc_id), doc_id) - 1) // 8 AS batch FROM p LEFT JOIN k ON p.bucket = k.bucket), f AS (SELECT * FROM m WHERE total - batch * 8 >= 8), t AS (SELECT batch, row_number() OVER (ORDER BY md5('batch:' || batch), batch) - 1 AS turn FROM (SELECT DISTINCT batch FROM f)) SELECT batch, doc_id, n_chars, turn::INTEGER AS turn FROM f JOIN t USING (batch)",
    "batch_stats": f"WITH {_BATCH} SELECT count(*) AS batches, min(n) AS least, max(n) AS greatest FROM (SELECT count(*) AS n FROM b GROUP BY batch)",
    "pad_to_batch_max": f"WITH {_BATCH}, w AS (SELECT *, (ceil(max(n_chars) OVER (PARTITION BY batch) / 4.0) * 4)::BIGINT AS padded FROM b) SELECT doc_id, batch, padded, padded - n_chars AS pad FROM w",
    "restored_order": f"WITH {_BATCH} SELECT doc_id, doc_id AS at, batch, max(n_chars) OVER (PARTITION BY batch) AS longest FROM b",
    "budget_packing": "WITH RECURSIVE o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS i FROM documents), p AS (SELECT i, doc_id, n_chars, 0::BIGINT AS batch, 1::BIGINT AS held FROM o WHERE i = 1 UNION ALL SELECT o.i, o.doc_id, o.n_chars, CASE WHEN held >= 64 OR (held + 1) * o.n_chars > 100000 THEN batch + 1 ELSE batch END, CASE WHEN held >= 64 OR (held + 1) * o.n_chars > 100000 THEN 1 ELSE held + 1 END FROM p JOIN o ON o.i = p.i + 1) SELECT doc_id, n_chars, batch FROM p",
    "greedy_slots": f"WITH RECURSIVE {_W}, k AS (SELECT char, count(*) AS n FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS char FROM w) GROUP BY char), l AS (SELECT list(char ORDER BY char) AS leaves FROM (SELECT char FROM k ORDER BY n DESC, char LIMIT 4)), o AS (SELECT char, row_number() OVER (ORDER BY n DESC, char) AS i FROM k), s AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS char, NULL::VARCHAR AS leaf, 0 AS slot, [0, 0, 0, 0] AS used UNION ALL SELECT i, char, leaves[list_position(sc, list_max(sc))], used[list_position(sc, list_max(sc))], {_SLOTS} FROM (SELECT o.i, o.char, used, leaves, list_transform(leaves, lambda x, j: CASE WHEN used[j] < 24 THEN -abs(unicode(x) - unicode(o.char)) ELSE -9999999 END) AS sc FROM s JOIN o ON o.i = s.i + 1, l WHERE o.i <= 96)) SELECT char, leaf, slot FROM s WHERE i > 0",
    "similar_slots": f"WITH RECURSIVE {_CENTERS}, l AS (SELECT list(class ORDER BY class) AS leaves FROM c), o AS (SELECT vec_id, list(cosine ORDER BY class) AS scores, row_number() OVER (ORDER BY vec_id) AS i FROM s GROUP BY vec_id), g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS vec_id, NULL::INTEGER AS leaf, 0 AS slot, list_transform(leaves, lambda x: 0) AS used FROM l UNION ALL SELECT i, vec_id, leaves[list_position(sc, list_max(sc))], used[list_position(sc, list_max(sc))], {_SLOTS} FROM (SELECT o.i, o.vec_id, used, leaves, list_transform(scores, lambda x, j: CASE WHEN used[j] < 24 THEN x ELSE -9.0 END) AS sc FROM g JOIN o ON o.i = g.i + 1, l WHERE o.i <= 24 * len(leaves))) SELECT vec_id, leaf, slot FROM g WHERE i > 0",
    "all_cosines": f"WITH {_CENTERS} SELECT vec_id, class AS leaf, cosine FROM s",
    "ctc_collapse": "WITH f AS (SELECT item_id, list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c) % 4) AS f FROM benchmark) SELECT item_id, array_to_string(list_filter(f, lambda x, i: x <> 0 AND (i = 1 OR x <> f[i - 1])), '') AS path FROM f",
    "edit_accuracy": "WITH o AS (SELECT item_id, regexp_replace(text, '[^a-z]', '', 'g') AS t FROM benchmark) SELECT a.item_id, length(a.t) AS chars, levenshtein(a.t, b.t) AS edits, round(greatest(0, length(a.t) - levenshtein(a.t, b.t)) / greatest(length(a.t), 1), 6) AS accuracy FROM o a JOIN o b ON b.item_id = a.item_id + 1",
    "accuracy_grouping_sets": "SELECT lang, source, grouping(lang, source)::INTEGER AS level, count(*) AS n, round(sum(CASE WHEN (n_chars > 2000)::INTEGER = quality THEN 1 ELSE 0 END) / greatest(count(*), 1), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (lang, source))",
    "confusion_matrix": f"WITH {_GUESS} SELECT label, guess, n, share FROM f",
    "top_misclass": f"WITH {_GUESS} SELECT label, guess, n, share FROM f WHERE label <> guess ORDER BY n DESC, label, guess LIMIT 10",
    "cosine_topk": f"WITH {_CENTERS} SELECT class, vec_id, cosine, rank::INTEGER AS rank FROM (SELECT class, vec_id, cosine, row_number() OVER (PARTITION BY class ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 10",
}
