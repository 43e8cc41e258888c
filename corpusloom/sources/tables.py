"""Readers and writers: driver tables, word lists, frequency tables, dictionaries, feeds and sharded datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

WORD_FREQ = "word STRING, count BIGINT"
CLUSTER_FREQ = "cluster STRING, count BIGINT, cp_len INT"
MAPPING = "char STRING, slot INT, match STRING, score DOUBLE"


#: Tables of long rows, whose work is in each row: dealt to all cores where there are few files, with one row group each perhaps, and no more splits than cores.
LONG = frozenset(("documents", "pages"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    few = name in LONG and df.rdd.getNumPartitions() <= cores and 4 * len(df.inputFiles()) <= cores
    return df.repartition(cores) if few else df


def word_list(spark: SparkSession, *paths: str) -> DataFrame:
    """(word): distinct words of 2 to 15 characters that don't start with a digit, from files with a word a line."""
    words = spark.read.text(list(paths)).select(T.strip(F.regexp_replace("value", "�", "")).alias("word"))
    return words.filter(F.length("word").between(2, 15) & ~F.col("word").rlike(r"^\p{Nd}")).distinct()


def frequency_table(spark: SparkSession, path: str, schema: str = WORD_FREQ) -> DataFrame:
    """Tab-separated counts without a header; rows with too few columns are dropped."""
    return spark.read.csv(path, sep="\t", schema=schema, quote="", mode="DROPMALFORMED")


def mapping_table(spark: SparkSession, path: str) -> DataFrame:
    """Visual-similarity mapping, with a header."""
    return spark.read.csv(path, sep="\t", schema=MAPPING, header=True, quote="", mode="DROPMALFORMED")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word): entries of a spelling dictionary, flags after `/` cut, byte-order mark dropped, 2 to 25 characters."""
    words = spark.read.text(path).select(T.strip(F.split_part(F.regexp_replace("value", "^﻿", ""), F.lit("/"), F.lit(1))).alias("word"))
    return words.filter(F.length("word").between(2, 25)).distinct()


def cedict(spark: SparkSession, path: str) -> DataFrame:
    """(word): both forms of each entry, which are its first two fields, before the reading in brackets; comments skipped."""
    fields = F.split(F.split_part("value", F.lit("["), F.lit(1)), r"\s+")
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & F.col("value").contains("[") & (F.size(fields) >= 3))
    return lines.select(F.explode(F.array_distinct(F.slice(fields, 1, 2))).alias("word")).filter("word != ''").distinct()


def unihan(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(code_point, field, value) of lines `U+XXXX field value` for some fields."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.col("value").startswith("U+") & (F.size(parts) >= 3))
    return rows.select(F.conv(F.substring(parts[0], 3, 8), 16, 10).cast("int").alias("code_point"), parts[1].alias("field"), parts[2].alias("value")).filter(F.col("field").isin(fields))


def unihan_readings(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(char, readings): for each character the list of (field, value) that it has."""
    rows = unihan(spark, path, fields)
    char = F.decode(F.unhex(F.lpad(F.hex("code_point"), 8, "0")), "UTF-32")
    return rows.select(char.alias("char"), F.struct("field", "value").alias("r")).groupBy("char").agg(F.array_sort(F.collect_list("r")).alias("readings"))


def feed_texts(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """(text): titles, descriptions and summaries of RSS or Atom documents, tags stripped, longer than 5 characters."""
    nodes = [F.xpath(column, F.lit(f"//*[local-name()='{n}']/text()")) for n in ("title", "description", "summary", "content")]
    return feeds.select(F.explode(F.flatten(F.array(*nodes))).alias("text")).select(T.strip(T.without_tags(F.col("text"))).alias("text")).filter(F.length("text") > 5)


def write_counts(counts: DataFrame, path: str) -> None:
    """Tab-separated, the largest count first, in files that sort in that order."""
    names = counts.columns
    counts.orderBy(F.desc("count"), names[0]).write.mode("overwrite").csv(path, sep="\t", quote="")


def append_new(words: DataFrame, path: str) -> None:
    """Append to a Parquet word list the words that it lacks, in order."""
    from pyspark.errors import AnalysisException

    new = words.select("word").distinct()
    try:
        known = words.sparkSession.read.parquet(path)
    except AnalysisException:  # there is no list yet
        known = None
    (new if known is None else new.join(known, "word", "left_anti")).sortWithinPartitions("word").write.mode("append").parquet(path)


def write_lists(words: DataFrame, path: str) -> None:
    """Words by their `list`: a folder each, one word a line, each once, in order of code points through the files of a folder."""
    words.select("list", "word").distinct().repartitionByRange("list", "word").sortWithinPartitions("list", "word").write.mode("overwrite").partitionBy("list").text(path)


def write_shards(samples: DataFrame, path: str, rows: int = 5000) -> None:
    """Compressed shards of at most `rows` rows, a folder for each split."""
    samples.write.mode("overwrite").partitionBy("split").option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)


def write_chunks(samples: DataFrame, path: str, rows: int = 5000) -> None:
    """As write_shards, a folder for each split and chunk; chunks that are written again replace themselves, others stay."""
    samples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "chunk").option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)


def read_shards(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Samples of a split, whether its shards lie in one folder or in folders of chunks."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/split={split}")
    return rows.drop("split", "chunk")


def shard_files(spark: SparkSession, path: str, patterns: tuple[str, ...] = ("shard_*", "char_shard_*", "real_*")) -> DataFrame:
    """(turn, path) of files whose names match one of the patterns: in order of the patterns, then of the names."""
    found = None
    for k, p in enumerate(patterns):
        some = spark.read.format("binaryFile").option("pathGlobFilter", p).option("recursiveFileLookup", "true").load(path).select(F.lit(k).alias("turn"), "path")
        found = some if found is None else found.union(some)
    return found.groupBy("path").agg(F.min("turn").alias("turn")).select("turn", "path").orderBy("turn", "path")


def padded_samples(samples: DataFrame, numbers: str = "ids") -> DataFrame:
    """(..., ids, target_len): numbers of each script's samples followed by blanks up to the longest of the script, at least one."""
    from corpusloom.functions.codecs import padded_numbers

    longest = samples.groupBy("script").agg(F.greatest(F.lit(1), F.max(F.size(numbers))).alias("_w"))
    return samples.join(F.broadcast(longest), "script").withColumn("target_len", F.size(numbers)).withColumn(numbers, padded_numbers(F.col(numbers), F.col("_w"))).drop("_w")  # a row a script


def pairs_to_samples(pairs: DataFrame, first: int = 0) -> DataFrame:
    """(idx, image, label) of a key/value store read as rows (key, value): `image-000000001`, `label-000000001`, and `num-samples`.

    Numbers run from `first` (0 or 1) for num-samples of them; a sample without an image is left out.
    """
    total = pairs.filter("key = 'num-samples'").select(F.col("value").cast("string").cast("long").alias("total"))
    parts = pairs.select(F.regexp_extract("key", "^(image|label)-", 1).alias("kind"), F.regexp_extract("key", "-([0-9]{9})$", 1).alias("idx"), "value").filter("kind <> '' AND idx <> ''")
    whole = parts.groupBy(F.col("idx").try_cast("long").alias("idx")).agg(F.max(F.when(F.col("kind") == "image", F.col("value"))).alias("image"), F.max(F.when(F.col("kind") == "label", F.col("value"))).cast("string").alias("label"))
    return whole.join(F.broadcast(total), (F.col("idx") >= first) & (F.col("idx") < F.col("total") + first)).filter("image IS NOT NULL").select("idx", "image", "label")


def samples_to_pairs(samples: DataFrame) -> DataFrame:
    """(key, value) rows of samples (idx, image, label), with their number under `num-samples`."""
    name = lambda kind: F.concat(F.lit(kind + "-"), F.lpad(F.col("idx").cast("string"), 9, "0"))
    each = F.array(F.struct(name("image").alias("key"), F.col("image").alias("value")), F.struct(name("label").alias("key"), F.encode("label", "UTF-8").alias("value")))
    total = samples.agg(F.lit("num-samples").alias("key"), F.encode(F.count(F.lit(1)).cast("string"), "UTF-8").alias("value"))
    return samples.select(F.explode(each).alias("x")).select("x.*").union(total)


def labels_csv(spark: SparkSession, path: str, most: int = 20) -> DataFrame:
    """(image, label) of files of comma-separated rows without a header, labels of 1 to `most` characters."""
    rows = spark.read.csv(path, schema="image string, label string", mode="PERMISSIVE", escape='"')
    return rows.filter("label IS NOT NULL").filter(F.length("label").between(1, most))


def labels_text(lines: DataFrame, line: str = "value") -> DataFrame:
    """(image, label) of lines with a name, white space, and all else as the label."""
    parts = F.split(T.strip(F.col(line)), r"\s+", 2)
    return lines.filter(F.size(parts) == 2).select(parts[0].alias("image"), parts[1].alias("label"))


def labels_json(texts: DataFrame, text: str = "json") -> DataFrame:
    """(image, label) of JSON lists of objects with both fields; what is no such list gives nothing."""
    items = F.from_json(F.col(text), "array<struct<image: string, text: string>>")
    return texts.filter(F.ltrim(text).startswith("[")).select(F.explode(items).alias("x")).filter("x.image IS NOT NULL AND x.text IS NOT NULL").select("x.image", F.col("x.text").alias("label"))


def graded_words(lines: DataFrame, line: str = "value") -> DataFrame:
    """(id, word) of a word index: fields between white space, of which the second is `ok`; the last of at least nine is the word, of 2 to 15 characters."""
    parts = F.split(T.strip(F.col(line)), r"\s+")
    rows = lines.filter(~F.col(line).startswith("#")).select(parts.alias("p")).filter((F.size("p") >= 9) & (F.get("p", 1) == "ok"))
    return rows.select(F.get("p", 0).alias("id"), F.element_at("p", -1).alias("word")).filter(F.length("word").between(2, 15))


def label_words(labels: DataFrame, label: str = "label", most: int = 20) -> DataFrame:
    """(word): the parts of each label between white space, of 1 to `most` characters."""
    return labels.select(F.explode(F.split(T.strip(F.col(label)), r"\s+")).alias("word")).filter(F.length("word").between(1, most))


def json_sentences(replies: DataFrame, reply: str = "json") -> DataFrame:
    """(text) of the results of a sentence search, where there is any."""
    got = F.from_json(F.col(reply), "results array<struct<text: string>>")["results"]
    return replies.select(F.explode(got).alias("x")).select("x.text").filter("text <> ''")


def json_books(replies: DataFrame, reply: str = "json", most: int = 50) -> DataFrame:
    """(url) of each book's first plain-text file, in order of the reply, `most` of them."""
    got = F.from_json(F.col(reply), "results array<struct<formats: map<string, string>>>")["results"]
    plain = F.filter(F.map_entries(F.col("x.formats")), lambda e: e["key"].contains("text/plain") & e["value"].endswith(".txt"))
    books = replies.select(F.posexplode(got).alias("place", "x"))
    return books.select("place", F.get(plain, 0)["value"].alias("url")).filter("url IS NOT NULL").orderBy("place").limit(most).select("url")


def json_text(replies: DataFrame, reply: str = "json", name: str = "text") -> DataFrame:
    """(text) of one field of each reply; empty where it lacks it."""
    return replies.select(F.coalesce(F.get_json_object(reply, f"$.{name}"), F.lit("")).alias("text"))


def first_articles(articles: DataFrame, order: str, most: int) -> DataFrame:
    """The first articles of a stream of them: a cap that is the feature."""
    return articles.orderBy(order).limit(most)


def word_lists(lists: DataFrame, scripts: list[str]) -> DataFrame:
    """(script, words) for each script asked for: its distinct words in order, an empty list where there are none; of emoji the word `emoji`."""
    asked = lists.sparkSession.createDataFrame([(s,) for s in scripts], "script string")
    words = T.strip(F.regexp_replace("word", "\ufffd", ""))
    own = lists.select("script", words.alias("word")).filter(F.length("word").between(2, 15) & ~F.col("word").rlike(r"^\p{Nd}"))
    whole = own.groupBy("script").agg(F.array_sort(F.collect_set("word")).alias("words"))
    none = F.array().cast("array<string>")
    return asked.join(whole, "script", "left").select("script", F.when(F.col("script") == "emoji", F.array(F.lit("emoji"))).otherwise(F.coalesce("words", none)).alias("words"))


def save_vocabulary(tokens: DataFrame, path: str) -> None:
    """One JSON list of the tokens (token_id, token) in order of their numbers."""
    from corpusloom.operators.corpus import as_array

    as_array(tokens, "token", "token_id").select(F.to_json("tokens").alias("value")).write.mode("overwrite").text(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token_id, token) of a JSON list; the first has the number 0."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("token_id", "token"))
