"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

The corpus is reduced to (length, documents) once; every question on context limits is then answered
from that histogram. Suffix sums run inside blocks of lengths and over the block totals, so that no
task meets more than one block or one row per block, however many different lengths there are.

Nulls and empty texts have length 0. Very long texts are encoded whole. Repeated rows count each time. An empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import column, read, written

#: A byte-level BPE as ranks, read by the workers' own tokenizer library.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary splits a text before merging: contractions, letters, numbers, other marks, white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Lengths of one block of the suffix sums.
BLOCK = 128


def ranks(path: str = RANKS) -> dict[bytes, int]:
    """Pieces and ranks of a vocabulary file: lines of base64 and a number."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def with_length(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks(path))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("corpusloom", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pa.record_batch({"n_tokens": pa.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())})

    return docs.select(column(docs, "text", "string").alias("text")).mapInArrow(lengths, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs): documents of each length; sums of each task first."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs: documents and tokens in all, up to it and beyond it, and tokens left of all documents cut to it.

    kept_tokens = tokens of documents of at most n_tokens + n_tokens * documents beyond. The answers for a
    limit between two lengths follow from the row of the next lower length.
    """
    hist = hist.withColumns({"block": F.floor(F.col("n_tokens") / block), "tokens": F.col("n_tokens") * F.col("n_docs")})
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    ever = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"), *(F.sum(c).over(ever).alias(f"{c}_all") for c in "dt"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.join(blocks, "block").withColumns({c: F.coalesce(F.sum(x).over(within), F.lit(0)) + F.col(f"{k}_above") for c, x, k in (("docs_beyond", "n_docs", "d"), ("tokens_beyond", "tokens", "t"))})
    return hist.select("n_tokens", "n_docs", (F.col("d_all") - F.col("docs_beyond")).alias("docs_up_to"), "docs_beyond", F.col("d_all").alias("all_docs"), F.col("t_all").alias("all_tokens"), (F.col("t_all") - F.col("tokens_beyond") + F.col("n_tokens") * F.col("docs_beyond")).alias("kept_tokens"))


def quantile(sums: DataFrame, q: float) -> Column:
    """An aggregate over suffix_sums(): the least length that at least the share q of documents do not exceed."""
    return F.min(F.when(F.col("docs_up_to") >= F.lit(q) * F.col("all_docs"), F.col("n_tokens")))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """(kept_tokens): tokens left when every document is cut to the limit."""
    at = sums.filter(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("n_tokens", "docs_beyond", "kept_tokens"), "n_tokens").alias("x"))
    some = sums.agg(F.max("all_docs").alias("n"))
    return at.crossJoin(some).select(F.coalesce(F.col("x.kept_tokens") + (limit - F.col("x.n_tokens")) * F.col("x.docs_beyond"), limit * F.col("n"), F.lit(0)).cast("long").alias("kept_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of context limits: a row for each encoded length of `documents`, which are encoded once."""
    return suffix_sums(written(histogram(with_length(read(spark, sf_dir, "documents"))), "lengths"))
