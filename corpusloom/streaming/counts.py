"""Incremental counts with Structured Streaming: windowed event counts, and word lists that grow by what is new."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.ordering import shared_folder


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, width: str, late: str) -> DataFrame:
    """(window_start, kind, n, total) of tumbling windows over a stream or a table."""
    was = dict(events.dtypes)[time]
    if events.isStreaming:  # a watermark asks for this type
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = events.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("w.start").cast(was).alias("window_start"), kind, "n", "total")


def drained(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream of updated aggregates over all input there is; the last value of each key.

    Every micro-batch writes its updates with its number to the shared folder, so a repeated batch overwrites itself.
    """
    spark = counts.sparkSession
    place = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    fields = [c for c in counts.columns if c not in keys]
    rows = spark.read.parquet(f"{place}/out")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("v"))
    return last.select(*keys, *(F.col(f"v.{c}").alias(c) for c in fields))


def append_new_words(docs: DataFrame, path: str, state: str) -> None:
    """Append words of a stream of texts to a Parquet word list, each once."""
    from corpusloom.sources.tables import append_new

    words = T.word_rows(docs)
    words.writeStream.foreachBatch(lambda batch, _: append_new(batch, path)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
