"""Global order without a single task: places of rows in a total order, and orders that are undone again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder. Where none is set, a session on one machine (tests) gets one there; on a cluster that is an error."""
    import tempfile

    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where := tempfile.mkdtemp(prefix="corpusloom-"))
    return where


def kept(rows: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read again. The folder is the cluster's to clean."""
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ranked(rows: DataFrame, *by: str, name: str = "place") -> DataFrame:
    """The rows with their place from 0 in the order of all rows.

    Rows are dealt by ranges and sorted inside them; a place is the one in its range plus the rows of the ranges
    before. Only one count a range is added up in one task. Give keys that order totally, or equal rows share any order.
    """
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    numbered = kept(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def shuffled_key(salt: str, *keys: str | Column) -> Column:
    """A text that orders rows as if shuffled: the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(salt), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def reading_order(boxes: DataFrame, page: str = "page") -> DataFrame:
    """order from 0 on each page: by line, then from left to right. A line is as high as the middle height of the page's boxes, at least one pixel.

    Boxes have x1, y1, x2, y2 as shares of the page, and height, the page's pixels. A page's boxes are few.
    """
    lines = boxes.groupBy(page).agg(F.greatest(F.median((F.col("y2") - F.col("y1")) * F.col("height")), F.lit(1.0)).alias("_line"))
    placed = boxes.join(lines, page).withColumn("line", F.floor((F.col("y1") + F.col("y2")) / 2 * F.col("height") / F.col("_line")).cast("long"))
    order = F.row_number().over(Window.partitionBy(page).orderBy("line", F.col("x1") + F.col("x2"), "y1", "x1", "x2", "y2")) - 1
    return placed.withColumn("order", order.cast("long")).drop("_line")
