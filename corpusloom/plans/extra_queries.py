"""Relational and event queries over the star-schema tables: additions of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import table
from corpusloom.streaming.counts import drained, windowed_counts


def extra_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and prices of shipped lines by flag and status."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= "1998-09-02")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(net), 2).alias("net"))


def extra_nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net revenue of each customer nation."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    sold = lines.groupBy("o_orderkey").agg(F.sum("net").alias("net")).join(orders, "o_orderkey").join(customers, "c_custkey")
    return sold.groupBy("n_nationkey").agg(F.sum("net").alias("net")).join(table(spark, sf_dir, "nation"), "n_nationkey").select("n_name", F.round("net", 2).alias("net"))


def extra_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest orders of each customer."""
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", rank.alias("rank")).filter("rank <= 3")


def extra_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour and type."""
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour", "1 hour").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def extra_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream over all events there are."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return drained(windowed_counts(stream, "ts", "event_type", "value", "1 hour", "365 days"), ["window_start", "event_type"]).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


_EVENTS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"

QUERIES = {f.__name__: f for f in (extra_pricing_summary, extra_nation_revenue, extra_top_orders, extra_event_windows, extra_event_stream)}

SQL = {
    "extra_pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2",
    "extra_nation_revenue": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "extra_top_orders": "SELECT o_custkey, o_orderkey, o_totalprice, rank::INTEGER AS rank FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "extra_event_windows": _EVENTS,
    "extra_event_stream": _EVENTS,
}
