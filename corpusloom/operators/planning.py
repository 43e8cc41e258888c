"""Dataset preparation: splits, caps, targets, chunks, batches and padding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.ordering import ranked, shuffled_key


def split_of(key: Column, share: float) -> Column:
    """"val" for about the share of keys, by their MD5; the same key always falls alike."""
    return F.when(T.md5_mod(key) < int(1000 * share), "val").otherwise("train")


def first_of_each(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first rows of each group; ranks are cut before the shuffle, too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("rank") <= most)


def capped_split(rows: DataFrame, group: str, order: str, share: float, most: int) -> DataFrame:
    """split: val rows beyond the first `most` of a group go to train; rows of one key and group are in any order, but each counts.

    Only the ranks of val rows that may be kept leave the scan: those of a key are matched by its number of rows.
    """
    named = rows.withColumn("split", split_of(F.col(order).cast("string"), share))
    rank = F.row_number().over(Window.partitionBy(group, order).orderBy(F.lit(1)))
    kept = first_of_each(named.filter("split = 'val'").select(group, order), group, order, most).groupBy(group, order).agg(F.count(F.lit(1)).alias("_n"))
    kept = kept.withColumnsRenamed({group: "_g", order: "_o"})
    twice = named.groupBy(group, order).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(F.col(group).alias("_g2"), F.col(order).alias("_o2"))
    joined = named.join(kept, F.col(group).eqNullSafe(F.col("_g")) & F.col(order).eqNullSafe(F.col("_o")), "left").join(twice, F.col(group).eqNullSafe(F.col("_g2")) & F.col(order).eqNullSafe(F.col("_o2")), "left")
    once = joined.filter("_o2 IS NULL AND _g2 IS NULL").withColumn("_r", F.lit(1))
    more = joined.filter("_o2 IS NOT NULL OR _g2 IS NOT NULL").withColumn("_r", rank)
    both = once.unionByName(more)
    return both.withColumn("split", F.when(F.col("_r") <= F.coalesce("_n", F.lit(0)), "val").otherwise("train")).drop("_g", "_o", "_n", "_g2", "_o2", "_r")


def targets(sizes: DataFrame, group: str, size: str, total: int) -> DataFrame:
    """Samples of each member: a fixed number, an equal share of its group's, and one by the root of its size."""
    return sizes.withColumns({"fixed": F.lit(total).cast("long"), "balanced": F.floor(F.lit(total) / F.count(F.lit(1)).over(Window.partitionBy(group))), "by_root": F.floor(F.lit(total) * F.sqrt(F.col(size) / F.min(size).over(Window.partitionBy(group))))})


def chunk_rows(plan: DataFrame, target: str, tasks: int, workers: int, least: int = 500, most: int = 5000) -> DataFrame:
    """(..., chunk, rows): each target cut into chunks of a size between the bounds."""
    size = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col(target) / max(1, workers // max(1, tasks)))))
    cut = plan.withColumn("_size", size).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(target) / F.col("_size")) - 1))))
    return cut.withColumn("rows", F.least(F.col("_size"), F.col(target) - F.col("chunk") * F.col("_size"))).drop("_size")


def width_batches(rows: DataFrame, width: str, key: str, size: int) -> DataFrame:
    """batch: rows in order of width over the whole table, `size` together."""
    return ranked(rows, width, key).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def shuffled_width_batches(rows: DataFrame, width: str, key: str, size: int, of_bucket: int = 10, drop_last: bool = True, salt: str = "") -> DataFrame:
    """(batch, turn, ...): batches of like width in an order that looks random: rows are mixed inside buckets of `of_bucket` batches,
    buckets and batches by hash. A last bucket that isn't full stays last; the last batch, if it isn't full, is dropped or kept; turn is the batch's place.
    """
    whole = size * of_bucket
    placed = ranked(rows, width, key).withColumn("_bucket", F.floor(F.col("place") / whole))
    total = placed.agg(F.count(F.lit(1)).alias("_all"))
    placed = placed.join(F.broadcast(total), how="cross").withColumn("_full", F.col("_bucket") < F.floor(F.col("_all") / whole))
    shuffled = lambda x, kind, name: ranked(x.distinct().withColumn("_k", shuffled_key(salt + kind, x.columns[0])), "_k", x.columns[0], name=name).drop("_k")
    order = shuffled(placed.filter("_full").select("_bucket"), "bucket", "_b")
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(shuffled_key(salt + "row", key), key)) - 1
    mixed = placed.withColumn("_in", within).join(order, "_bucket", "left")
    batch = F.floor(((F.coalesce("_b", F.floor(F.col("_all") / whole))) * whole + F.col("_in")) / size)
    mixed = mixed.withColumn("batch", batch).withColumn("_size", F.least(F.lit(size), F.col("_all") - F.col("batch") * size))
    if drop_last:
        mixed = mixed.filter(F.col("_size") == size)
    return mixed.join(shuffled(mixed.select("batch"), "batch", "turn"), "batch").drop("place", "_bucket", "_all", "_full", "_in", "_b", "_size")


def padded(batches: DataFrame, width: str, multiple: int = 4) -> DataFrame:
    """padded: the widest of the batch, raised to a multiple; pad: what a row lacks of it."""
    wide = F.ceil(F.max(width).over(Window.partitionBy("batch")) / multiple) * multiple
    return batches.withColumn("padded", wide).withColumn("pad", F.col("padded") - F.col(width))


def packed(rows: DataFrame, width: str, key: str, budget: int, most: int) -> DataFrame:
    """(key, width, batch): in order of (width, key) over the whole table, a batch takes rows while it has fewer than `most` and (rows + 1) * width fits.

    Where batches begin depends on the numbers of rows of each width alone. That histogram is folded in one task (a row
    a width, however many rows there are); a row's batch then follows from its place among the rows of its width.
    """
    placed = ranked(rows.select(key, width), width, key)
    sizes = placed.groupBy(width).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch, held = 0, 0
        for part in batches:
            out = []
            for w, n, first in part.itertuples(index=False):
                fits = max(1, min(most, budget // w if w > 0 else most))
                room = max(0, fits - held)
                out.append((w, first, batch, room, fits))
                left = n - room
                if left <= 0:
                    held = held + n
                else:
                    batch += -(-left // fits)
                    held = (left - 1) % fits + 1
            yield pd.DataFrame(out, columns=["_w", "_first", "_batch", "_room", "_fits"])

    kinds = dict(rows.dtypes)
    starts = sizes.select(width, "n", "first").repartition(1).sortWithinPartitions(width).mapInPandas(run, f"_w {kinds[width]}, _first long, _batch long, _room long, _fits long")
    at = F.col("place") - F.col("_first")
    batch = F.when(at < F.col("_room"), F.col("_batch")).otherwise(F.col("_batch") + 1 + F.floor((at - F.col("_room")) / F.col("_fits")))
    return placed.join(starts, F.col(width) == F.col("_w")).select(key, width, batch.alias("batch"))


def greedy_slots(scores: DataFrame, item: str, weight: str, leaf: str, score: str, capacity: int) -> DataFrame:
    """(item, leaf, slot): each item, the heaviest first (of equals the lower), takes a place at its best leaf (of equals the lower) that has one left.

    scores has a row for each item and leaf. Sequential by definition; only as many items as there are places, times one row
    each, come to one task: the heaviest ones, cut before the shuffle.
    """
    kinds = dict(scores.dtypes)
    wide = scores.groupBy(item, weight).agg(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(leaf).alias("leaf")))).alias("best"))
    leaves = scores.select(leaf).distinct().count()  # leaves are a vocabulary
    first = wide.orderBy(F.desc(weight), item).limit(leaves * capacity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict = {}
        for part in batches:
            out = []
            for it, best in zip(part[item], part["best"], strict=True):
                for b in best:
                    if left.setdefault(b["leaf"], capacity):
                        out.append((it, b["leaf"], capacity - left[b["leaf"]]))
                        left[b["leaf"]] -= 1
                        break
            yield pd.DataFrame(out, columns=["item", "leaf", "slot"])

    return first.repartition(1).sortWithinPartitions(F.desc(weight), item).mapInPandas(run, f"item {kinds[item]}, leaf {kinds[leaf]}, slot int")


def style_targets(targets: DataFrame, target: str, shares: dict[str, float]) -> DataFrame:
    """(..., style, style_target): each target's part of each style, one at least."""
    each = F.array(*(F.struct(F.lit(k).alias("style"), F.lit(float(v)).alias("share")) for k, v in shares.items()))
    return targets.withColumn("_s", F.explode(each)).withColumn("style", F.col("_s.style")).withColumn("style_target", F.greatest(F.lit(1), F.floor(F.col(target) * F.col("_s.share"))).cast("long")).drop("_s")


def missing_chunks(chunks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Chunks that aren't written yet: what a resumed run has left to do."""
    return chunks.join(done.select(key).distinct(), key, "left_anti")


def restored(batches: DataFrame, results: DataFrame, key: str, at: str) -> DataFrame:
    """Results of batches in the order that the rows had before they were sorted."""
    return batches.select(key, at, "batch").join(results, key).orderBy(at)


def batch_sizes(batches: DataFrame) -> DataFrame:
    """One row (batches, least, greatest): how many rows batches have."""
    return batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("batches"), F.min("n").alias("least"), F.max("n").alias("greatest"))


def enough(existing: DataFrame, more, least: int = 20_000) -> DataFrame:
    """The existing list if it has `least` entries; else with those that more() gives, each once. Asks for no more entries than `least`."""
    return existing if existing.limit(least).count() >= least else existing.union(more()).distinct()
