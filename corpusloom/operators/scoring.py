"""Decoding and scoring: collapsed sequences, edit accuracy, grouped accuracy, confusion, cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapsed(frames: Column) -> Column:
    """Numbers of a best path: repeats made one, then blanks (0) dropped; a blank between equals keeps both."""
    return F.filter(frames, lambda x, i: (x != 0) & ((i == 0) | (x != F.element_at(frames, F.greatest(i, F.lit(1))))))


def path_confidence(frames: Column, best: Column) -> Column:
    """Geometric mean of the best probabilities where the collapsed path keeps a frame; 0 if it keeps none."""
    kept = F.filter(F.transform(F.arrays_zip(frames.alias("f"), best.alias("p")), lambda x, i: F.when((x["f"] != 0) & ((i == 0) | (x["f"] != F.element_at(frames, F.greatest(i, F.lit(1))))), x["p"])), lambda p: p.isNotNull())
    return F.when(F.size(kept) > 0, F.exp(F.aggregate(F.transform(kept, lambda p: F.log(p + 1e-10)), F.lit(0.0), lambda a, x: a + x) / F.size(kept))).otherwise(0.0)


def masked_argmax(scores: Column, allowed: Column) -> Column:
    """Place (from 0) of the largest score among allowed places."""
    masked = F.zip_with(scores, allowed, lambda s, ok: F.when(ok, s).otherwise(F.lit(float("-inf"))))
    return F.array_position(masked, F.array_max(masked)) - 1


def edit_accuracy(pairs: DataFrame, truth: str, guess: str, *keys: str) -> DataFrame:
    """(keys, chars, edits, accuracy): one less edits over characters of the truth, floored at 0 for each row."""
    edit = F.levenshtein(truth, guess)
    hit = F.greatest(F.lit(0), F.length(truth) - edit)
    return pairs.groupBy(*keys).agg(F.sum(F.length(truth)).alias("chars"), F.sum(edit).alias("edits"), F.round(F.sum(hit) / F.greatest(F.sum(F.length(truth)), F.lit(1)), 6).alias("accuracy"))


def accuracy_levels(rows: DataFrame, right: Column, *levels: str) -> DataFrame:
    """Rows and share of right ones: overall, by the first level, by the first two, and so on."""
    rolled = rows.withColumn("_r", right.cast("int")).rollup(*levels)
    return rolled.agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("_r") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("accuracy"))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, center): the mean of each label's vectors, scaled to length 1."""
    mean = vectors.select(label, F.posexplode(vector).alias("place", "x")).groupBy(label, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda v: v["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return whole.select(label, F.transform("v", lambda x: x / norm).alias("center"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, rounded to 6 places; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    norm = length(a) * length(b)
    return F.round(F.when(norm > 0, dot / norm).otherwise(0.0), 6)


def near_centers(vectors: DataFrame, centers: DataFrame, key: str, vector: str, label: str, block: int = 10_000) -> DataFrame:
    """(key, label, guess, cosine): the nearest center of each vector; of equals the lower label. Centers are a class each; they are met in blocks of `block` by the hash of their label, so their number has no cap."""
    n = -(-centers.count() // block)
    both = None
    for k in range(max(1, n)):
        part = centers.filter(F.pmod(F.xxhash64(label), F.lit(n)) == k) if n > 1 else centers
        scored = vectors.crossJoin(F.broadcast(part.withColumnRenamed(label, "guess"))).select(key, label, "guess", cosine(F.col(vector), F.col("center")).alias("cosine"))
        best = scored.groupBy(key, label).agg(F.max(F.struct("cosine", (-F.col("guess")).alias("g"))).alias("b"))
        both = best if both is None else both.union(best)
    if n > 1:
        both = both.groupBy(key, label).agg(F.max("b").alias("b"))
    return both.select(key, label, (-F.col("b.g")).alias("guess"), F.col("b.cosine").alias("cosine"))


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n, share): counts of each pair and its share of the truth's rows."""
    pairs = rows.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(truth)), 6))


def frame_path(frames: Column, classes: Column) -> Column:
    """The best class of each frame among the first `classes` ones (of equals the lower), collapsed."""
    return collapsed(F.transform(frames, lambda f: F.array_position(f, F.array_max(F.slice(f, 1, classes))).cast("int") - 1))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def predicted(scores: Column) -> Column:
    """(best, confidence): the place of the largest score and its softmax."""
    top = F.array_max(scores)
    return F.struct((F.array_position(scores, top) - 1).cast("long").alias("best"), (F.lit(1.0) / F.aggregate(F.transform(scores, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, y: a + y)).alias("confidence"))


def routing(rows: DataFrame) -> DataFrame:
    """group_ok and decode_ok of rows with pred_group, true_group, pred_script, true_script, target_len, frames: the group is right; so is the script, and the target isn't empty and fits the frames."""
    group = F.col("pred_group") == F.col("true_group")
    return rows.withColumn("group_ok", group).withColumn("decode_ok", group & (F.col("pred_script") == F.col("true_script")) & valid_target(F.col("target_len"), F.col("frames")))


def valid_target(length: Column, frames: Column) -> Column:
    return (length > 0) & (length <= frames)


def script_of_group(scores: Column, true: Column) -> Column:
    """The place of the best script's score; of a group that has no scores, the true one."""
    return F.when(scores.isNotNull(), F.array_position(scores, F.array_max(scores)).cast("int") - 1).otherwise(true)


def word_levels(rows: DataFrame, groups: int) -> DataFrame:
    """(true_group, true_script, level, words, chars, word_accuracy, char_accuracy) over all, by group, by group and script.

    Rows have true_group, true_script, pred_group, pred (decoded), ref. A row sent to a wrong group counts as wrong in both shares; one
    whose group is out of range doesn't count at all. Case and white space at the ends don't matter.
    """
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    ref, pred, sent = norm(F.col("ref")), norm(F.col("pred")), F.col("pred_group") == F.col("true_group")
    given = rows.filter(F.col("pred_group") < groups).select("true_group", "true_script", F.when(sent & (ref == pred), 1).otherwise(0).alias("_w"), F.length(ref).alias("_n"), F.when(sent, F.greatest(F.lit(0), F.length(ref) - F.levenshtein(pred, ref))).otherwise(0).alias("_c"))
    share = lambda a, b: F.round(100.0 * a / F.greatest(b, F.lit(1)), 4)
    return given.rollup("true_group", "true_script").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("words"), F.sum("_n").alias("chars"), share(F.sum("_w"), F.count(F.lit(1))).alias("word_accuracy"), share(F.sum("_c"), F.sum("_n")).alias("char_accuracy"))


def set_accuracy(rows: DataFrame) -> DataFrame:
    """(name, word_accuracy, char_accuracy, n) of each test set of rows (name, ref, pred)."""
    ref, pred = (F.lower(F.trim(c)) for c in ("ref", "pred"))
    right = F.sum(F.when(ref == pred, 1).otherwise(0))
    chars = F.sum(F.greatest(F.lit(0), F.length(ref) - F.levenshtein(pred, ref)))
    return rows.groupBy("name").agg((100.0 * right / F.count(F.lit(1))).alias("word_accuracy"), (100.0 * chars / F.greatest(F.sum(F.length(ref)), F.lit(1))).alias("char_accuracy"), F.count(F.lit(1)).alias("n"))


def weighted_average(sets: DataFrame) -> DataFrame:
    """One row (average, n): the share of right words over all sets, from their accuracies: right words of a set are cut to a whole number."""
    right = F.floor(F.col("word_accuracy") * F.col("n") / 100)
    return sets.agg(F.round(100.0 * F.sum(right) / F.sum("n"), 6).alias("average"), F.sum("n").alias("n"))


def regional_loss(rows: DataFrame) -> DataFrame:
    """One row (per_token, mean_of_groups): losses added up over target lengths, and the mean of the groups' mean losses."""
    groups = rows.groupBy("group").agg(F.sum("loss").alias("s"), F.sum("target_len").alias("t"), F.avg("loss").alias("m"))
    return groups.agg(F.round(F.sum("s") / F.greatest(F.sum("t"), F.lit(1)), 6).alias("per_token"), F.round(F.avg("m"), 6).alias("mean_of_groups"))


def all_cosines(rows: DataFrame, leaves: DataFrame, key: str, leaf: str, vector: str, most: int = 100_000) -> DataFrame:
    """(key, leaf, cosine) of every row and every leaf, in blocks of leaves that are broadcast; leaves are a vocabulary of at most `most` (checked)."""
    few = leaves.select(F.col(leaf).alias("leaf"), F.col(vector).alias("_v"))
    if few.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} leaves")
    return rows.join(F.broadcast(few), how="cross").select(key, "leaf", cosine(F.col(vector), F.col("_v")).alias("cosine"))
