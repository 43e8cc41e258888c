"""Corpus operators: frequencies, vocabularies, coverage, merges, checks. DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scripts as S
from corpusloom.functions import text as T


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): counts with partial sums before the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_by(counts: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The k most frequent items of each group; of equals the lower item. Ranks are cut before the shuffle, too."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), item))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def numbered(items: DataFrame, item: str) -> DataFrame:
    """(token_id, item): the distinct items in order, from 1; 0 stays free for the blank. For vocabularies, which are small."""
    return items.select(item).distinct().select(F.row_number().over(Window.orderBy(item)).alias("token_id"), item)


def by_code(vocabulary: DataFrame, token: str, number: str) -> DataFrame:
    """One row (ids): numbers of one-character tokens by code point, for a join without a key; lookups cost the same for any vocabulary."""
    pairs = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct(F.ascii(token), number))).alias("m"), F.max(F.ascii(token)).alias("top"))
    return pairs.select(F.transform(F.sequence(F.lit(0), F.coalesce("top", F.lit(0))), lambda i: F.element_at("m", i)).alias("ids"))


def as_array(vocabulary: DataFrame, token: str, number: str) -> DataFrame:
    """One row (tokens): the tokens in order of their numbers."""
    return vocabulary.agg(F.transform(F.array_sort(F.collect_list(F.struct(number, token))), lambda x: x[token]).alias("tokens"))


def without(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the other table lacks."""
    return rows.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(key, n): all keys of both, those without a count at 0."""
    return existing.select(key).distinct().join(counts, key, "full_outer").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def coverage(universe: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """One row: how much of a universe the counts cover, and how often; the median is the upper one."""
    both = universe.select(key).distinct().join(counts, key, "left").groupBy("n").agg(F.count(F.lit(1)).alias("k"))  # a row for each count
    found = both.filter("n IS NOT NULL")
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = found.withColumn("_upto", F.sum("k").over(upto)).withColumn("_all", F.sum("k").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    middle = middle.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).agg(F.min("n").alias("median"))
    row = both.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("universe"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("k"))), F.lit(0)).alias("covered"), F.min("n").alias("least"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("k"))), F.lit(0)).alias("once"), F.coalesce(F.sum(F.when(F.col("n") >= 5, F.col("k"))), F.lit(0)).alias("five_or_more"))
    return row.crossJoin(middle).select("universe", "covered", F.round(100.0 * F.col("covered") / F.greatest("universe", F.lit(1)), 4).alias("percent"), "least", "median", "once", "five_or_more")


def han_coverage(words: DataFrame, word: str = "word") -> DataFrame:
    """(block, covered, universe, percent) of the ideographs of distinct words, in both blocks and in all."""
    seen = words.select(F.explode(S.han_chars(F.col(word))).alias("c")).distinct().select((F.ascii("c") >= 0x4E00).alias("unified"))
    row = seen.agg(F.count_if("unified").alias("u"), F.count_if(~F.col("unified")).alias("e"))
    of = lambda name, n, all_: F.struct(F.lit(name).alias("block"), n.alias("covered"), F.lit(all_).cast("long").alias("universe"), F.round(100.0 * n / all_, 4).alias("percent"))
    every = F.array(of("unified", F.col("u"), S.UNIFIED), of("extension", F.col("e"), S.EXTENSION), of("all", F.col("u") + F.col("e"), S.UNIFIED + S.EXTENSION))
    return row.select(F.explode(every).alias("x")).select("x.*")


def pair_counts(word_counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, pair, n): character pairs of words by number, from counts of words: each different word is cut once."""
    pairs = word_counts.select(*keys, "n", F.explode(T.bigrams(F.col("word"))).alias("pair"))
    return pairs.groupBy(*keys, "pair").agg(F.sum("n").alias("n"))


def char_counts(word_counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, char, n): characters of words by number, from counts of words."""
    return word_counts.select(*keys, "n", F.explode(T.chars(F.col("word"))).alias("char")).groupBy(*keys, "char").agg(F.sum("n").alias("n"))


def vocabulary_pairs(pairs: DataFrame, alphabet: str) -> DataFrame:
    """Pairs that a vocabulary may hold: not of two digits, both characters in a class of letters."""
    return pairs.filter(F.col("pair").rlike(f"^[{alphabet}]{{2}}$") & ~F.col("pair").rlike("^[0-9]{2}$"))


def cluster_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(cluster, count, cp_len): grapheme clusters of texts by number, with their code points."""
    from corpusloom.functions.codecs import grapheme_clusters

    each = texts.select(F.explode(grapheme_clusters(F.col(text))).alias("cluster"))
    return each.groupBy("cluster").agg(F.count(F.lit(1)).alias("count")).withColumn("cp_len", F.length("cluster"))


def multi_share(clusters: DataFrame) -> DataFrame:
    """One row (clusters, multi, rate): occurrences of all clusters, and of those of several code points."""
    multi = F.coalesce(F.sum(F.when(F.col("cp_len") > 1, F.col("count"))), F.lit(0))
    return clusters.agg(F.sum("count").alias("clusters"), multi.alias("multi"), F.round(multi / F.sum("count"), 6).alias("rate"))


def three_part_counts(words: DataFrame, word: str = "word") -> DataFrame:
    """(syllable, n): Hangul syllables with a tail by number."""
    each = words.select(F.explode(T.chars(F.col(word))).alias("syllable")).filter(F.ascii("syllable").between(0xAC00, 0xD7A3) & ((F.ascii("syllable") - 0xAC00) % 28 > 0))
    return count_by(each, "syllable")


def frequent_ideographs(word_counts: DataFrame, base: list[str], most: int) -> DataFrame:
    """(char, n, rank): the most frequent ideographs of counted words (word, n) that the base lacks, for a vocabulary of `most` entries with a blank."""
    found = word_counts.select(F.explode(F.regexp_extract_all("word", F.lit(f"[{S.HAN}]"), F.lit(0))).alias("char"), "n").groupBy("char").agg(F.sum("n").alias("n"))
    best = found.filter(~F.col("char").isin(base)).orderBy(F.desc("n"), "char").limit(max(0, most - 1 - len(base)))
    return best.select("char", "n", F.row_number().over(Window.orderBy(F.desc("n"), "char")).alias("rank"))


def fusions(clusters: DataFrame, base: list[str], guaranteed: list[str], most: int) -> DataFrame:
    """(fusion, rank): what a vocabulary of `most` entries with a blank adds to its base characters: the guaranteed ones first, then clusters
    of several code points, all of the base, the most frequent first (of equals the lower)."""
    room = most - 1 - len(base)
    sure = clusters.sparkSession.createDataFrame([(g, i) for i, g in enumerate(dict.fromkeys(guaranteed))], "cluster string, place int")
    fit = clusters.filter((F.col("cp_len") > 1) & (F.size(F.array_except(T.chars(F.col("cluster")), F.array(*map(F.lit, base)))) == 0)).join(F.broadcast(sure), "cluster", "left_anti")
    both = sure.select("cluster", F.lit(0).alias("kind"), F.col("place").cast("long").alias("at")).union(fit.select("cluster", F.lit(1), -F.col("count")))
    best = both.orderBy("kind", "at", "cluster").limit(max(0, room))
    return best.select(F.col("cluster").alias("fusion"), F.row_number().over(Window.orderBy("kind", "at", "cluster")).alias("rank"))


def pairings(rare: DataFrame, partners: DataFrame, known: DataFrame) -> DataFrame:
    """(pair): each rare character with each partner, in both orders, that isn't known. Partners are few and fixed in number."""
    both = rare.select(F.col("char").alias("r")).crossJoin(F.broadcast(partners.select(F.col("char").alias("p"))))
    return both.select(F.explode(F.array(F.concat("r", "p"), F.concat("p", "r"))).alias("pair")).distinct().join(known, "pair", "left_anti")


def first_lines(c: Column) -> Column:
    """Lines of a text, each kept where it first stands."""
    return F.array_distinct(F.split(c, "\n"))


def charset_issues(rows: DataFrame, allowed: str) -> DataFrame:
    """(lang, char, n_docs): characters outside a Java character class, and texts that hold them."""
    odd = rows.select("lang", F.explode(F.array_distinct(T.chars(F.regexp_replace("text", f"[{allowed}]", "")))).alias("char"))
    return odd.groupBy("lang", "char").agg(F.count(F.lit(1)).alias("n_docs"))


def word_quality(words: DataFrame) -> DataFrame:
    """By language: words, distinct words, share of repeats, words out of length, of digits, of another script."""
    return words.groupBy("lang").agg(
        F.count(F.lit(1)).alias("words"), F.count_distinct("word").alias("distinct_words"), F.round(1 - F.count_distinct("word") / F.count(F.lit(1)), 6).alias("repeat_share"),
        F.count_if(~F.length("word").between(1, 50)).alias("bad_length"), F.count_if(F.col("word").rlike(r"^\d")).alias("digit_first"), F.count_if(~F.col("word").rlike(f"[{T.members(T.SCRIPTS['latin'])}]")).alias("no_letter"),
    )


def _cut(word: Column) -> Column:
    """The word with each one of its characters left out."""
    n = F.length(word)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))


def _variants(c: str, edits: int) -> Column:
    """A row for the word and each variant with at most so many characters left out."""
    out = F.array(F.col(c))
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda w: F.length(w) > 0), _cut))))
    return F.explode(out)


def spelling(words: DataFrame, dictionary: DataFrame, edits: int = 1, short: int = 4) -> DataFrame:
    """(word, best, distance): the nearest dictionary word within `edits` edits, one for words of at most `short` characters; of equals the lower word.

    Words within k edits share a variant with at most k characters left out, so an equi-join on variants
    finds every candidate without pairing all words of a length.
    """
    far = F.when(F.length("word") <= short, 1).otherwise(edits)
    left = words.select("word").distinct().withColumn("v", _variants("word", edits))
    right = dictionary.select(F.col("word").alias("entry")).distinct().withColumn("v", _variants("entry", edits))
    near = left.join(right, "v").select("word", "entry").distinct().select("word", "entry", F.levenshtein("word", "entry").alias("distance")).filter(F.col("distance") <= far)
    best = near.groupBy("word").agg(F.min(F.struct("distance", "entry")).alias("b"))
    return best.select("word", F.col("b.entry").alias("best"), F.col("b.distance").alias("distance"))


def corrected(texts: DataFrame, dictionary: DataFrame, sure: float = 0.5, edits: int = 2) -> DataFrame:
    """(..., result, corrected) of rows with text, confidence, script: the nearest dictionary word where the reader wasn't sure.

    Left alone: confident rows, fewer than 3 characters, digits, and what the dictionary (script, word) holds. Punctuation at the end is set aside
    and put back; Latin text is looked up in lower case.
    """
    bare = F.rtrim(F.col("text"), F.lit(".,;:!?।॥"))
    lookup = F.when(F.col("script") == "latin", F.lower(bare)).otherwise(bare)
    due = (F.col("confidence") < sure) & (F.length("text") >= 3) & (F.length(lookup) >= 3) & ~F.col("text").rlike(r"\p{Nd}")
    rows = texts.withColumn("_bare", bare).withColumn("_look", F.when(due, lookup))
    asked = rows.filter("_look IS NOT NULL").select("script", F.col("_look").alias("word")).distinct().join(dictionary.select("script", "word").distinct(), ["script", "word"], "left_anti")
    # the script stands before each word, so that one search serves all
    tagged = lambda df: df.select(F.concat("script", F.lit("\x00"), "word").alias("word"))
    short = F.length(F.split_part(F.col("word"), F.lit("\x00"), F.lit(2))) <= 4
    near = _nearest(tagged(asked), tagged(dictionary.filter(F.length("word") >= 2)), edits, short)
    best = near.select(F.split_part("word", F.lit("\x00"), F.lit(1)).alias("_s"), F.split_part("word", F.lit("\x00"), F.lit(2)).alias("_w"), F.split_part("best", F.lit("\x00"), F.lit(2)).alias("_best"))
    out = rows.join(best, (F.col("script") == F.col("_s")) & (F.col("_look") == F.col("_w")), "left")
    tail = F.substring(F.col("text"), F.length("_bare") + 1, F.length("text"))
    return out.withColumn("result", F.coalesce(F.concat("_best", tail), "text")).withColumn("corrected", F.col("_best").isNotNull()).drop("_bare", "_look", "_s", "_w", "_best")


def _nearest(words: DataFrame, dictionary: DataFrame, edits: int, short: Column) -> DataFrame:
    """spelling() of words with a mark in front that may not be edited: variants are of what follows it."""
    mark = lambda df, c: df.select(F.split_part(c, F.lit("\x00"), F.lit(1)).alias("_m"), F.col(c), F.split_part(c, F.lit("\x00"), F.lit(2)).alias("_t")).distinct()
    left = mark(words, "word").withColumn("v", _variants("_t", edits)).select("_m", "v", "word", F.col("_t").alias("a"))
    right = mark(dictionary.select(F.col("word").alias("entry")), "entry").withColumn("v", _variants("_t", edits)).select("_m", "v", "entry", F.col("_t").alias("b"))
    near = left.join(right, ["_m", "v"]).select("word", "entry", "a", "b").distinct().withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= F.when(short, 1).otherwise(edits))
    best = near.groupBy("word").agg(F.min(F.struct("distance", "entry")).alias("x"))
    return best.select("word", F.col("x.entry").alias("best"), F.col("x.distance").alias("distance"))


def correction_counts(rows: DataFrame, sure: float = 0.5) -> DataFrame:
    """One row (corrected, unsure, total) of corrected()."""
    return rows.agg(F.count_if("corrected").alias("corrected"), F.count_if(F.col("confidence") < sure).alias("unsure"), F.count(F.lit(1)).alias("total"))
