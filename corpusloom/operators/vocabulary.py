"""Vocabularies of tokens, and word lists that grow by what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.codecs import characters
from corpusloom.functions.scripts import SCRIPTS
from corpusloom.operators.corpus import pair_counts, vocabulary_pairs

#: What stands for the blank, the first token.
BLANK = "∅"
#: Printable ASCII.
ASCII = [chr(i) for i in range(32, 127)]


def script_characters(name: str) -> list[str]:
    """Assigned characters of a script's ranges that aren't white space."""
    return [c for c in characters(*SCRIPTS[name]) if c.strip()]


def built(spark: SparkSession, *parts: list[str]) -> DataFrame:
    """(token_id, token): the blank with number 0, printable ASCII, and the tokens of the parts in order, each once."""
    tokens = list(dict.fromkeys([BLANK, *ASCII, *(t for p in parts for t in p)]))
    return spark.createDataFrame(list(enumerate(tokens)), "token_id int, token string")


def counted(word_counts: DataFrame, alphabet: str, most: int = 75, extra: list[str] = ()) -> DataFrame:
    """As built(), with the `most` most frequent pairs of characters of a class (of equals the lower) inside counted words."""
    best = vocabulary_pairs(pair_counts(word_counts), alphabet).orderBy(F.desc("n"), "pair").limit(most)
    return built(word_counts.sparkSession, list(extra), [r["pair"] for r in best.collect()])  # `most` rows


def size(vocabulary: DataFrame) -> int:
    return vocabulary.count()


def grown(sources: list[DataFrame], existing: DataFrame) -> DataFrame:
    """(word): distinct words of all sources that the existing list lacks."""
    every = sources[0].select("word")
    for s in sources[1:]:
        every = every.union(s.select("word"))
    return every.distinct().join(existing.select("word").distinct(), "word", "left_anti")


def grow_lists(words: DataFrame, path: str, append: Callable[[DataFrame, str], None], dry: bool = False) -> DataFrame:
    """(script, added): distinct words of 2 characters or more that each script's list in `path` lacks; appended to it unless dry."""
    from pyspark.errors import AnalysisException

    spark, new = words.sparkSession, words.select("script", "word").filter(F.length("word") >= 2).distinct()
    try:
        new = new.join(spark.read.parquet(path).select("script", "word"), ["script", "word"], "left_anti")
    except AnalysisException:  # there is no list yet
        pass
    report = spark.createDataFrame([tuple(r) for r in new.groupBy("script").agg(F.count(F.lit(1)).alias("added")).collect()], "script string, added long")  # a row a script
    if not dry:
        append(new, path)
    return report
