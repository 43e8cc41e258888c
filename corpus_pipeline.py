"""A corpus pipeline: five stages, each a step of corpusloom.llm, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet to
the shared folder and read again, so a lost executor costs no more than its tasks of the stage that runs. What a stage
wrote for itself, and the rows that it read, are emptied once its result is written.

Odd input: a null or empty text is clean, has no words and no copies, and stays until the quality stage, whose score of texts without tokens
decides; very long texts are read whole by every stage; of equal rows one stays, by the near-copy stage; rows without an id
take part like others, under a number made of their text; an id given to several texts is handled text by text but in
the near-copy stage, which drops it only if none of its texts is the lowest of its component. An empty table gives no
rows. Extra columns pass through under their own names, those that clash with a stage's names too (they are set aside); the last stage adds
token_ids. Ties at a threshold: a text is toxic from 0.5 on, and good from 0.5 on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, jaccard_join, quality, sentencepiece_codec, toxicity
from corpusloom.llm.common import MADE, discard, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds toxic go."""
    return toxicity.keep(spark, docs, sf_dir)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects go."""
    return quality.keep(spark, docs, sf_dir)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more stays."""
    return jaccard_join.keep_one(spark, docs, sf_dir)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.keep(spark, docs, sf_dir)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with the numbers of their pieces."""
    return sentencepiece_codec.encode_stage(spark, docs, sf_dir)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("sentencepiece", encode)]

#: SQL has no form for fitted models; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read(spark, sf_dir, "documents")
    last: list[str] = []
    for name, stage in STAGES[:-1]:
        began = len(MADE)
        docs = written(stage(spark, docs, sf_dir), name)
        discard(spark, last + MADE[began:-1])
        last = MADE[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
