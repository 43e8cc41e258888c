"""Helpers shared by the operators: Arrow text access, word splitting, broadcasts of small models."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of a text with A-Z in lower case.
LOWER = bytes.maketrans(UPPER, UPPER.lower())
#: Also maps every byte that is no word byte (0-9, a-z, 80-FF) to a space.
WORDS = bytes(LOWER[i] if chr(LOWER[i]) in "0123456789abcdefghijklmnopqrstuvwxyz" or i >= 0x80 else 0x20 for i in range(256))
#: Characters of text in one step of work inside a Python worker.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch, at most.
BATCH_ROWS = 1000

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def bounded(spark: SparkSession) -> None:
    """Ask the session for Arrow batches of few rows: a worker and its executor hold one or two of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Tables of long rows, whose work is in each row: dealt to all cores where there are few files, with one row group each perhaps, and no more splits than cores.
LONG = frozenset(("documents", "pages", "conversations"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder."""
    bounded(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark.sparkContext.defaultParallelism
    few = table in LONG and df.rdd.getNumPartitions() <= cores and 4 * len(df.inputFiles()) <= cores
    return df.repartition(cores) if few else df


def column(df: DataFrame, name: str, kind: str):
    """The column, or a null of the kind where the table has none."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def own(docs: DataFrame) -> list:
    """The columns of a table, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def set_aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The table with free names for columns that clash with `names` (in any case of letters), and the way back."""
    taken, moved = {c.lower() for c in docs.columns} | {n.lower() for n in names}, {}
    for c in docs.columns:
        if c.lower() in {n.lower() for n in names}:
            new = f"{c}_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            moved[c] = new
    return docs.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


def texts(array: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, at: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows of at most `limit` bytes of text in column `at` (one row may hold more), with their texts."""
    all_texts, start, size = texts(batch.column(at)), 0, 0
    for i, t in enumerate(all_texts):
        if size and size + len(t) > limit:
            yield batch.slice(start, i - start), all_texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(all_texts):
        yield batch.slice(start), all_texts[start:]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=np.float64)))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a session on one machine (tests) gets one there; on a cluster that is an error."""
    import tempfile

    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where := tempfile.mkdtemp(prefix="corpusloom-"))
    return where


#: Folders that written() has made in this process, in order.
MADE: list[str] = []


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Empty folders that written() has made, once nothing reads them any more."""
    from concurrent.futures import ThreadPoolExecutor

    none = spark.createDataFrame([], "gone int").coalesce(1)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda path: none.write.mode("overwrite").parquet(path), folders))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read again: cuts the lineage, survives lost executors.

    Queries that are read after they return can't delete what they are read from; corpus_pipeline.run() empties what a
    stage wrote when the stage's result is written. The rest is for whoever owns the shared folder to clean.
    """
    import uuid

    spark = df.sparkSession
    bounded(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
