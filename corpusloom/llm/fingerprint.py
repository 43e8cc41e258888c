"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every window of three bytes of a text is hashed into one of 128 buckets. The digest keeps, for each bucket,
which quartile of the bucket counts its count falls in (2 bits), a checksum byte, a logarithmic length, and
the ratios of the quartiles. Two digests are compared by a bounded difference: 0 for equal digests, 1 at most.

A text of fewer than three bytes has no triplets: all counts are 0, its checksum alone tells it apart.
Null is the empty text. Equal texts have equal digests. Long texts are counted whole, in pieces. Rows without an id come first, in
order of their texts (the id -2^63+1 stands for none); rows of one id are ordered by text, equal rows follow each other. An empty table gives no rows.
Extra columns are ignored, whatever their names. Rows of one id share a bucket, which is read as a stream of one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import column, read, sha256, texts

BUCKETS = 128
#: Stands for a null id, which sorts first.
NO_ID = -(1 << 63) + 1
#: Bytes hashed in one numpy step.
STEP = 1 << 20
#: Bytes of text that one group of neighbouring documents should hold, and groups at most: their bounds are part of the plan.
GROUP_BYTES, MOST_GROUPS = 16 << 20, 20_000
#: The most that each part of the difference adds, and their sum.
LENGTH_CAP, RATIO_CAP, CHECK_COST = 48, 24, 6
MOST = 3 * BUCKETS + LENGTH_CAP + 2 * RATIO_CAP + CHECK_COST


def counts(data: bytes) -> np.ndarray:
    """Triplets of each bucket."""
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 2), STEP):
        b = np.frombuffer(data, np.uint8, min(STEP + 2, len(data) - at), at).astype(np.uint32)
        h = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
        total += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return total


def check_byte(data: bytes) -> int:
    """A weak checksum of the whole text."""
    import zlib

    return zlib.crc32(data) & 0xFF


def length_class(n: int) -> int:
    """About 8 classes for each doubling."""
    return min(255, int(np.floor(8 * np.log2(n + 1))))


def digest(data: bytes) -> bytes:
    """check, length class, two quartile ratios in 16ths, then 2 bits a bucket: 36 bytes."""
    c = counts(data)
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    level = (c > q1).astype(np.uint8) + (c > q2) + (c > q3)
    r1, r2 = (int(16 * q1 // q3), int(16 * q2 // q3)) if q3 else (0, 0)
    packed = level[0::4] << 6 | level[1::4] << 4 | level[2::4] << 2 | level[3::4]
    return bytes((check_byte(data), length_class(len(data)), r1, r2)) + packed.astype(np.uint8).tobytes()


def _unpacked(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), -1)
    return raw[:, :4].astype(np.int64), np.stack([raw[:, 4:] >> s & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(digests), -1).astype(np.int64)


def differences(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """0 (equal) to MOST. A step of one quartile costs 1, from the lowest to the highest 3."""
    if not a:
        return np.zeros(0)
    (ha, ba), (hb, bb) = _unpacked(a), _unpacked(b)
    d = np.abs(ha - hb)
    return np.abs(ba - bb).sum(axis=1) + np.minimum(d[:, 1], LENGTH_CAP) + np.minimum(d[:, 2:], RATIO_CAP).sum(axis=1) + CHECK_COST * (d[:, 0] > 0)


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """1 for equal digests, 0 at the largest difference."""
    return 1.0 - differences(a, b) / MOST


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "fingerprint": pa.array([digest(t).hex() for t in texts(batch.column(1))])})

    return docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def _bucket(bounds: list[int], value: Column) -> Column:
    """How many bounds the value reaches, found in two steps of about the square root of their number."""
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    at = lambda xs: f"array({','.join(f'{x}L' for x in xs)})"
    heads, fine = at([p[0] for p in parts]), f"array({','.join(map(at, parts))})"
    coarse = F.expr(f"size(filter({heads}, x -> x <= _v))")
    return F.when(value.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + F.expr(f"size(filter(element_at({fine}, greatest(1, size(filter({heads}, x -> x <= _v)))), x -> x <= _v))")).cast("int")


def with_next(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Rows (bucket, head, _v, text): neighbours in doc_id (_v) share a bucket, and each bucket also holds, flagged, the first row of the next (the first of all for the last).

    Bounds come from quantiles of doc_id over all rows; only one least doc_id a bucket reaches the driver.
    """
    docs = docs.select(F.coalesce(column(docs, "doc_id", "long"), F.lit(NO_ID)).alias("_v"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = min(MOST_GROUPS, max(int(size // group_bytes) + 1, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = sorted(set(docs.approxQuantile("_v", [i / n for i in range(1, n)], 0.2 / n))) if size else []
    docs = docs.withColumn("bucket", _bucket([int(x) for x in bounds], F.col("_v")) if bounds else F.lit(0))
    heads = [(r["bucket"], r["v"]) for r in docs.groupBy("bucket").agg(F.min("_v").alias("v")).orderBy("bucket").collect()]
    before = {b: heads[i - 1][0] for i, (b, _) in enumerate(heads)}
    known = docs.sparkSession.createDataFrame([(b, v, before[b]) for b, v in heads], "bucket int, v long, before int")
    first = docs.join(F.broadcast(known), "bucket").filter(F.col("_v") == F.col("v")).select(F.col("before").alias("bucket"), F.lit(True).alias("head"), "_v", "text")
    return docs.select("bucket", F.lit(False).alias("head"), "_v", "text").unionByName(first)


def edited(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness; the edit takes the second half from the next row by (doc_id, text).

    Buckets are sorted and read as a stream of which one row is held at a time, whatever their size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, id, text, digest of the row whose next one is to come
        for batch in batches:
            ids: list = []
            n_chars, hashes, own, new, after = [], [], [], [], []
            for bucket, head, v, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None and head:
                    continue  # another head, or one of a bucket that is done
                d = digest(text.encode())
                if held is not None and held[0] == bucket:
                    half = len(held[2]) // 2
                    data = (held[2][: len(held[2]) - half] + text[:half]).encode()
                    ids.append(None if held[1] == NO_ID else held[1])
                    n_chars.append(len(held[2]))
                    hashes.append(sha256(data))
                    own.append(held[3])
                    new.append(digest(data))
                    after.append(d)
                held = None if head else (bucket, v, text, d)
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array(n_chars, pa.int64()), "edited_sha256": pa.array(hashes, pa.string()), "fingerprint": pa.array([x.hex() for x in own], pa.string()), "edited_fingerprint": pa.array([x.hex() for x in new], pa.string()), "near_edited": pa.array(likeness(own, new), pa.float64()), "near_next": pa.array(likeness(own, after), pa.float64())})

    rows = with_next(docs, group_bytes).repartition("bucket").sortWithinPartitions("bucket", "head", "_v", "text")
    return rows.select("bucket", "head", "_v", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited(read(spark, sf_dir, "documents"))
