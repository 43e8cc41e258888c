"""N-gram Jaccard join: universe partition by the pigeonhole principle, with one-deletion neighbourhoods.

Texts (A-Z in lower case) become sets of hashed shingles of `width` words; two sets link when
100 * |A and B| >= percent * |A or B|, that is, when their symmetric difference is at most
(|A| + |B|) * (100 - percent) // (100 + percent).

1. Equal sets are one class. Each class has a 63-bit key and a parity sketch of about a bit an element, whose
   Hamming distance never exceeds the symmetric difference.
2. Sizes fall into bands whose ends differ by the threshold, so linked sets are in the same or in neighbouring
   bands. A set takes part in the instance of its own band (natively) and in the next one.
3. An instance that allows H differences hashes the universe into `a` exact and `d` one-deletion segments with
   a + 2 d = H + 1, and some spare ones for the empty. Of two linked sets at least one exact segment is equal,
   or one deletion segment differs by at most one. Signatures are the segment's sum, and for deletion segments also the sums without each
   element. How many of each kind is chosen by estimated cost from the number of documents in each band.
4. Signatures are dealt by hash and sorted; a bucket is a run of one signature with two classes or more, one of
   them native. Inside a bucket, sketches rule pairs out, and the pairs left are reduced to a least
   spanning forest by sketch distance. Its edges are compared exactly, the nearest first, as far as their ends aren't
   yet in one component. Where all edges of a bucket lie inside components, it is joined up. The other buckets
   are met again, and every pair left there between different components is compared.
   So no link between different texts is lost, and dense groups cost a few comparisons a member. A bucket of more
   than HOT classes is split into blocks with common pivots; on the second meeting only its components meet, the
   largest once with all others, so a bucket that is one component by then costs nothing more. Of m classes outside the
   largest component, m * m / 2 sketches are compared, in blocks of CELL.
5. Components: labels take the least neighbour's and then jump to their label's label, until they rest.

A text of fewer words than `width` has its whole word sequence as one shingle; one without words or null has an empty
set and links with nothing. Repeated rows and repeated ids are kept, a row each. A null doc_id counts
as the lowest id and is returned as null (the id -2^63+1 stands for it). Words and texts of any length are hashed whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, M1, M2, M3, chunks, column, mix, own, read, written

WIDTH, PERCENT = 3, 90
#: What holds for near-duplicate stages of a pipeline.
STAGE_WIDTH, STAGE_PERCENT = 5, 80
NO_ID = -(1 << 63) + 1
#: Bytes of text hashed in one numpy step.
PIECE = 1 << 18
BITS, MOST_BITS = 512, 1 << 16
#: Ids (16 bytes each) that are broadcast at most; beyond, joins shuffle.
BROADCAST_IDS = 1_000_000
#: Buckets of more classes are split into blocks of about half as many; PIVOTS of their classes stand in every block.
HOT, PIVOTS = 256, 8
#: Classes of one side of a cell, about, when the components of a split bucket meet again.
CELL = 8192
#: What a pair that meets costs, in signatures.
PAIR_COST = 5.0
#: Rounds of comparisons; the last compares whatever is left.
ROUNDS = 5
#: Classes a worker remembers to leave out signatures of copies; others are found equal later.
SEEN = 200_000
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * M1)
#: Odd factors of the places inside a stretch of a word; each stretch has one more of its own.
STRETCH = 1 << 12
FACTORS = mix(np.arange(STRETCH, dtype=np.uint64) * M1 + M2) | np.uint64(1)
EVEN = ~np.uint64(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word between white space, in steps of bounded size."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not SEPARATOR[data[end]]:
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        w = np.r_[False, ~SEPARATOR[b], False]
        edge = np.flatnonzero(w[1:] != w[:-1])
        first, last = edge[::2], edge[1::2]
        if len(first):
            size = last - first
            place = np.arange(len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)])) if first[0] == 0 else np.r_[np.zeros(first[0], np.int64), np.arange(first[0], len(b)) - np.repeat(first, np.diff(np.r_[first, len(b)]))]
            value = BYTE[b] * FACTORS[place & STRETCH - 1]
            if size.max() > STRETCH:  # the first stretch has the factor 1
                far = mix(np.arange(1 + size.max() // STRETCH, dtype=np.uint64) * M1 + M3) | np.uint64(1)
                far[0] = 1
                value *= far[place >> 12]
            value[SEPARATOR[b]] = 0
            starts.append(first + at)
            hashes.append(mix(np.add.reduceat(value, first) + size.astype(np.uint64)))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts, words = word_hashes(b" ".join(texts).translate(LOWER))
    cut = np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])
    n = max(0, len(words) - width + 1)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) * M1) | np.uint64(1)
    all_ = np.zeros(n, np.uint64)
    for j in range(width):
        all_ += words[j : j + n] * factor[j]
    all_ = mix(all_)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(all_[a : b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            out.append(mix(np.array([(words[a:b] * factor[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def key_of(s: np.ndarray) -> int:
    """A signed number with its last bit free, of a set."""
    return int((mix(np.array([mix(s ^ M1).sum(dtype=np.uint64) + np.uint64(len(s))])) & EVEN).view(np.int64)[0])


def sketch_of(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each of as many cells as the set's size asks for, a power of two."""
    bits = min(MOST_BITS, max(BITS, 1 << (len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s >> np.uint64(9)).astype(np.int64) & bits - 1, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, each folded to the shortest: a cell's parity is that of the cells it unites."""
    least, out = min(map(len, sketches)), []
    for x in sketches:
        x = np.frombuffer(x, np.uint64)
        while 8 * len(x) > least:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.stack(out)


class Bands:
    """Size bands and, once counts are known, the segments of each instance."""

    def __init__(self, percent: int, longest: int = 1 << 40) -> None:
        self.percent, low = percent, 1
        self.low, self.high = [], []
        while low <= longest:
            self.low.append(low)
            self.high.append(low * 100 // percent)
            low = self.high[-1] + 1
        self.starts = np.array(self.low)
        self.exact: dict[int, int] = {}
        self.deleting: dict[int, int] = {}
        self.spare: dict[int, int] = {}

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def differences(self, sizes: int) -> int:
        """Most symmetric difference of linked sets with so many elements together."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def allot(self, counts: dict[int, int]) -> Bands:
        """Exact, deletion and spare segments of each instance, of least cost: signatures, and pairs of unlike sets that would meet.

        Unlike sets meet where both have nothing in a segment. With `spare` more exact segments, a set with no more
        empty ones than that may leave them out: of two linked sets, one that isn't empty is equal all the same.
        """
        for b in {x for k in counts for x in (k, k + 1)}:
            size, most = self.high[b], self.differences(2 * self.high[b])
            docs = counts.get(b, 0) + counts.get(b - 1, 0)
            options = []
            for d in sorted({(most + 1) // 2 * k // 12 for k in range(13)} | set(range(min(4, (most + 1) // 2 + 1)))):
                for spared in (False, True):
                    a, spare, least = most + 1 - 2 * d, 0, self.low[max(0, b - 1)]
                    for _ in range(20 if spared else 0):  # the spare ones make more segments, and so more empty ones
                        empty = (a + d + spare) * math.exp(-least / (a + d + spare))
                        spare = math.ceil(empty + 4 * math.sqrt(empty))
                    a += spare
                    t = size / (a + d)
                    equal = math.exp(-2 * t)
                    options.append((docs * (a + d * (1 + t)) + PAIR_COST * docs * docs * ((0 if spared else a) * equal + d * equal * (1 + 2 * t)), d, a, spare))
            _, d, a, spare = min(options)
            self.exact[b], self.deleting[b], self.spare[b] = (a, d, spare) if most else (0, 0, 0)
        return self

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a set, and whether each is of its own band."""
        own, native = [], []
        value, b = mix(s + M1), self.of(len(s))
        for inst in (b, b + 1):
            a, d = self.exact[inst], self.deleting[inst]
            if not a + d:
                continue
            cell = ((s >> np.uint64(20)) % np.uint64(a + d)).astype(np.int64)
            total = np.zeros(a + d, np.uint64)
            np.add.at(total, cell, value)
            tag = mix((np.arange(a + d, dtype=np.uint64) << np.uint64(16)) + np.uint64(inst))
            filled = np.bincount(cell, minlength=a + d) > 0
            filled[a:] = True
            whole = filled if (~filled).sum() <= self.spare[inst] else np.ones(a + d, bool)
            sigs = [mix(total ^ tag)[whole]]
            if d:
                some = cell >= a
                sigs.append(np.unique(mix((total[cell[some]] - value[some]) ^ tag[cell[some]])))
            own += sigs
            native.append(np.full(sum(map(len, sigs)), inst == b))
        return (np.concatenate(own), np.concatenate(native)) if own else (np.zeros(0, np.uint64), np.zeros(0, bool))


def _sets(docs: DataFrame, width: int, schema: str, make) -> DataFrame:
    """mapInArrow over (doc_id, text) that hands `make` (ids, sets) of runs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for part, rows in chunks(batch, 1):
                yield make(part.column(0), shingle_sets(rows, width), state)

    return docs.select(F.coalesce(column(docs, "doc_id", "long"), F.lit(NO_ID)).alias("doc_id"), column(docs, "text", "string").alias("text")).mapInArrow(run, schema)


def classes(docs: DataFrame, bands: Bands, width: int) -> DataFrame:
    """(doc_id, n, band, key, sketch) of each row; an empty set has no key."""

    def make(ids: pa.Array, sets: list[np.ndarray], _: dict) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": ids, "n": pa.array([len(s) for s in sets], pa.int64()), "band": pa.array([bands.of(len(s)) if len(s) else None for s in sets], pa.int32()), "key": pa.array([key_of(s) if len(s) else None for s in sets], pa.int64()), "sketch": pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary())})

    return _sets(docs, width, "doc_id long, n long, band int, key long, sketch binary", make)


def signatures(docs: DataFrame, bands: Bands, width: int) -> DataFrame:
    """(sig, key): every signature of each class; the last bit of key tells native ones."""
    shared = docs.sparkSession.sparkContext.broadcast(bands)

    def make(_: pa.Array, sets: list[np.ndarray], seen: dict) -> pa.RecordBatch:
        bands, sig, key = shared.value, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s in sets:
            if len(s):
                k = key_of(s)
                if k in seen:
                    continue
                if len(seen) < SEEN:
                    seen[k] = True
                own, native = bands.signatures(s)
                sig.append(own)
                key.append(np.int64(k) | native.astype(np.int64))
        return pa.record_batch({"sig": pa.array(np.concatenate(sig).view(np.int64)), "key": pa.array(np.concatenate(key))})

    return _sets(docs, width, "sig long, key long", make)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray | pa.Array]]:
    """Batches regrouped so that rows of one sig (the first column, sorted) come together."""
    carry: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([carry, table]) if carry is not None and carry.num_rows else table
        sig = table.column(0).to_numpy()
        if not len(sig):
            continue
        end = int(np.searchsorted(sig, sig[-1]))
        carry = table.slice(end)
        if end:
            yield [c.combine_chunks() for c in table.slice(0, end).columns]
    if carry is not None and carry.num_rows:
        yield [c.combine_chunks() for c in carry.columns]


def buckets(sigs: DataFrame) -> DataFrame:
    """(sig, key) of signatures that two classes or more share, one of them native.

    Native ones come first, so that a bucket, however large, is read as a stream of which one row is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None  # the row before
        native, held = False, None  # of its bucket: whether it has a native class; its only row so far
        for batch in batches:
            sig, key = (c.to_numpy() for c in batch.columns)
            before = last or (None, None)
            new = np.r_[(sig[:1] != before[0]) | (key[:1] != before[1]), (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
            sig, key = sig[new], key[new]
            if not len(sig):
                continue
            goes_on = sig[0] == before[0]
            starts = np.r_[0, np.flatnonzero(sig[1:] != sig[:-1]) + 1]
            size = np.diff(np.r_[starts, len(sig)])
            has, many = (key[starts] & 1).astype(bool), size > 1
            if goes_on:
                has[0], many[0] = native, True
            keep = np.repeat(has & many, size)
            out_sig, out_key = sig[keep], key[keep]
            if goes_on and has[0] and held is not None:
                out_sig, out_key = np.r_[held[0], out_sig], np.r_[held[1], out_key]
            native = bool(has[-1])
            held = None if many[-1] else (sig[-1], key[-1])
            last = (sig[-1], key[-1])
            yield pa.record_batch({"sig": pa.array(out_sig), "key": pa.array(out_key)})

    return sigs.repartition("sig").sortWithinPartitions("sig", (F.col("key").bitwiseAND(F.lit(1))).desc(), "key").mapInArrow(run, "sig long, key long")


def crowded(met: DataFrame) -> DataFrame:
    """(sig, parts) of buckets that are split; written."""
    sizes = met.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > HOT)
    return written(sizes.select("sig", F.ceil(F.col("k") * 2 / HOT).cast("long").alias("parts")), "crowded")


def _block(parts) -> F.Column:
    """The block of a class, by the hash of its key without the last bit."""
    return F.pmod(F.xxhash64(F.col("key").bitwiseAND(F.lit(-2))), parts)


def _upto(n) -> F.Column:
    """A row for each number below n (none if n is 0)."""
    return F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))


def cells(met: DataFrame, hot: DataFrame) -> DataFrame:
    """(sig, key, side -1): buckets as they are dealt to tasks; of those of `hot`, each block with the bucket's pivots under a number of its own."""
    if not hot.limit(1).count():
        return met.withColumn("side", F.lit(-1))
    rows = with_few(met, hot, "sig", "left")
    cold = rows.filter("parts IS NULL").select("sig", "key")
    warm = rows.filter("parts IS NOT NULL").withColumn("block", _block(F.col("parts")))
    pivots = warm.groupBy("sig", "parts", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(PIVOTS)).alias("turn")).agg(F.min("key").alias("key"))
    pivots = pivots.withColumn("block", _block(F.col("parts"))).withColumn("other", _upto(F.col("parts"))).filter("other <> block")
    dealt = warm.select("sig", "key", "block").union(pivots.select("sig", "key", "other")).select(F.xxhash64("sig", "block").alias("sig"), "key")
    return cold.union(dealt).withColumn("side", F.lit(-1))


def apart(met: DataFrame, hot: DataFrame, open_: DataFrame, comps: DataFrame) -> DataFrame:
    """(sig, key, comp, side): buckets with classes of several components left; split ones in cells of which only pairs of different sides (or all: side -1) are due.

    Of a split bucket, the classes of its largest component meet all others, and the others meet each other, in
    blocks of about CELL classes. A bucket that is one component by now is not dealt at all.
    """
    of = lambda rows: rows.join(comps, rows["key"].bitwiseAND(F.lit(-2)) == comps["_c"], "left").select("sig", "key", F.coalesce("comp", F.col("key").bitwiseAND(F.lit(-2))).alias("comp"))
    cold = of(with_few(met, open_.join(hot.select("sig"), "sig", "left_anti"), "sig", "left_semi")).withColumn("side", F.lit(-1))
    if not hot.limit(1).count():
        return cold
    warm = written(of(with_few(met, hot.select("sig"), "sig", "left_semi")), "crowded")
    sizes = warm.groupBy("sig", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("sig").agg(F.max(F.struct("n", "comp")).alias("big"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    parts = lambda n: F.ceil(n / CELL).cast("long")
    sizes = written(sizes.select("sig", F.col("big.comp").alias("big"), parts(F.col("big.n")).alias("ours"), parts(F.col("n") - F.col("big.n")).alias("theirs")), "crowded")
    rows = with_few(warm, sizes, "sig", "inner").withColumn("of_big", F.col("comp") == F.col("big"))
    rows = rows.withColumn("block", _block(F.when(F.col("of_big"), F.col("ours")).otherwise(F.col("theirs"))))
    ours = rows.filter("of_big").withColumn("other", _upto(F.col("theirs"))).select(F.xxhash64("sig", F.lit(1), "block", "other").alias("sig"), "key", "comp", F.lit(0).alias("side"))
    rest = rows.filter("NOT of_big")
    theirs = rest.withColumn("other", _upto(F.col("ours"))).select(F.xxhash64("sig", F.lit(1), "other", "block").alias("sig"), "key", "comp", F.lit(1).alias("side"))
    among = rest.withColumn("other", _upto(F.col("theirs"))).select(F.xxhash64("sig", F.lit(2), F.least("block", "other"), F.greatest("block", "other")).alias("sig"), "key", "comp", F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"))
    return cold.union(ours).union(theirs).union(among)


def _near(x: np.ndarray, n: np.ndarray, native: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Sketch distance of member i from others; where it proves that they aren't linked, the largest number."""
    far = np.bitwise_count(x[others] ^ x[i]).sum(axis=1, dtype=np.int64)
    sizes = n[others] + n[i]
    ok = (far <= sizes * (100 - percent) // (100 + percent)) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])) & (native[others] | native[i])
    return np.where(ok, far, np.iinfo(np.int64).max)


def forest(x: np.ndarray, n: np.ndarray, native: np.ndarray, percent: int) -> list[tuple[int, int, int]]:
    """Edges (place, place, distance) of a least spanning forest of the pairs that sketches leave; ties go to the lower place."""
    none = np.iinfo(np.int64).max
    left, best, parent, out = np.ones(len(n), bool), np.full(len(n), none), np.zeros(len(n), np.int64), []
    at = 0
    for _ in range(len(n)):
        left[at] = False
        rest = np.flatnonzero(left)
        if not len(rest):
            break
        far = _near(x, n, native, at, rest, percent)
        closer = far < best[rest]
        best[rest[closer]], parent[rest[closer]] = far[closer], at
        at = int(rest[best[rest].argmin()])
        if best[at] < none:
            out.append((int(parent[at]), at, int(best[at])))
    return out


def _pairs(members: DataFrame, percent: int, every: bool) -> DataFrame:
    """(sig, a, b, d), a < b, d the sketch distance: of each bucket the forest's edges, or every pair left between different components (comp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in runs(batches):
            sig, key, n = (c.to_numpy() for c in cols[:3])
            sketches, side, comp = cols[3].to_pylist(), cols[4].to_numpy(), cols[5].to_numpy() if every else None
            native, key = (key & 1).astype(bool), key & ~1
            first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[first, len(sig)])
            none = np.zeros(0, np.int64)
            left, right, apart = [none], [none], [none]
            for f, k in zip(first.tolist(), size.tolist(), strict=True):
                s = slice(f, f + k)
                if every and (comp[s] == comp[f]).all():
                    continue
                x = folded(sketches[s])
                if every:
                    for i in range(k - 1):
                        rest = np.arange(i + 1, k)
                        rest = rest[(comp[s][rest] != comp[f + i]) & ((side[s][rest] != side[f + i]) | (side[f + i] < 0))]
                        if len(rest):
                            d = _near(x, n[s], native[s], i, rest, percent)
                            rest, d = rest[d < np.iinfo(np.int64).max], d[d < np.iinfo(np.int64).max]
                            left.append(np.full(len(rest), f + i))
                            right.append(f + rest)
                            apart.append(d)
                elif edges := forest(x, n[s], native[s], percent):
                    e = np.array(edges)
                    left.append(e[:, 0] + f)
                    right.append(e[:, 1] + f)
                    apart.append(e[:, 2])
            i, j = np.concatenate(left), np.concatenate(right)
            yield pa.record_batch({"sig": pa.array(sig[i]), "a": pa.array(np.minimum(key[i], key[j])), "b": pa.array(np.maximum(key[i], key[j])), "d": pa.array(np.concatenate(apart), pa.int64())})

    return members.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(run, "sig long, a long, b long, d long")


def with_few(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with ids (and a number for each): broadcast if ids are few (counted), else shuffled."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def sets_of(docs: DataFrame, reps: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, set) of some classes, each from the text of its lowest doc_id; written."""
    ids = written(keys.join(reps, "key").select("doc_id").distinct(), "ids")

    def make(_: pa.Array, sets: list[np.ndarray], __: dict) -> pa.RecordBatch:
        return pa.record_batch({"key": pa.array([key_of(s) for s in sets], pa.int64()), "set": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    plain = docs.select(F.coalesce(column(docs, "doc_id", "long"), F.lit(NO_ID)).alias("doc_id"), column(docs, "text", "string").alias("text"))
    return written(_sets(with_few(plain, ids, "doc_id", "left_semi"), width, "key long, set array<long>", make).dropDuplicates(["key"]), "sets")


def compared(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for pairs (own, other), by the exact size of the intersection; written. Where each own occurs once, each set is moved once for it."""
    both = pairs.join(sets.withColumnsRenamed({"key": "own", "set": "x"}), "own").join(sets.withColumnsRenamed({"key": "other", "set": "y"}), "other")
    common = F.size(F.array_intersect("x", "y"))
    return written(both.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (100 * common >= percent * (F.size("x") + F.size("y") - common)).alias("linked")), "compared")


def resolved(sets: DataFrame, pairs: DataFrame, percent: int, links: DataFrame | None = None, rounds: int = ROUNDS) -> tuple[DataFrame | None, DataFrame | None]:
    """Links and labels once every pair (a, b, d) is compared or lies inside a component.

    In each round every class between two components compares its nearest untested pair, which joins dense
    groups in a few rounds of at most one comparison a class; the last round compares all that is left.
    """
    labels = components(links) if links is not None else None
    for last in (k == rounds - 1 for k in range(rounds)):
        left = pairs
        if labels is not None:
            for end in "ab":
                left = left.join(labels.select(F.col("key").alias(end), F.col("comp").alias(f"c{end}")), end, "left")
            left = left.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b", "d")
        pairs = left = written(left, "left")
        if not left.limit(1).count():
            break
        if last:
            chosen = left.select(F.col("a").alias("own"), F.col("b").alias("other"))
        else:
            ends = left.select(F.col("a").alias("own"), F.struct("d", F.col("b").alias("other")).alias("p")).union(left.select(F.col("b").alias("own"), F.struct("d", F.col("a").alias("other")).alias("p")))
            best = ends.groupBy("own").agg(F.min("p").alias("p")).select("own", F.col("p.other").alias("other"))
            chosen = best.groupBy(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).agg(F.min(F.struct("own", "other")).alias("p")).select("p.own", "p.other")
        tested = compared(sets, chosen, percent)
        pairs = left.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        found = tested.filter("linked").select("a", "b")
        if found.limit(1).count():
            links = found if links is None else links.union(found)
            labels = components(links)
    return links, labels


def components(links: DataFrame) -> DataFrame:
    """(key, comp) for every end of a link (a, b): comp is one of the keys of its component."""
    ends = written(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("key", "other"), "links")
    labels = written(ends.groupBy("key").agg(F.least(F.first("key"), F.min("other")).alias("comp")), "labels")
    while True:
        near = ends.join(labels.withColumnsRenamed({"key": "other", "comp": "c"}), "other").groupBy("key").agg(F.min("c").alias("c"))
        step = labels.join(near, "key").select("key", F.least("comp", "c").alias("next"), "comp")
        jump = step.join(step.select(F.col("key").alias("next"), F.col("next").alias("far")), "next").select("key", F.least("next", "far").alias("next"), "comp")
        new = written(jump, "labels")
        changed = bool(new.filter("next != comp").limit(1).count())
        labels = new.select("key", F.col("next").alias("comp"))
        if not changed:
            return labels


def linked_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: component_id is the smallest doc_id reachable by links."""
    bands = Bands(percent)
    every = written(classes(docs, bands, width), "classes")
    counts = {r["band"]: r["n"] for r in every.filter("band IS NOT NULL").groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each band
    reps = written(every.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), "classes")
    met = written(buckets(signatures(docs, bands.allot(counts), width)), "buckets")
    sketched = reps.select(F.col("key").alias("_k"), "n", "sketch")
    members = lambda rows: rows.join(sketched, rows["key"].bitwiseAND(F.lit(-2)) == F.col("_k"))
    hot = crowded(met)
    edges = written(_pairs(members(cells(met, hot)).select("sig", "key", "n", "sketch", "side"), percent, False), "edges")
    pairs = written(edges.groupBy("a", "b").agg(F.min("d").alias("d")), "pairs")
    if not pairs.limit(1).count() and not hot.limit(1).count():  # split buckets still have blocks to compare
        return _rows(every, reps, None)
    sets = sets_of(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), width)
    links, labels = resolved(sets, pairs, percent)
    if links is None:
        labels = pairs.limit(0).select(F.col("a").alias("key"), F.col("b").alias("comp"))
    comps = labels.select(F.col("key").alias("_c"), "comp")
    ends = edges.select("sig", "a", "b").join(comps.withColumnsRenamed({"_c": "a", "comp": "ca"}), "a", "left").join(comps.withColumnsRenamed({"_c": "b", "comp": "cb"}), "b", "left")
    open_ = written(ends.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("sig").distinct(), "open")
    again = members(apart(met, hot, open_, comps)).select("sig", "key", "n", "sketch", "side", "comp")
    more = written(_pairs(again, percent, True).groupBy("a", "b").agg(F.min("d").alias("d")).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        lacking = more.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(sets.select("key"), "key", "left_anti")
        links, labels = resolved(sets.union(sets_of(docs, reps, lacking, width)), more, percent, links)
    return _rows(every, reps, labels if labels is not None else comps.toDF("key", "comp"))


def _rows(every: DataFrame, reps: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The result, from the classes' labels; only classes with copies or links are looked up."""
    of_key = reps.filter("copies > 1").select("key", F.col("doc_id").alias("component_id"))
    if labels is not None:
        lowest = written(reps.select("key", "doc_id").join(labels, "key").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "lowest")
        linked = with_few(labels, lowest, "comp", "inner").select("key", "component_id")
        of_key = of_key.join(linked.select("key"), "key", "left_anti").union(linked)
    none = F.lit(NO_ID)
    rows = with_few(every.select("doc_id", "n", "key"), written(of_key, "components"), "key", "left")
    return rows.select(F.nullif("doc_id", none).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component_id", "doc_id"), none).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = STAGE_WIDTH, percent: int = STAGE_PERCENT) -> DataFrame:
    """Of each component, the rows of its smallest doc_id, equal ones once.

    Rows without an id take part under a number above 2^62 made of the hash of their text, so of a component with ids they go,
    and of one without, the rows of one text stay once. Texts without words all stay. An id given to several texts goes only where none of
    them is the lowest of its component. docs needs doc_id and text; other columns keep their names and values.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    rows = written(linked_components(docs.select(number.alias("doc_id"), "text"), width, percent).filter("n_shingles > 0"), "components")
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    mine = next(c for c in ("_number", "_number_", "_number__", "_number___") if c not in {x.lower() for x in docs.columns})
    numbered = docs.withColumn(mine, number)
    gone = written(ids.filter("NOT stays").select(F.col("doc_id").alias(mine)), "gone")
    kept = with_few(numbered, gone, mine, "left_anti")
    twice = written(ids.filter("stays AND n > 1").select(F.col("doc_id").alias(mine)), "twice")
    if twice.limit(1).count():
        some = with_few(kept, twice, mine, "left_semi").dropDuplicates([mine, "text"])
        kept = with_few(kept, twice, mine, "left_anti").select(*own(docs)).union(some.select(*own(docs)))
    return kept.select(*own(docs))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more."""
    return linked_components(read(spark, sf_dir, "documents"))
