"""Benchmark decontamination: suffix arrays over shards of the training texts, searched for every test suffix.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z in lower case. A shard is a run of documents
of a few MB inside one task. Its suffix array holds, in sorted order, every word position where a test text
could begin to match: a run of test words at least as long as the shortest window, whose first words begin
some test window. The suffixes of all test items are grouped by their window, and each different window is searched
by bisection; its range in the array gives all its places. Each place is then looked up in the suffix array of the
test items, whose neighbours there give the longest verbatim match that begins at it. Items are told from the
windows they hold, so repeated words cost no pairs of places. A window is `window` consecutive words of an item; an item of fewer words, but
not none, is one window.

The items are a query set: they are broadcast in blocks of at most `block_bytes` of text, each block one pass
over the rows, so their number has no cap. Words are numbered in 31 bits, more than a block can hold.
Null and empty texts have no words. Very long texts are searched whole, in a shard of their own. Equal items and
repeated rows count alike; a null item_id is the id "". An empty benchmark or corpus marks nothing. Extra columns pass
through; those named like the found ones are set aside by keep().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from corpusloom.llm.common import M1, WORDS, chunks, column, mix, own, read, set_aside, sha256, written

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Passes over the rows before they are written to the shared folder.
CHAIN = 4
#: Bytes of text in one shard.
SHARD = 4 << 20
#: Bits of a word number; two are compared at a time.
BITS = 31
#: Pairs of documents and items, and places, that one step of work holds.
STEP = 1 << 20
PLACES = 1 << 15


@dataclass
class Tests:
    """A block of test items: the word stream (0 ends an item), its different windows, and their items."""

    words: dict[bytes, int]
    stream: np.ndarray
    item_ids: list[str]
    windows: np.ndarray  # a place of each different window
    length: np.ndarray  # its words
    owners: np.ndarray  # its items, from owners[first[k]] to owners[first[k + 1]]
    first: np.ndarray
    order: np.ndarray  # places of whole windows in order of their suffixes
    heads: np.ndarray  # hashes of the first words of windows, sorted
    lead: int
    shortest: int
    longest: int


def head(stream: np.ndarray, at: np.ndarray, lead: int) -> np.ndarray:
    """A hash of the first words at each place."""
    h = np.zeros(len(at), np.uint64)
    for i in range(lead):
        h = mix(h * M1 + stream[at + i].astype(np.uint64))
    return h


def ranked(stream: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes of a stream by their first `depth` words or more, by doubling."""
    rank, k, n = stream.astype(np.int64), 1, len(stream)
    while True:
        second = np.r_[rank[k:], np.zeros(min(k, n), np.int64)][:n]
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + second, return_inverse=True)
        k *= 2
        if k >= depth or rank.max(initial=0) == n - 1:
            return rank


def build_tests(items: list[tuple[str, bytes]], window: int = WINDOW) -> Tests:
    """Numbers the words of the items and groups their windows."""
    words: dict[bytes, int] = {}
    stream, item_of, length, longest = [], [], [], 0
    for k, (_, text) in enumerate(items):
        ids = [words.setdefault(w, len(words) + 1) for w in text.translate(WORDS).split()]
        n = len(ids)
        longest = max(longest, n)
        size = min(window, n)
        stream += [*ids, 0]
        item_of += [k] * (n + 1)
        length += [size if n and i + size <= n else 0 for i in range(n + 1)]
    if len(words) >= 1 << BITS:
        raise ValueError("a block of test items has too many different words; use smaller blocks")
    size, item = np.array(length, np.int64), np.array(item_of, np.int64)
    stream = np.r_[np.array(stream, np.int32), np.zeros(longest + 3, np.int32)]
    at = suffix_array(stream, np.flatnonzero(size), int(size.max(initial=0)))
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = (size[at[1:]] != size[at[:-1]]) | (common(stream, at[1:], stream, at[:-1], size[at[1:]]) < size[at[1:]])
    group = np.cumsum(new) - 1
    owned = np.unique(group * (len(items) + 1) + item[at]) if len(at) else np.zeros(0, np.int64)
    shortest = int(size[size > 0].min()) if len(at) else 0
    lead = min(3, shortest)
    whole = np.flatnonzero(size == window)
    rank = ranked(stream, longest) if len(whole) else np.zeros(0, np.int64)
    return Tests(words, stream, [i for i, _ in items], at[new], size[at[new]], owned % (len(items) + 1), np.searchsorted(owned // (len(items) + 1), np.arange(int(new.sum()) + 1)), whole[np.argsort(rank[whole], kind="stable")], np.unique(head(stream, at[new], lead)), lead, shortest, longest)


def suffix_array(stream: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions `at` in order of the suffixes that start there; ties beyond `depth` words stay in text order.

    Words are compared two at a time, and only among suffixes still tied. stream ends with two zeros or more.
    """
    if not len(at):
        return at
    pack = lambda p: (stream[p].astype(np.int64) << BITS) | stream[np.minimum(p + 1, len(stream) - 1)]
    key = pack(at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    done = 2
    while done < depth:
        size = np.bincount(group)
        tied = np.flatnonzero((size[group] > 1) & (stream[np.minimum(at + done - 1, len(stream) - 1)] > 0))
        if not len(tied):
            break
        key = pack(np.minimum(at[tied] + done, len(stream) - 1))
        order = np.lexsort((at[tied], key, group[tied]))
        at[tied] = at[tied][order]
        new = np.zeros(len(group), bool)
        g, key = group[tied], key[order]
        new[tied[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        start = np.r_[False, group[1:] != group[:-1]] | new
        group = np.cumsum(start)
        done += 2
    return at


def common(s: np.ndarray, p: np.ndarray, t: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many words the streams share from places p of s and q of t on, at most `most`; a 0 ends a text."""
    n = np.zeros(len(p), np.int64)
    for f in range(0, len(p), PLACES):
        live, width = np.arange(f, min(f + PLACES, len(p))), 4
        while len(live):
            j = np.arange(min(width, int((most[live] - n[live]).max(initial=0))))
            a = s[np.minimum((p[live] + n[live])[:, None] + j, len(s) - 1)]
            b = t[np.minimum((q[live] + n[live])[:, None] + j, len(t) - 1)]
            same = (a == b) & (a > 0) & (j < (most[live] - n[live])[:, None])
            run = np.where(same.all(axis=1), len(j), same.argmin(axis=1) if len(j) else 0)
            n[live] += run
            live = live[(run == len(j)) & (n[live] < most[live])]
            width = min(64, 2 * width)
    return n


def bisect(stream: np.ndarray, sa: np.ndarray, tests: np.ndarray, query: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """For each query, how many suffixes sort below its first `length` words (upper: below or equal)."""
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(sa), np.int64)
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        p, q, most = sa[mid], query[open_], length[open_]
        n = common(stream, p, tests, q, most)
        a, b = stream[np.minimum(p + n, len(stream) - 1)], tests[np.minimum(q + n, len(tests) - 1)]
        below = np.where((n >= most) | (a == b), upper, a < b)
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


@dataclass
class Matches:
    """What one shard holds of the tests: words of each document; merged ranges of hit words; its items; its longest match."""

    n_words: np.ndarray
    ranges: tuple[np.ndarray, np.ndarray, np.ndarray]  # document, first word, words
    items: tuple[np.ndarray, np.ndarray]  # document, item
    longest: tuple[np.ndarray, np.ndarray, np.ndarray]  # document, first word, words; the first of the longest


def matches(docs: list[bytes], tests: Tests) -> Matches:
    """Finds all windows of the tests in one shard."""
    none = np.zeros(0, np.int64)
    get = tests.words.get
    rows = [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)) for w in (t.translate(WORDS).split() for t in docs)]
    n_words = np.fromiter(map(len, rows), np.int64, len(rows))
    nothing = Matches(n_words, (none, none, none), (none, none), (none, none, none))
    if not tests.shortest:
        return nothing
    gap = np.zeros(1, np.int32)
    stream = np.concatenate([x for r in rows for x in (r, gap)] + [np.zeros(4, np.int32)])
    first = np.concatenate([[0], np.cumsum(n_words + 1)])
    # where a run of test words is long enough, and starts as some window does
    known = stream != 0
    ends = np.flatnonzero(~known)
    at = np.flatnonzero(known)
    at = at[ends[np.searchsorted(ends, at)] - at >= tests.shortest]
    at = at[np.isin(head(stream, at, tests.lead), tests.heads)]
    sa = suffix_array(stream, at.astype(np.int64), int(tests.length.max()))
    if not len(sa):
        return nothing
    lo, hi = (bisect(stream, sa, tests.stream, tests.windows, tests.length, upper) for upper in (False, True))
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return nothing
    times = (hi - lo)[found]
    window = np.repeat(found, times)
    p = sa[np.repeat(lo[found] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())]
    size = tests.length[window]
    # hit words, as ranges
    hit = np.cumsum(np.bincount(p, minlength=len(stream)) - np.bincount(p + size, minlength=len(stream))) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    start, end = edge[::2], edge[1::2]
    of = lambda x: np.searchsorted(first, x, side="right") - 1
    # items of each document, from its different windows
    seen = np.unique(of(p) * len(tests.windows) + window)
    doc, window_of = seen // len(tests.windows), seen % len(tests.windows)
    count = (tests.first[1:] - tests.first[:-1])[window_of]
    pairs, f = none, 0
    upto = np.cumsum(count)
    while f < len(seen):
        t = max(f + 1, int(np.searchsorted(upto, (upto[f - 1] if f else 0) + STEP, side="right")))
        c = count[f:t]
        own = tests.owners[np.repeat(tests.first[window_of[f:t]] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())]
        pairs = np.union1d(pairs, np.repeat(doc[f:t], c) * len(tests.item_ids) + own)
        f = t
    # the longest match from each place on: shorter items end with their window, others are looked up among the tests' suffixes
    place, where = np.unique(p, return_inverse=True)
    best = np.zeros(len(place), np.int64)
    np.maximum.at(best, where, size)
    full = np.zeros(len(place), bool)
    full[where[size == tests.length.max()]] = True
    q = place[full]
    if len(tests.order) and len(q):
        most = np.full(len(q), tests.longest, np.int64)
        k = bisect(tests.stream, tests.order, stream, q, most, False)
        for near in (np.maximum(k - 1, 0), np.minimum(k, len(tests.order) - 1)):
            best[full] = np.maximum(best[full], common(stream, q, tests.stream, tests.order[near], most))
    doc = of(place)
    order = np.lexsort((place, -best, doc))
    order = order[np.r_[True, doc[order][1:] != doc[order][:-1]]]
    return Matches(n_words, (of(start), start - first[of(start)], end - start), (pairs // len(tests.item_ids), pairs % len(tests.item_ids)), (doc[order], (place - first[doc])[order], best[order]))


FOUND = StructType([StructField("_words", LongType()), StructField("_spans", ArrayType(LongType())), StructField("_items", ArrayType(StringType())), StructField("_longest", ArrayType(LongType()))])


def _blocks(items: DataFrame, block_bytes: int, window: int) -> Iterator[Tests]:
    items = items.select(F.coalesce(column(items, "item_id", "string"), F.lit("")).alias("id"), F.coalesce(column(items, "text", "string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("b")).first()["b"] or 0
    n = int(size // block_bytes) + 1
    for k in range(n):
        got = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).distinct().orderBy("id", "text").toArrow()
        yield build_tests([(i, t.encode()) for i, t in zip(got["id"].to_pylist(), got["text"].to_pylist(), strict=True)], window)


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with _words (their number), _spans (first word and length of each range of hit words), _items (found in them, sorted) and _longest (first word and length of the longest match, the first of equals; else empty)."""
    out = docs.drop(*FOUND.names)
    at = out.columns.index("text") if "text" in out.columns else None
    plain = out.schema.fields
    for k, tests in enumerate(_blocks(items, block_bytes, window)):
        shared, later = docs.sparkSession.sparkContext.broadcast(tests), k > 0

        def run(batches: Iterator[pa.RecordBatch], shared=shared, later=later) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for whole in batches:
                if at is None:
                    parts = [(whole, [b""] * whole.num_rows)]
                else:
                    parts = chunks(whole, at, SHARD)
                for batch, rows in parts:
                    m = matches(rows, tests)
                    spans: list[list[int]] = [[] for _ in rows]
                    ids: list[list[str]] = [[] for _ in rows]
                    longest: list[list[int]] = [[] for _ in rows]
                    for d, f, z in zip(*(x.tolist() for x in m.ranges), strict=True):
                        spans[d] += (f, z)
                    for d, i in zip(*(x.tolist() for x in m.items), strict=True):
                        ids[d].append(tests.item_ids[i])
                    for d, f, z in zip(*(x.tolist() for x in m.longest), strict=True):
                        longest[d] = [f, z]
                    cells = batch.columns
                    if later:
                        *cells, _, s0, i0, l0 = cells
                        spans = [merged(a + b) if a and b else a or b for a, b in zip(s0.to_pylist(), spans, strict=True)]
                        ids = [a + b for a, b in zip(i0.to_pylist(), ids, strict=True)]
                        longest = [min(a, b, key=lambda x: (-x[1], x[0])) if a and b else a or b for a, b in zip(l0.to_pylist(), longest, strict=True)]
                    ids = [sorted(set(x)) for x in ids]
                    yield pa.RecordBatch.from_arrays([*cells, pa.array(m.n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string())), pa.array(longest, pa.list_(pa.int64()))], names=[*[f.name for f in plain], *FOUND.names])

        out = out.mapInArrow(run, StructType([*plain, *FOUND.fields]))
        if k % CHAIN == CHAIN - 1:
            out = written(out, "decontaminate")
    return out


def merged(spans: list[int]) -> list[int]:
    """Ranges (first, length, ...) in order, those that touch or overlap made one."""
    out: list[int] = []
    for f, n in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and f <= out[-2] + out[-1]:
            out[-1] = max(out[-1], f + n - out[-2])
        else:
            out += (f, n)
    return out


def keep(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without any benchmark window, with their own columns."""
    plain, back = set_aside(docs, FOUND.names)
    return search(plain, read(spark, sf_dir, "benchmark")).filter(F.size("_spans") == 0).drop(*FOUND.names).withColumnsRenamed(back).select(*own(docs))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each document is in the benchmark."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, ids, longest = (b.column(k).to_pylist() for k in (2, 3, 4))
            hit = [sum(x[1::2]) for x in spans]
            yield pa.record_batch({"doc_id": b.column(0), "n_words": b.column(1), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in ids], pa.int64()), "items_sha256": pa.array([sha256(",".join(x).encode()) for x in ids], pa.string()), "contaminated": pa.array([h > 0 for h in hit], pa.bool_()), "longest_match": pa.array([x[1] if x else 0 for x in longest], pa.int64()), "longest_first": pa.array([x[0] if x else None for x in longest], pa.int64())})

    return search(docs, read(spark, sf_dir, "benchmark")).select("doc_id", *FOUND.names).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_first long")
