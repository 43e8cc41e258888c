"""SentencePiece encoding and decoding: batched Viterbi in numpy over a piece file.

A text gets one space in front, spaces become U+2581, and it falls into words: marks of space and what follows
up to the next such mark, a line feed alone. No piece crosses these borders, so the best path of a text is the
best paths of its words. Different words of equal length advance together: for each substring length, hashes
of all substrings probe the sorted keys of the pieces (their low bits choose a place in a direct table over the sorted keys, which answers most probes at once), and for each end position one maximum over the lengths
stores the backpointer. Equal sums go to the longer last piece. A character without a piece becomes the pieces
of its UTF-8 bytes; so does U+2581 where the text itself holds it, which keeps decoding exact.

The path has the greatest sum of scores. For a file whose scores are merge ranks, that is the unigram
reading of its vocabulary, not the order of merges.

Null is the empty text, which has no pieces. An empty table gives no rows; columns named like the added ones are replaced. Any text, however long, is encoded whole: decode(encode(t)) == t.
Rows keep their other columns; repeated rows are encoded alike.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusloom.llm.common import bounded, chunks, mix, read, sha256

#: A public piece file.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a key that choose its place in a direct table over the sorted keys.
LOW = np.uint64((1 << 20) - 1)
#: Words whose pieces a worker keeps.
KEPT = 100_000
#: Cells (words times letters) of one Viterbi batch.
CELLS = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if key & 7 == 5 else 8
            value, at = data[at : at + n], at + n
        yield key >> 3, value


@dataclass
class Pieces:
    """Pieces by number, with kinds and scores."""

    names: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    prefix: bool

    @staticmethod
    def load(path: str = PIECES) -> Pieces:
        """From a model file, read on the driver; only files without text normalisation fit."""
        with open(path, "rb") as f:
            data = f.read()
        names, scores, kinds, prefix = [], [], [], True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif field == 3:
                rules = dict(_fields(value))
                prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("the file asks for text normalisation")
        pieces = Pieces(names, np.array(scores), np.array(kinds, np.int8), prefix)
        if any(re.search("[^▁]▁|.\n|\n.", n, re.DOTALL) for n, k in zip(names, kinds, strict=True) if k in (NORMAL, USER)):
            raise ValueError("a piece goes on beyond a space or line feed")
        return pieces


class Codec:
    """Encodes and decodes with one set of pieces; keeps the words it has met."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        usable = np.flatnonzero(np.isin(pieces.kinds, (NORMAL, USER)))
        self.longest = max((len(pieces.names[i]) for i in usable), default=1)
        self.codes = np.zeros((len(pieces.names), self.longest), np.uint32)
        keys = np.zeros(len(usable), np.uint64)
        power = np.cumprod(np.r_[np.uint64(1), np.full(self.longest, BASE)], dtype=np.uint64)
        self.power = power
        for k, i in enumerate(usable):
            c = np.frombuffer(pieces.names[i].encode("utf-32-le"), np.uint32)
            self.codes[i, : len(c)] = c
            keys[k] = mix(np.array([(c.astype(np.uint64) * power[: len(c)][::-1]).sum(dtype=np.uint64) + np.uint64(len(c))]))[0]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], usable[order].astype(np.int32)
        # place of the key with these low bits: -1 if there is none, -2 if there are several
        low = (self.keys & LOW).astype(np.int64)
        self.place = np.full(int(LOW) + 1, -1, np.int32)
        self.place[low] = np.arange(len(low))
        self.place[np.flatnonzero(np.bincount(low, minlength=int(LOW) + 1) > 1)] = -2
        normal = pieces.scores[pieces.kinds == NORMAL]
        self.unknown = float(normal.min() if len(normal) else 0.0) - 10.0
        self.bytes_ = np.full(256, max(0, int(np.argmax(pieces.kinds == UNKNOWN))), np.int32)
        out = []
        for i, (n, k) in enumerate(zip(pieces.names, pieces.kinds, strict=True)):
            if k == BYTE:
                self.bytes_[int(n[1:-1], 16)] = i
                out.append(bytes([int(n[1:-1], 16)]))
            else:
                out.append(n.replace(MARK, " ").encode() if k in (NORMAL, USER) else b"")
        self.out = out
        if not (pieces.kinds == BYTE).sum() == 256:
            raise ValueError("the file has no piece for each byte")
        self.known: dict[str, bytes] = {}

    def probe(self, h: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
        """Piece number of each substring of n letters, by the hashes of prefixes, or -1."""
        width = codes.shape[1] - n + 1
        key = mix(h[:, n:] - h[:, :width] * self.power[n] + np.uint64(n))
        found = np.full(key.shape, -1, np.int32)
        place = self.place[(key & LOW).astype(np.int64)]
        row, col = np.nonzero(place != -1)
        at, key = place[row, col], key[row, col]
        several = at == -2
        at[several] = np.minimum(np.searchsorted(self.keys, key[several]), len(self.keys) - 1)
        good = self.keys[at] == key
        row, col, ids = row[good], col[good], self.ids[at[good]]
        same = np.ones(len(ids), bool)
        for j in range(n):
            same &= codes[row, col + j] == self.codes[ids, j]
        found[row[same], col[same]] = ids[same]
        return found

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Pieces (32-bit numbers) of words of one length, all advancing by one letter at a time."""
        count, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(count, length)
        h = np.zeros((count, length + 1), np.uint64)
        for j in range(length):
            h[:, j + 1] = h[:, j] * BASE + codes[:, j]
        most = min(self.longest, length)
        ids = np.full((most, count, length), -1, np.int32)  # [letters - 1, word, start]
        for n in range(1, most + 1):
            ids[n - 1, :, : length - n + 1] = self.probe(h, codes, n)
        scores = np.where(ids >= 0, self.pieces.scores[ids], -np.inf)
        scores[0] = np.where(ids[0] >= 0, scores[0], self.unknown)
        best = np.full((length + 1, count), -np.inf)
        best[0] = 0.0
        back = np.zeros((length + 1, count), np.int32)
        rows = np.arange(count)
        for j in range(1, length + 1):
            sizes = range(min(most, j), 0, -1)  # the longest first: the first of equal sums is taken
            sums = np.stack([best[j - n] + scores[n - 1, :, j - n] for n in sizes])
            k = sums.argmax(axis=0)
            best[j], back[j] = sums[k, rows], min(most, j) - k
        piece = np.full((count, length), -2, np.int32)  # by start; -2: no piece starts here
        at = np.full(count, length)
        while len(live := np.flatnonzero(at > 0)):
            n = back[at[live], live]
            start = at[live] - n
            piece[live, start] = ids[n - 1, live, start]
            at[live] = start
        ends = np.r_[0, np.cumsum((piece >= 0).sum(axis=1))] * 4
        data = piece[piece >= 0].tobytes()
        out = [data[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for w in np.flatnonzero((piece == -1).any(axis=1)):
            p = [self.bytes_[np.frombuffer(words[w][i].encode("utf-8", "surrogatepass"), np.uint8)] if x == -1 else [x] for i, x in enumerate(piece[w]) if x != -2]
            out[w] = np.concatenate(p).astype(np.int32).tobytes()
        return out

    def learn(self, words: set[str]) -> None:
        """Encode new words, those of equal length together."""
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for length, group in by.items():
            step = max(1, CELLS // (length * min(length, self.longest)))
            for i in range(0, len(group), step):
                self.known.update(zip(group[i : i + step], self.viterbi(group[i : i + step]), strict=True))

    split = staticmethod(re.compile("▁+[^▁\n]*|[^▁\n]+|\n").findall)

    def words(self, text: str) -> list[str]:
        """Words of a text, a mark of its own as the lone character U+2581 with a zero before it."""
        if not text:
            return []
        if MARK not in text:
            return self.split((MARK if self.pieces.prefix else "") + text.replace(" ", MARK))
        out: list[str] = []
        for i, part in enumerate(text.split(MARK)):
            out += ["\0" + MARK] if i else []
            part = part.replace(" ", MARK)
            out += self.split((MARK if self.pieces.prefix and not i else "") + part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece numbers of each text."""
        own = "\0" + MARK
        rows = [self.words(t) for t in texts]
        now = {w for r in rows for w in r}
        if len(self.known) > KEPT:  # what this run of texts holds is the likeliest to come again
            self.known = {w: self.known[w] for w in now if w in self.known}
        self.known[own] = self.bytes_[np.frombuffer(MARK.encode(), np.uint8)].tobytes()
        self.learn(now.difference(self.known))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, r)), np.int32) for r in rows]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece numbers."""
        data = b"".join(map(self.out.__getitem__, ids.tolist()))
        return data[1 if self.pieces.prefix else 0 :].decode("utf-8", "replace")


def _mapped(docs: DataFrame, pieces: Pieces, schema: StructType, make: Callable) -> DataFrame:
    bounded(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(pieces), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for part, texts in chunks(batch, at):
                yield make(codec, part, [t.decode("utf-8", "replace") for t in texts])

    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """The rows with token_ids array<int> in place of a column of this name; `text` is the text."""
    docs = docs.drop("token_ids")

    def make(codec: Codec, part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        ids = codec.encode(texts)
        offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
        return pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))], [*part.schema.names, "token_ids"])

    return _mapped(docs, pieces, StructType([*docs.schema.fields, StructField("token_ids", ArrayType(IntegerType()))]), make)


def decoded(tokens: DataFrame, pieces: Pieces) -> DataFrame:
    """The rows with decoded string from token_ids; null ids are the empty text."""
    from pyspark.sql.types import StringType

    shared = tokens.sparkSession.sparkContext.broadcast(pieces)
    tokens = tokens.drop("decoded")
    at = tokens.columns.index("token_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([codec.decode(np.array(x or [], np.int32)) for x in batch.column(at).to_pylist()], pa.string())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField("decoded", StringType())]))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with token_ids."""
    return encoded(docs, Pieces.load())


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's pieces, digest of the text decoded from them, and whether it is the text."""
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"

    def make(codec: Codec, part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        ids = codec.encode(texts)
        back = [codec.decode(i) for i in ids]
        return pa.record_batch({"doc_id": part.column(0), "n_tokens": pa.array([len(i) for i in ids], pa.int64()), "ids_sha256": pa.array([sha256(i.tobytes()) for i in ids], pa.string()), "decoded_sha256": pa.array([sha256(b.encode()) for b in back], pa.string()), "exact": pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())})

    return _mapped(read(spark, sf_dir, "documents").select("doc_id", "text"), Pieces.load(), fields, make)
