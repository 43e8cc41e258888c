import random

import numpy as np
import pytest

from corpusloom.llm import sentencepiece_codec as S
from corpusloom.llm.common import read


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.Pieces.load())


def best(codec, word):
    """Brute force: the greatest sum over all segmentations, longest last piece first among equals."""
    names = {n: i for i, (n, k) in enumerate(zip(codec.pieces.names, codec.pieces.kinds, strict=True)) if k in (S.NORMAL, S.USER)}
    top = [(0.0, [])] + [None] * len(word)
    for j in range(1, len(word) + 1):
        for n in range(min(j, codec.longest), 0, -1):
            piece = word[j - n : j]
            if piece in names:
                s = top[j - n][0] + codec.pieces.scores[names[piece]], top[j - n][1] + [names[piece]]
            elif n == 1:
                s = top[j - n][0] + codec.unknown, top[j - n][1] + codec.bytes_[list(piece.encode())].tolist()
            else:
                continue
            if top[j] is None or s[0] > top[j][0]:
                top[j] = s
    return top[-1][1]


def test_against_brute_force(codec):
    random.seed(1)
    alphabet = "abcdehinorst▁éß漢\U0001f600.,"
    words = {"".join(random.choices(alphabet, k=n)) for n in range(1, 13) for _ in range(40)}
    words |= {"▁the", "▁international", "x" * 40}
    codec.learn(words)
    for w in words:
        assert np.frombuffer(codec.known[w], np.int32).tolist() == best(codec, w), w


@pytest.mark.parametrize("text", ["", " ", "  a  b\n\nc ", "▁", "a▁ ▁b", "\0", "\U0001f600é\t日本", "x" * 20000, "the cat\nsat  on", "\x7f ", " leading", "trailing  "])
def test_round_trip(codec, text):
    assert codec.decode(codec.encode([text])[0]) == text


def test_never_below_the_library(codec):
    """No segmentation of the public library scores higher."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=S.PIECES)
    for text in ("Hello world, this is a test", "internationalisation of anticonstitutional matters"):
        own, other = codec.encode([text])[0], lib.encode(text)
        assert codec.pieces.scores[own].sum() >= codec.pieces.scores[other].sum()
        assert lib.decode(own.tolist()) == text


def test_query(spark, data):
    rows = S.op6_sentencepiece(spark, data).collect()
    assert len(rows) == read(spark, data, "documents").count() and all(r.exact for r in rows)


def test_awkward_rows(spark, awkward):
    pieces = S.Pieces.load()
    tokens = S.encoded(awkward, pieces)
    back = S.decoded(tokens, pieces).collect()
    assert len(back) == awkward.count() and all(r.decoded == (r.text or "") for r in back)
    assert S.encoded(awkward.limit(0), pieces).count() == 0
