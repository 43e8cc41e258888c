import hashlib
import random

import pytest

from corpusloom.llm import fingerprint as P
from corpusloom.llm.common import read


def slow_counts(data):
    c = [0] * P.BUCKETS
    for i in range(len(data) - 2):
        c[((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 25] += 1
    return c


def test_counts(monkeypatch):
    data = bytes(random.Random(3).choices(range(256), k=5000))
    assert P.counts(data).tolist() == slow_counts(data)
    monkeypatch.setattr(P, "STEP", 64)
    assert P.counts(data).tolist() == slow_counts(data)
    assert P.counts(b"ab").sum() == 0


def test_difference_is_bounded():
    r = random.Random(4)
    texts = [b"", b"a", b"ab", b"abc"] + [bytes(r.choices(b"abcdefgh ", k=n)) for n in (10, 100, 1000, 20000)]
    digests = [P.digest(t) for t in texts]
    for d in digests:
        assert P.likeness([d], [d])[0] == 1.0
        assert all(0 <= x < 1 for x in P.likeness([d] * len(digests), digests) if x != 1.0)


def test_small_edits_stay_near():
    r = random.Random(5)
    base = bytes(r.choices(b"abcdefghij ", k=4000))
    other = bytes(r.choices(b"klmnopqrst ", k=4000))
    near = base[:2000] + b"edit" + base[2000:]
    a, b, c = map(P.digest, (base, near, other))
    assert P.likeness([a], [b])[0] > 0.9 > 0.8 > P.likeness([a], [c])[0]


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        f, e, n = P.digest(t.encode()), P.digest(new.encode()), P.digest(after.encode())
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), f.hex(), e.hex(), P.likeness([f], [e])[0], P.likeness([f], [n])[0]))
    return out


@pytest.mark.parametrize("size", [1 << 24, 1 << 16])
def test_query(spark, data, size):
    docs = read(spark, data, "documents")
    got = [tuple(r) for r in P.edited(docs, size).collect()]
    assert sorted(got) == sorted(expected([(r.doc_id, r.text) for r in docs.collect()]))


def test_awkward_rows(spark, awkward):
    got = [tuple(r) for r in P.edited(awkward).collect()]
    assert sorted(got, key=str) == sorted(expected([(r.doc_id, r.text) for r in awkward.collect()]), key=str)
    assert P.edited(awkward.limit(0)).count() == 0
    one = awkward.filter("doc_id = 8")
    assert [tuple(r) for r in P.edited(one).collect()] == expected([(8, one.first().text)])
    assert P.fingerprints(awkward).count() == awkward.count()
