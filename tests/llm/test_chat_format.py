import hashlib

from hypothesis import given
from hypothesis import strategies as st

from corpusloom.llm import chat_format as C
from corpusloom.llm.common import read

PIECES = st.lists(st.sampled_from(["[INST]", "[/INST]", "</s>", "\\", "a", "\n", "[", "INST]", "é", "\\\\[INST]"]), max_size=8).map("".join)


@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    t = C.Template()
    formatted = "".join(x for x, _ in t.segments(turns))
    assert t.parsed(formatted) == turns
    assert all(t.plain(t.quoted(x)) == x for pair in turns for x in pair)


def test_machine():
    t = C.Template()
    assert t.valid(["user", "assistant"]) and t.valid(["system", "user", "assistant", "user", "assistant"])
    for bad in ([], ["assistant"], ["user"], ["user", "user", "assistant"], ["system", "assistant"], ["user", "assistant", "system"], ["user", "tool"]):
        assert not t.valid(bad)


def want(rows):
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    by = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    return {c: (len(v), h("".join(f"{r}\n{x}\n" for r, x in v)), len(y := "".join(x for r, x in v if r == "assistant")), h(y)) for c, v in by.items()}


def test_query(spark, data):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in read(spark, data, "conversations").collect()] + [(-1, 0, "user", C.INJECTED), (-1, 1, "assistant", C.INJECTED)]
    got = C.op7_chat_format(spark, data).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == want(rows)
    assert {r.conv_id: r.formatted_chars for r in got}[-1] > 2 * len(C.INJECTED)


def test_awkward_rows(spark):
    rows = [(1, 0, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, None, "assistant", "x</s>"), (2, 5, "assistant", "y" * 100000), (2, None, "user", "\\[INST]")]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted int, segments string")
    got = C.digests(C.format_chats(table)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == want(rows)
    assert C.digests(C.format_chats(table.limit(0))).count() == 0
