import hashlib

from hypothesis import example, given, settings
from hypothesis import strategies as st

import pytest

from mensura.llm.chat import Digest, NotTheGrammar, Reader, chat_digests, format_turns, op5_chat, parse, render, rendered, unescape

PIECES = st.lists(st.sampled_from(["[INST] ", " [/INST]", "</s>", "\\", "[", "[OUT+] ", " ", "a", "[ROLE \"x\"] ", "[/ROLE]", "\n", "é", "<"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", 'o"\\x', "tool]"]), PIECES | st.text(max_size=10)), max_size=5))
@example([("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])
@example([("user", "\\[INST] \\"), ("assistant", "x </s")])
@settings(max_examples=400, deadline=None)
def test_round_trip(turns):
    assert parse(render(turns)) == turns


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x]"]), PIECES), max_size=5), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_reader_takes_any_pieces(turns, size):
    whole, reader = render(turns), Reader()
    assert [t for i in range(0, len(whole), size) for t in reader.feed(whole[i : i + size])] == turns
    reader.end()


def test_steps_rise_until_the_conversation_reads_back():
    """Steps that are too low for the whole are raised by the parser of the whole."""
    turns = [("user", "a", 0), ("assistant", "b </s>[INST] c [/INST]", 0), ("user", "\\\\[INST] x", 0), ("assistant", "d", 0)]
    out = list(rendered(turns))
    assert [back for _, back in out] == [t[:2] for t in turns] == parse("".join(o for o, _ in out))
    for broken in ("x", "[INST] a", "[OUT] a [INST] b </s>", "[OUT] a </s>x"):
        with pytest.raises(NotTheGrammar):
            parse(broken)


def test_hot_conversation(spark):
    """One conversation of 60,000 rows, digested as a stream."""
    turns = [(i, ("user", "assistant")[i % 2], f"turn {i} </s> [INST]" * (i % 3)) for i in range(60_000)]
    df = spark.createDataFrame([(2**60 + 1, *t) for t in turns] + [(None, 1, "user", "x")], "conv_id long, turn long, role string, text string").repartition(7)
    got = {r["conv_id"]: r for r in chat_digests(df).collect()}
    want = Digest()
    for out, back in rendered((r, t, 0) for _, r, t in turns):
        want.add(out, back)
    assert got.keys() == {2**60 + 1, None} and got[2**60 + 1]["turns_sha256"] == want.sha.hexdigest() and got[2**60 + 1]["n_turns"] == 60_000


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    chats = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        chats.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    chats[-1] = [("user", said), ("assistant", said)]
    got = {r["conv_id"]: r for r in op5_chat(spark, sf).collect()}
    assert got.keys() == chats.keys()
    for k, turns in chats.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k]["n_turns"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[k]["formatted_chars"] == len(render(turns))
        if not any(c in t for _, t in turns for c in "[<\\"):  # nothing to escape: headers, texts and ends, by the template as stated
            marks = {"system": "[SYS]  [/SYS]", "user": "[INST]  [/INST]", "assistant": "[OUT]  </s>"}
            assert got[k]["formatted_chars"] == sum(len(marks[r]) + len(t) for r, t in turns)


def test_corners(spark):
    rows = [(2, 1, "assistant", "b"), (2, 0, None, None), (None, 0, "user", ""), (3, 0, "user", "x" * 300000), (3, 0, "user", "x" * 300000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_digests(df).collect()}
    assert got == {2: (2, 1), None: (1, 0), 3: (2, 0)}
    made = format_turns(df).where("conv_id = 2").orderBy("turn").collect()
    assert parse("".join(r["formatted"] for r in made)) == [("", ""), ("assistant", "b")]
    r = made[1]
    assert unescape(r["formatted"][int(r["loss_start"]) : int(r["loss_end"])]) == "b"
    assert chat_digests(df.limit(0)).count() == 0
