import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import chat, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.lists(st.sampled_from([*chat.CONTROL, "\\", "\\\\", "a", " ", "<", "/s>", "é", "\n", "|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escape_round_trip_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(c in hidden for c in chat.CONTROL)


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_turn_reads_back(text):
    ids, mask, _ = chat.assemble("assistant", text, PATH, ("assistant",))
    assert chat.disassemble(ids, PATH) == ("assistant", text)
    assert chat.masked_text(ids, mask, PATH) == text
    assert not any(chat.assemble("user", text, PATH, ("assistant",))[1])


def test_query_matches_a_direct_computation(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["conv_id"]: r for r in queries.op5_chat_format(spark, sf).collect()}
    want: dict = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        trained = "".join(t for role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())


def test_nulls_and_empty_table(spark):
    rows = spark.createDataFrame([(1, 0, None, None, 5), (None, 0, "user", "x", 5), (1, None, "assistant", "y", 5)], "conv_id long, turn long, role string, text string, ids int")
    assert chat.format_chat(rows, PATH).count() == 3
    out = chat.in_order(chat.format_chat(rows, PATH), queries.ChatDigest, queries.ChatDigest.SCHEMA).collect()
    assert sorted((r["conv_id"] or -1, r["n_turns"]) for r in out) == [(-1, 1), (1, 2)]
    assert chat.format_chat(rows.limit(0), PATH).count() == 0


def test_very_long_and_repeated_rows(spark):
    """A turn of 400,000 characters, and a turn that stands twice: both come back, in order."""
    long = "ab </s> c" * 45_000
    rows = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", long, "x"), (2, 0, "assistant", "same", "x"), (2, 0, "assistant", "same", "x")], "conv_id long, turn long, role string, text string, loss_mask string")
    out = {r["conv_id"]: r for r in chat.in_order(chat.format_chat(rows, PATH), queries.ChatDigest, queries.ChatDigest.SCHEMA).collect()}
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[1]["loss_sha256"]) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())
    assert (out[2]["n_turns"], out[2]["loss_chars"]) == (2, 8)
