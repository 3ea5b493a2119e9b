"""Chat formatting at token level: segments encoded apart, reserved ids spliced in, masks from prefix sums.

Layout of a turn:   <|turn|> role <|text|> text <|end|>      (the three marks are single reserved ids)
A text is escaped before it is encoded, so that no control string ever stands in it: the escape character is
doubled, and put behind the first character of each control string. Dropping one escape character before any
character gives the text back.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import key_back, key_text

MARKS = ("<|turn|>", "<|text|>", "<|end|>")
#: Strings that common chat templates treat as control.
CONTROL = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")
ESCAPE = "\\"
_control = regex.compile("|".join(map(regex.escape, sorted(CONTROL, key=len, reverse=True))))
_undo = regex.compile(regex.escape(ESCAPE) + "(.)", regex.DOTALL)

SEGMENTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
        T.StructField("rendered", T.StringType()),
    ]
)


def escape(text: str) -> str:
    text = text.replace(ESCAPE, ESCAPE * 2)
    while True:  # breaking one control string can leave another across its edge
        broken = _control.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)
        if broken == text:
            return text
        text = broken


def unescape(text: str) -> str:
    return _undo.sub(r"\1", text)


@lru_cache(maxsize=4)
def codec(path: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The ranks of a .tiktoken file, and the reserved ids after its last one."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    top = max(ranks.values()) + 1
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), {m: top + k for k, m in enumerate(MARKS)}


def assemble(role: str, text: str, path: str, trained: tuple[str, ...]) -> tuple[list[int], list[bool], str]:
    """One turn: its ids, its loss mask, its rendered string."""
    encoding, reserved = codec(path)
    turn, body, end = MARKS
    escaped = escape(text)
    parts = [[reserved[turn]], encoding.encode_ordinary(escape(role)), [reserved[body]], encoding.encode_ordinary(escaped), [reserved[end]]]
    ids = [i for part in parts for i in part]
    edges = np.cumsum([0, *map(len, parts)])
    change = np.zeros(len(ids) + 1, np.int64)  # +1 where trained text begins, -1 where it ends
    if role in trained:
        change[edges[3]] += 1
        change[edges[4]] -= 1
    return ids, (np.cumsum(change[:-1]) > 0).tolist(), turn + escape(role) + body + escaped + end


def disassemble(ids: list[int], path: str) -> tuple[str, str]:
    """Role and text of one assembled turn, read from its ids alone."""
    encoding, reserved = codec(path)
    turn, body, end = (reserved[m] for m in MARKS)
    at, to = ids.index(body), len(ids) - 1
    assert ids[0] == turn and ids[to] == end, "not a turn"
    return unescape(encoding.decode(ids[1:at])), unescape(encoding.decode(ids[at + 1 : to]))


def masked_text(ids: list[int], mask: list[bool], path: str) -> str:
    return unescape(codec(path)[0].decode([i for i, m in zip(ids, mask, strict=True) if m]))


def format_chat(conversations: DataFrame, path: str, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text) rows to assembled turns (SEGMENTS), one map, no shuffle.

    A conversation's sequence is its turns' ids in order of turn. Null roles and texts are empty; repeated rows
    give repeated turns; an empty table gives none; further columns are ignored.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for conv, turn, role, text in pdf.itertuples(index=False, name=None):
                role, text = role if isinstance(role, str) else "", text if isinstance(text, str) else ""
                rows.append((back(conv), back(turn), role, *assemble(role, text, path, trained)))
            yield pd.DataFrame(rows, columns=SEGMENTS.names, dtype=object)

    back = key_back(T.LongType())
    cols = [key_text(c) for c in ("conv_id", "turn", "role", "text")]
    return conversations.select(*cols).mapInPandas(run, SEGMENTS)


def in_order(segments: DataFrame, fold, schema: str, partitions: int | None = None) -> DataFrame:
    """Stream each conversation's turns in order through `fold`, whatever their number.

    Rows are hashed by conversation and sorted on disk, then folded as they pass: a conversation holding a third
    of all rows costs time in its task, not memory. `fold()` makes an object with add(row) and result().
    """

    back = key_back(T.LongType())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, done = None, None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if state is None or row.conv_id != current:
                    if state is not None:
                        done.append(state.result())
                    current, state = row.conv_id, fold(back(row.conv_id))
                state.add(row)
            if len(done) > 1000:
                yield pd.DataFrame(done, dtype=object)
                done = []
        if state is not None:
            done.append(state.result())
        if done:
            yield pd.DataFrame(done, dtype=object)

    dealt = segments.repartition(partitions, "conv_id") if partitions else segments.repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "turn", "role", "rendered").withColumn("conv_id", key_text("conv_id")).mapInPandas(run, schema)
