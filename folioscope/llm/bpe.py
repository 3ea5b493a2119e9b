"""BPE as a streaming transducer with bounded lookahead, and its inverse as an incremental byte-to-text machine.

Two facts make streaming possible. A run of consecutive output tokens is itself the encoding of the text it
covers, so what has been emitted never has to be read again. And a token at the right edge of the text read so
far can change only through a merge that crosses the edge, whose right operand may in turn be undone only by a
merge of strictly better rank, and so on: `lookahead` is the longest text such a chain can span, computed once
from the merge list. A token that ends at least that far before the end of the buffer is final.
"""

from __future__ import annotations

import codecs
import json
import struct
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, key_back, key_text

WORDS_KEPT = 250_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Transducer:
    """The merges of a tokenizer file, and the buffer size that makes left-to-right emission exact."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(pair): k for k, pair in enumerate(merges)}
        self.lookahead = self._sufficient_lookahead(merges)
        self.buffer = max(256, 4 * self.lookahead)

    def _width(self, token: str) -> int:
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)

    def _sufficient_lookahead(self, merges) -> int:
        made: dict[str, tuple[int, str]] = {}  # token -> rank that first makes it, its right operand
        ranks: dict[str, list[int]] = {}  # left operand -> ranks of its merges, ascending
        reach: dict[str, list[int]] = {}  # and the longest reach among them so far

        def beyond(token: str) -> int:
            most = 0
            while token in made:
                consumed, token = made[token]
                if token in ranks and (k := bisect_left(ranks[token], consumed)):
                    most = max(most, reach[token][k - 1])
            return most

        for k, (left, right) in enumerate(merges):
            far = self._width(right) + beyond(right)
            ranks.setdefault(left, []).append(k)
            reach.setdefault(left, []).append(max(far, reach[left][-1] if reach.get(left) else 0))
            made.setdefault(left + right, (k, right))
        return max((beyond(t) for t in made), default=0) + max((r[-1] for r in reach.values()), default=0)

    def settle(self, symbols: list[str]) -> list[str]:
        """Merge a bounded buffer: always the best-ranked pair, the leftmost of equals."""
        get, none = self.rank.get, len(self.rank)
        symbols = list(symbols)
        ranks = [get(pair, none) for pair in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((symbols[k - 1], symbols[k]), none)
            if k < len(ranks):
                ranks[k] = get((symbols[k], symbols[k + 1]), none)
        return symbols

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one pre-token, each emitted as soon as it is stable; holds at most `buffer` symbols."""
        held: list[str] = []
        for symbol in symbols:
            held.append(symbol)
            if len(held) >= self.buffer:
                left, done = len(held), 0
                for token in self.settle(held):
                    n = self._width(token)
                    if left - n < self.lookahead:
                        break
                    left -= n
                    done += n
                    yield token
                held = held[done:]
        yield from self.settle(held)


class Tokenizer:
    """A tokenizers-library JSON file of BPE kind: special strings, normalisers, pre-tokens, then the transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.machine = Transducer(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        kinds = spec["normalizer"] or {}
        self.normalizers = [n["type"] for n in kinds.get("normalizers", [kinds] if kinds else [])]
        steps = spec["pre_tokenizer"]
        steps = steps.get("pretokenizers", [steps])
        pattern = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        self.words_only = pattern is not None  # white space never reaches the model
        space = r"\p{White_Space}"
        pattern = pattern or r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\S", f"[^{space}]").replace(r"\s", space))
        self.space = regex.compile(f"{space}+")
        self.byte_level = bool(spec["decoder"]) and spec["decoder"]["type"] == "ByteLevel"
        self.alphabet = byte_alphabet()
        self.bytes_of = {i: self._raw(t) for i, t in self.names.items()} if self.byte_level else {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretoken = Memo(self._encode_pretoken, WORDS_KEPT)
        self.word = Memo(self._encode_word, WORDS_KEPT)

    def _raw(self, token: str) -> bytes:
        back = {c: b for b, c in self.alphabet.items()}
        return token.encode() if any(c not in back for c in token) else bytes(back[c] for c in token)

    def _encode_pretoken(self, piece: str) -> tuple[int, ...]:
        raw, last = piece.encode("utf-8", "replace"), self.machine.suffix
        symbols = (self.alphabet[b] + (last if k == len(raw) - 1 else "") for k, b in enumerate(raw))
        return tuple(self.machine.vocab[t] for t in self.machine.stream(symbols))

    def normalize(self, text: str) -> str:
        for kind in self.normalizers:
            if kind == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif kind == "Replace":
                text = self.space.sub(" ", text)
            elif kind == "Lowercase":
                text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return text

    def _encode_word(self, word: str) -> tuple[int, ...]:
        return tuple(i for piece in self.pattern.findall(self.normalize(word)) for i in self.pretoken[piece])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; a special token's string in it is that token."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(self.special[part])
            elif self.words_only:  # pre-tokens lie inside words, so words can be looked up one by one
                words = self.space.split(part) if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()
                for ids in map(self.word.__getitem__, words):
                    out += ids
            else:
                for piece in self.pattern.findall(self.normalize(part)):
                    out += self.pretoken[piece]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as soon as its bytes are complete; a file without a decoder shows its token names, one space apart."""
        if not self.byte_level:
            first = True
            for i in ids:
                yield self.names[i] if first else " " + self.names[i]
                first = False
            return
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := machine.decode(self.bytes_of[i]):
                yield text
        yield machine.decode(b"", True)


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One copy a Python worker."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def pack_ids(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    ids = list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


def bpe_encode_decode(
    docs: DataFrame,
    path: str,
    derive: dict[str, tuple[T.DataType, Callable[[list[int], str], object]]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns (id, n_tokens, ids array<int>, decoded string), or with `derive` the columns it computes from
    (ids, decoded) in place of these two. One map over the rows, no shuffle. Null and empty texts have no
    tokens and decode to ''; repeated rows stay; other columns of `docs`, whatever their names, are ignored.
    """
    derive = derive or {"ids": (T.ArrayType(T.IntegerType()), lambda ids, _: ids), "decoded": (T.StringType(), lambda _, text: text)}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])
    for name, (kind, _) in derive.items():
        schema.add(name, kind)

    back = key_back(docs.schema[id_col].dataType)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                ids = tok.encode(text) if isinstance(text, str) else []
                decoded = tok.decode(ids)
                rows.append((back(key), len(ids), *(fn(ids, decoded) for _, fn in derive.values())))
            yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    return docs.select(key_text(id_col), text_col).mapInPandas(run, schema)
