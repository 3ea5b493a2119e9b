"""Alignment of two tokenizers' tokens over whole texts, and how many documents hold each linked pair of ids.

Byte offsets where tokens of both end cut a text into groups; every A and B token of a group are linked. Both
tokenizers cut between a word and the space or line feed behind it, so a text is a row of chunks that are aligned
apart, each different chunk of a part of the table once: ends by cumsum, common cuts by intersect1d, groups by
searchsorted, links by repeats. A part's vocabulary of chunks becomes one row, its documents rows of chunk numbers;
both are written once. Pairs are counted by parts first, summed over salts, then over all; each part gets back the
counts of its own pairs only, so that no task or driver holds all of them.

Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros and an empty
digest. Rows are documents: repeated rows count as often as they stand. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, key_back, key_text
from .packing import encoder

#: Characters of text after which a part of the table ends; a longer text is a part by itself.
PART = 8_000_000
#: Links of one group above which its ids are first counted, so that equal links become one with a weight.
WIDE = 1 << 14
SALTS = 8
#: Chunks whose ids a worker remembers before it starts anew.
KEPT = 60_000
#: Chunks that are aligned at a time.
ALIGNED = 30_000
#: Chunks end before a space or line feed that follows other than white space.
_chunk = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
_odd = re.compile("[\x1c-\x1f]")


class Tokenizers:
    """Tokenizer A (byte-level BPE file) and B (sentencepiece model), as ids and bytes of chunks.

    A chunk begins with a space or a line feed. B puts a space before what it encodes: it stands for a chunk's own
    space, and is a token by itself before a line feed.
    """

    def __init__(self, path_a: str, path_b: str):
        a = encoder(path_a).encoding
        self.encode_a = a.encode_ordinary
        self.bytes_a = [a.decode_single_token_bytes(i) if i not in a._special_tokens.values() else b"" for i in range(a.n_vocab)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁|\n", p) for p in pieces):
            raise ValueError("pieces cross the space behind a word")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def encode(self, chunks: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """Of each chunk A ids, B ids (as 32-bit integers), and whether B gives its bytes back (A always does); KEPT chunks are remembered."""
        if len(self.known) > KEPT:
            self.known.clear()
        new = [c for c in chunks if c not in self.known]
        coded = self.b.encode([c[1:] if c[0] == " " else c for c in new], num_threads=1)
        for chunk, b in zip(new, coded, strict=True):
            if chunk == " ":
                b = [self.space]  # B puts no space before nothing
            elif chunk[0] != " ":
                if b[0] != self.space:
                    raise ValueError(f"no space of its own before {chunk[:20]!r}")
                b = b[1:]
            whole = b"".join(map(self.bytes_b.__getitem__, b)) == chunk.encode()
            self.known[chunk] = np.array(self.encode_a(chunk), np.int32).tobytes(), np.array(b, np.int32).tobytes(), whole
        return [self.known[c] for c in chunks]


def chunks(text: str) -> list[str]:
    """The chunks of a space and the text; as one where white space differs between the two tokenizers' patterns."""
    return [f" {text}"] if _odd.search(text) else _chunk.findall(f" {text}")


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[k], starts[k] + 1, … of sizes[k] items each, in a row."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


@dataclass
class Links:
    """Aligned chunks: of each its groups and their text, and its links as (chunk, A id, B id, weight)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    texts: list[bytes]
    chunk: np.ndarray
    a: np.ndarray
    b: np.ndarray
    weight: np.ndarray

    @classmethod
    def joined(cls, parts: list[Links]) -> Links:
        return cls(*(sum((p.texts for p in parts), []) if f.name == "texts" else np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(cls)))


class Aligner:
    def __init__(self, size_a: np.ndarray, size_b: np.ndarray):
        """Bytes of every id of A and of B."""
        self.size_a, self.size_b = size_a, size_b
        self.text_a, self.text_b = ([[f"{i}{mark}" for i in range(len(s))] for mark in marks] for s, marks in ((size_a, ",|"), (size_b, ",;")))
        self.text_a, self.text_b = ([np.array(t, object) for t in x] for x in (self.text_a, self.text_b))

    def align(self, ids_a: list[bytes], ids_b: list[bytes]) -> Links:
        """Of chunks, given as packed ids, whose tokens of A and of B have the same bytes."""
        n_a, n_b = (np.array([len(x) // 4 for x in ids], np.int64) for ids in (ids_a, ids_b))
        a, b = (np.frombuffer(b"".join(ids), np.int32) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # a chunk's end is one, so no group passes it
        of_a, of_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        chunk_of = np.searchsorted(np.cumsum(n_a), first_a, side="right")
        n_groups = np.bincount(chunk_of, minlength=len(n_a))

        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[first_a + in_a - 1], last_b[first_b + in_b - 1] = 1, 1
        parts = np.empty(len(a) + len(b), object)
        for ids, last, place, texts in ((a, last_a, np.arange(len(a)) + first_b[of_a], self.text_a), (b, last_b, np.arange(len(b)) + (first_a + in_a)[of_b], self.text_b)):
            parts[place] = np.where(last == 1, texts[1][ids], texts[0][ids])
        ends = np.cumsum(n_a + n_b)
        texts = ["".join(parts[i:j].tolist()).encode() for i, j in zip(ends - n_a - n_b, ends, strict=True)]

        plain = np.flatnonzero(in_a * in_b <= WIDE)
        rows = _ragged(first_a[plain], in_a[plain])  # A tokens, each beside all B tokens of its group
        times = np.repeat(in_b[plain], in_a[plain])
        left = np.repeat(rows, times)
        right = _ragged(np.repeat(first_b[plain], in_a[plain]), times)
        found = [(chunk_of[of_a[left]], a[left], b[right], np.ones(len(left), np.int64))]
        for g in np.flatnonzero(in_a * in_b > WIDE):
            ua, ca = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            found.append((np.full(len(ua) * len(ub), chunk_of[g]), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.outer(ca, cb).ravel()))
        chunk, la, lb, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(found) > 1:
            order = np.argsort(chunk, kind="stable")
            chunk, la, lb, weight = chunk[order], la[order], lb[order], weight[order]
        return Links(n_a, n_b, n_groups, texts, chunk, la, lb, weight)


_loaded: dict[tuple[str, str], tuple[Tokenizers, Aligner]] = {}


def loaded(path_a: str, path_b: str) -> tuple[Tokenizers, Aligner]:
    if (path_a, path_b) not in _loaded:
        t = Tokenizers(path_a, path_b)
        _loaded[path_a, path_b] = t, Aligner(*(np.array([len(x) for x in sizes], np.int64) for sizes in (t.bytes_a, t.bytes_b)))
    return _loaded[path_a, path_b]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `sizes` values, of none 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


_PART_SCHEMA = "part long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks binary, pairs binary, held_in binary, link_pairs binary, weights binary, links_of binary"


class Part:
    """Documents until the text reaches PART characters, as rows of numbers of their different chunks."""

    def __init__(self, number: int, tokenizers: Tokenizers):
        self.number, self.tokenizers = number, tokenizers
        self.numbers: dict[str, int] = {}
        self.ids: list = []
        self.words: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id, text: str | None) -> None:
        numbers = self.numbers
        found = chunks(text) if text else []
        self.ids.append(doc_id)
        self.words.append(np.array([numbers.setdefault(c, len(numbers)) for c in found], np.int32))
        self.chars += len(text or "") + 1

    def rows(self, aligner: Aligner) -> Iterator[pd.DataFrame]:
        names = list(self.numbers)
        self.numbers = {}
        found, whole_parts = [], []
        for at in range(0, max(1, len(names)), ALIGNED):
            coded = self.tokenizers.encode(names[at : at + ALIGNED])
            found.append(aligner.align([x[0] if x[2] else b"" for x in coded], [x[1] if x[2] else b"" for x in coded]))
            found[-1].chunk += at
            whole_parts.append(np.array([x[2] for x in coded], bool))
        n, none = len(names), np.zeros(0, np.int32)
        del names
        whole, links = np.concatenate(whole_parts), Links.joined(found)
        del found
        width = len(aligner.size_b)
        pairs, link_pairs = np.unique(links.a.astype(np.int64) * width + links.b, return_inverse=True)
        link_pairs = link_pairs.astype(np.int32)
        links_of = np.bincount(links.chunk, minlength=n).astype(np.int64)
        weight_of = _sums(links.weight, links_of)
        first = np.cumsum(links_of) - links_of
        held_in = np.zeros(len(pairs), np.int64)
        kept = []
        for words in self.words:
            words = words if whole[words].all() else none
            kept.append(words)
            different = np.unique(words)
            held_in[np.unique(link_pairs[_ragged(first[different], links_of[different])])] += 1
        out = []
        for doc_id, words in zip(self.ids, kept, strict=True):
            text = b"".join([links.texts[w] for w in words.tolist()])
            sha = hashlib.sha256(memoryview(text)[:-1]).hexdigest() if text else ""
            out.append((self.number, doc_id, *(int(x[words].sum()) for x in (links.n_a, links.n_b, links.n_groups, weight_of)), sha, words.tobytes()))
        self.words = []
        columns = [c.split()[0] for c in _PART_SCHEMA.split(", ")]
        for at in range(0, len(out), 4096):
            yield pd.DataFrame(out[at : at + 4096], columns=columns[:8]).reindex(columns=columns).astype(object).where(lambda x: x.notna(), None)
        vocabulary = (self.number, None, 0, 0, 0, 0, None, None, pairs.tobytes(), held_in.tobytes(), link_pairs.tobytes(), links.weight.tobytes(), links_of.tobytes())
        yield pd.DataFrame([vocabulary], columns=columns)


def parts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of documents (`chunks` not null) and of vocabularies (`pairs` not null) of docs (id, text)."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizers, aligner = loaded(path_a, path_b)
        task, n = TaskContext.get().partitionId(), 0
        part = Part(task << 24, tokenizers)
        for pdf in batches:
            for doc_id, text in zip(pdf["id"], pdf["text"], strict=True):
                if part.ids and part.chars + len(text or "") > PART:
                    yield from part.rows(aligner)
                    n += 1
                    part = Part((task << 24) + n, tokenizers)
                part.add(doc_id, text)
        if part.ids:
            yield from part.rows(aligner)

    return docs.mapInPandas(run, _PART_SCHEMA)


def part_pairs(written: DataFrame) -> DataFrame:
    """(part, pair, n): in how many of a part's documents a pair of ids is linked."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                pairs, held = np.frombuffer(r.pairs, np.int64), np.frombuffer(r.held_in, np.int64)
                for at in range(0, len(pairs), 100_000):
                    cut = slice(at, at + 100_000)
                    yield pd.DataFrame({"part": r.part, "pair": pairs[cut], "n": held[cut]})

    return written.where(F.col("pairs").isNotNull()).select("part", "pairs", "held_in").mapInPandas(run, "part long, pair long, n long")


def pair_counts(each: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair, and whether no pair of its A id has more.

    Sums go over (pair, salt) first, so that a pair of all parts is not one task's. The highest counts are one row an
    A id, which is bounded by A's vocabulary, and are broadcast.
    """
    salted = each.groupBy("pair", F.pmod(F.xxhash64("part"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    totals = salted.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {width}"))
    highest = totals.groupBy("a").agg(F.max("n").alias("highest"))
    return totals.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs.

    A link's count is the number of documents of the whole table in which its pair of ids is linked; n_best counts
    links whose count no other pair of their A id exceeds, count_sum adds the counts of all links.
    """
    kind = docs.schema[id_col].dataType
    scratch = Scratch(docs.sparkSession)
    written = scratch.write("aligned", parts(docs.select(key_text(id_col).alias("id"), F.col(text_col).alias("text")), path_a, path_b))
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    each = part_pairs(written)
    counts = each.select("part", "pair").join(pair_counts(each, width), "pair")
    back: Callable = key_back(kind)

    def run(lookups: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        vocabulary = rows[rows["pairs"].notna()].iloc[0]
        rows = rows[rows["pairs"].isna()]
        pairs = np.frombuffer(vocabulary["pairs"], np.int64)
        order = np.argsort(lookups["pair"].to_numpy())  # a part's own pairs, each once: the order of `pairs`
        n, best = lookups["n"].to_numpy()[order], lookups["best"].to_numpy()[order].astype(np.int64)
        link_pairs, weights, links_of = (np.frombuffer(vocabulary[c], t) for c, t in (("link_pairs", np.int32), ("weights", np.int64), ("links_of", np.int64)))
        if len(n) != len(pairs):
            raise ValueError(f"{len(n)} counts for {len(pairs)} pairs")
        sum_of, best_of = _sums(n[link_pairs] * weights, links_of), _sums(best[link_pairs] * weights, links_of)
        words = [np.frombuffer(x, np.int32) for x in rows["chunks"]]
        out = rows[["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].astype({c: "int64" for c in ("n_a", "n_b", "n_groups", "n_links")})
        out.insert(0, id_col, pd.Series([back(x) for x in rows["id"]], index=out.index, dtype=object))
        out.insert(5, "n_best", [int(best_of[w].sum()) for w in words])
        out.insert(6, "count_sum", [int(sum_of[w].sum()) for w in words])
        return out

    form = f"{id_col} {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return counts.groupBy("part").cogroup(written.drop("held_in").groupBy("part")).applyInPandas(run, form)
