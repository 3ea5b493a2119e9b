"""Vector best-fit packing of tokenised documents into sequences.

Only lengths matter to the packer, and there are at most `capacity` of them: the driver packs the histogram of
lengths, bins of one make being one entry with a count, so its work and memory do not grow with the rows. A
piece then finds its place by its rank among the pieces of its length. Ranks come from counts per writer of the
piece table, so that no length, however frequent, meets in one task; they travel as one array a writer, broadcast only below a checked size.

Of the three capacities a sequence has, the defaults leave only the tokens binding: 2048 tokens cannot hold more than
2048 documents, nor more than the square of 2048 in squares. Tighter limits bind as they are given.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_alphabet, pack_ids
from .common import Memo, Scratch, key_back, key_text

WORDS_KEPT = 300_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space and the word behind it: pre-tokens never cross from a word into the space that follows.
_chunk = re.compile(r"\s*\S+|\s+")
#: Places, and bytes of first ranks, up to which they are broadcast; beyond, pieces are shuffled to them.
BROADCAST_SLOTS, BROADCAST_BYTES = 200_000, 32_000_000


class ByteEncoder:
    """A byte-level BPE file; words are looked up in a bounded memory of packed ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, back = spec["model"]["vocab"], {c: b for b, c in byte_alphabet().items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in merges]
        if order != sorted(order):
            raise ValueError("ids do not follow the order of merges")
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.packed = Memo(lambda word: pack_ids(self.encoding.encode_ordinary(word)), WORDS_KEPT)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        if any(s in text for s in self.special) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return pack_ids(self.encoding.encode(text, allowed_special="all"))
        return b"".join(map(self.packed.__getitem__, _chunk.findall(text)))


_loaded: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _loaded:
        _loaded[path] = ByteEncoder(path)
    return _loaded[path]


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and the weight of each in the choice of a bin."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048  # sum of squared piece lengths
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    rule: str = "norm"  # or "dot"

    def item(self, length: int) -> tuple[int, int, int]:
        return length, 1, length * length

    def caps(self) -> tuple[int, int, int]:
        return self.tokens, self.documents, self.attention


@dataclass
class Bins:
    """`count` sequences of one make: what is left of each capacity, and what lies in them as (length, copies, offset)."""

    left: tuple[int, int, int]
    count: int
    holds: list[tuple[int, int, int]] = field(default_factory=list)

    def most(self, item) -> int:
        return min(r // x for r, x in zip(self.left, item, strict=True))

    def split(self, count: int, length: int, copies: int, item, tokens: int) -> Bins:
        left = tuple(r - copies * x for r, x in zip(self.left, item, strict=True))
        return Bins(left, count, [*self.holds, (length, copies, tokens - self.left[0])])


def best_fit(histogram: dict[int, int], limits: Limits) -> list[Bins]:
    """Longest first; each goes where the weighted residual vector after it is least (or its dot product greatest)."""
    caps, open_bins, closed = limits.caps(), [], []
    shortest = min(histogram, default=0)

    def score(b: Bins, item) -> float:
        rest = [(r / c, x / c, w) for r, x, c, w in zip(b.left, item, caps, limits.weights, strict=True)]
        if limits.rule == "dot":
            return -sum(w * r * x for r, x, w in rest)
        return sum(w * (r - x) ** 2 for r, x, w in rest)

    for length in sorted(histogram, reverse=True):
        item, todo = limits.item(length), histogram[length]
        if any(x > c for x, c in zip(item, caps, strict=True)):
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        fits = sorted((b for b in open_bins if b.most(item)), key=lambda b: score(b, item))
        made = []
        for b in fits:
            if not todo:
                break
            copies = b.most(item)
            full = min(b.count, todo // copies)
            rest = min(todo - full * copies, copies - 1) if b.count > full else 0
            for count, n in ((full, copies), (1, rest)):
                if count and n:
                    made.append(b.split(count, length, n, item, limits.tokens))
                    b.count -= count
                    todo -= count * n
        copies = Bins(caps, 0).most(item)
        for count, n in ((todo // copies, copies), (1, todo % copies)):
            if count and n:
                made.append(Bins(caps, count).split(count, length, n, item, limits.tokens))
        open_bins = [b for b in open_bins if b.count] + made
        least = limits.item(shortest)
        closed += [b for b in open_bins if not b.most(least)]
        open_bins = [b for b in open_bins if b.most(least)]
    return closed + open_bins


def slots(bins: list[Bins]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, copies a sequence, first sequence, offset) of each place for that length."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for b in bins:
        for length, copies, offset in b.holds:
            n = b.count * copies
            out.append((length, rank.get(length, 0), n, copies, sequence, offset))
            rank[length] = rank.get(length, 0) + n
        sequence += b.count
    return out


def token_pieces(docs: DataFrame, path: str, tokens: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Tokenise and cut: a document of more than `tokens` ids becomes full pieces behind a first one with the rest."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)])
    for name, of in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("token_ids", T.BinaryType()), ("writer", T.StringType()), ("nth", T.LongType())):
        schema.add(name, of)
    back = key_back(kind)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, writer, seen = encoder(path), uuid.uuid4().hex, {}
        end = pack_ids([end_id])
        for pdf in batches:
            rows = []
            for key, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                ids = (enc.encode(text) if isinstance(text, str) else b"") + end
                n = len(ids) // 4
                edges = [0, *range(n % tokens or tokens, n + 1, tokens)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    cut = ids[4 * a : 4 * b]
                    nth = seen[b - a] = seen.get(b - a, -1) + 1
                    rows.append((back(key), piece, a, b - a, zlib.crc32(cut), cut, writer, nth))
            yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    return docs.select(key_text(id_col), text_col).mapInPandas(run, schema)


def _by_length(tokens: int):
    """A writer's first ranks, each at the place of its length."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        firsts = np.zeros(tokens + 1, np.int64)
        firsts[pdf["length"].to_numpy()] = pdf["first"].to_numpy()
        return pd.DataFrame({"writer": pdf["writer"].iloc[:1], "firsts": [firsts]})

    return run


def pack(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents; returns (id, piece, start, length, ids_crc32, token_ids, sequence_id, offset).

    token_ids are little-endian unsigned 32-bit. A null or empty text is its end id alone; repeated rows are packed
    as often as they stand; an empty table gives no rows; other columns are ignored. Which of several pieces of one
    length gets which place depends on the run; lengths, cuts and the number of sequences do not.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.write("pieces", token_pieces(docs, path, limits.tokens, end_id, id_col, text_col))
    counts = scratch.write("counts", pieces.groupBy("length", "writer").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("writer").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).groupBy("writer").applyInPandas(_by_length(limits.tokens), "writer string, firsts array<long>")
    first = scratch.write("first", first)
    small = first.count() * 8 * (limits.tokens + 1) <= BROADCAST_BYTES
    first = first.hint("broadcast" if small else "merge")
    places = slots(best_fit(histogram, limits))
    names = "s_length long, s_rank long, s_n long, s_copies long, s_sequence long, s_offset long"
    plan = spark.createDataFrame(places, names)
    if len(places) <= BROADCAST_SLOTS:
        plan = F.broadcast(plan)
    ranked = pieces.join(first, "writer").withColumn("rank", F.col("firsts")[F.col("length").cast("int")] + F.col("nth")).drop("firsts")
    placed = ranked.join(plan, (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_rank")) & (F.col("rank") < F.col("s_rank") + F.col("s_n")))
    k = F.col("rank") - F.col("s_rank")
    return placed.select(
        id_col, "piece", "start", "length", "ids_crc32", "token_ids",
        (F.col("s_sequence") + F.floor(k / F.col("s_copies"))).cast("long").alias("sequence_id"),
        (F.col("s_offset") + F.pmod(k, F.col("s_copies")) * F.col("length")).cast("long").alias("offset"),
    )
