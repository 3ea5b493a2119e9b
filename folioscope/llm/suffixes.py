"""Removal of repeated byte strings by column-wise construction of a collection's BWT and common prefixes.

Strings of one or more lengths are looked for at once. Every window of the shortest length has an anchor: its GRAM
bytes of least hash, the first of equals. Equal windows have equal anchors at equal places, so windows are compared
only inside the class of an anchor, and there only column by column. Neighbouring windows with one anchor form a
piece, which reaches to the right as far as the longest length needs; each window lies in exactly one piece.

A piece that stands at two places repeats as a whole, which an aggregation tells from its hash. Classes of two or
more different pieces go to the column-wise construction: pieces are aligned at their anchor, and each round
inserts one symbol a piece, right to left, into the sorted order of the class's suffixes, with the length of the
common prefix of neighbours. Columns, Burrows-Wheeler symbols and prefix lengths pass through sequential files.
Windows whose suffix shares `length` symbols with a neighbour are the repeated ones.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LENGTH, GRAM = 400, 32
#: Pieces in one construction, and the size of a class beyond which its windows are counted by hash instead.
BATCH, LARGE = 6_000, 50_000
_table = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_factors = np.random.default_rng(11).integers(0, 1 << 63, 32, np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every `gram` consecutive bytes, by doubling; `gram` is a power of two."""
    with np.errstate(over="ignore"):
        h, width, k = _table[data], 1, 0
        while width < gram:
            h = h[:-width] * _factors[k] + h[width:]
            width, k = width * 2, k + 1
        h ^= h >> np.uint64(32)
        h *= _factors[31]
        return h ^ (h >> np.uint64(29))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, from minima up to and from block edges on."""
    n = len(values) - width + 1
    padded = np.concatenate((values, np.full(-len(values) % width, ~np.uint64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces_of(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and place of the anchor in it, of a text's pieces."""
    data = np.frombuffer(raw, np.uint8)
    hashes = gram_hashes(data, gram)
    bits = np.uint64(max(1, len(hashes).bit_length()))
    tagged = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    at = (window_least(tagged, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return hashes[at[first]], first, np.diff(np.append(first, len(at))), at[first] - first


def digested(raw: bytes, lengths: tuple[int, ...], gram: int) -> dict[str, np.ndarray]:
    """The pieces of a text: anchor, hash of the bytes, first window, number of windows, place of the anchor, size."""
    anchor, start, windows, off = pieces_of(raw, min(lengths), gram)
    size = np.minimum(windows - 1 + max(lengths), len(raw) - start)
    h = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(start.tolist(), size.tolist())), np.uint64, len(start))
    ints = {c: x.astype(np.int32) for c, x in (("start", start), ("windows", windows), ("off", off), ("size", size))}
    return {"anchor": anchor.view(np.int64), "h": h.view(np.int64)} | ints


_PLACED = "id string, t long, anchor long, h long, start int, windows int, size int"


def placed(docs: DataFrame, lengths: tuple[int, ...], gram: int) -> DataFrame:
    """Every piece of every text with the hash of its bytes: docs has (id string, t, text)."""

    names = _PLACED.replace(",", "").split()[::2]

    def packed(keys: list, ts: list[int], parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
        n = [len(x["h"]) for x in parts]
        out = {c: np.concatenate([x[c] for x in parts]) for c in names[2:]}
        return pd.DataFrame({"id": np.repeat(np.array(keys, object), n), "t": np.repeat(np.array(ts, np.int64), n)} | out)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, ts, parts, size = [], [], [], 0
            for key, t, text in zip(pdf["id"], pdf["t"], pdf["text"], strict=True):
                raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
                if len(raw) < min(lengths):
                    continue
                keys.append(key), ts.append(t), parts.append(digested(raw, lengths, gram))
                size += len(parts[-1]["h"])
                if size > 100_000:
                    yield packed(keys, ts, parts)
                    keys, ts, parts, size = [], [], [], 0
            if parts:
                yield packed(keys, ts, parts)

    return docs.mapInPandas(run, _PLACED)


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low:high], low < high, from minima over powers of two."""
    out = np.empty(len(low), values.dtype)
    level = np.frexp((high - low).astype(float))[1] - 1
    table, width = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(table[low[mine]], table[high[mine] - width])
        table = np.minimum(table[:-width], table[width:]) if len(table) > width else table[:0]
        width *= 2
    return out


def column_wise(columns, rounds: int, group: np.ndarray, sink, most: int, wanted: int) -> None:
    """Insert columns, last first, into the order of each group's suffixes.

    `columns` yields, a round, one symbol a document as uint16 (0: none there) from a sequential file. After each
    round the symbols to the left of the documents in order (the BWT's column, known a round later) are appended to
    `sink`, and in the last `wanted` rounds the documents in order (uint16, beyond 65,535 of them uint32) and the common
    prefix with the one before (uint16, held to `most`). `group` ascends, below 65,536.
    """
    n = len(group)
    place = np.uint16 if n <= 1 << 16 else np.uint32
    order, common = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    for turn in range(rounds):
        column = next(columns)
        symbol = column[order]
        sink.write(symbol.tobytes())  # stands left of the suffixes inserted the round before
        by_symbol = np.argsort(symbol, kind="stable")
        moved = by_symbol[np.argsort(group[order[by_symbol]], kind="stable")]
        order, symbol = order[moved], symbol[moved]
        same = np.zeros(n, bool)
        same[1:] = (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0) & (group[order[1:]] == group[order[:-1]])
        at = np.flatnonzero(same)
        new = np.zeros(n, np.int32)
        low, high = moved[at - 1] + 1, moved[at] + 1
        next_door = high - low == 1
        new[at[next_door]] = common[low[next_door]]
        rest = at[~next_door]
        if len(rest):
            new[rest] = _range_least(common, low[~next_door], high[~next_door])
        new[at] += 1
        common = np.minimum(new, most)
        if turn >= rounds - wanted:
            sink.write(order.astype(place).tobytes()), sink.write(common.astype(np.uint16).tobytes())


def repeated_windows(raws: list[bytes], offs: np.ndarray, windows: np.ndarray, group: np.ndarray, lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """Per piece and length, which of its windows also stand in another piece of its group."""
    n, left = len(raws), int(offs.max())
    sizes = np.fromiter(map(len, raws), np.int64, n)
    width = int((sizes - offs).max()) + left
    aligned = np.zeros((n, width), np.uint16)
    for k, raw in enumerate(raws):
        a = left - int(offs[k])
        aligned[k, a : a + len(raw)] = np.frombuffer(raw, np.uint8)
        aligned[k, a : a + len(raw)] += 1
    place = np.uint16 if n <= 1 << 16 else np.uint32
    with tempfile.TemporaryFile() as inbound, tempfile.TemporaryFile() as outbound:
        for column in range(width - 1, -1, -1):
            inbound.write(aligned[:, column].tobytes())
        del aligned
        inbound.seek(0)
        columns = (np.fromfile(inbound, np.uint16, n) for _ in range(width))
        column_wise(columns, width, group.astype(np.uint16), outbound, max(lengths), left + 1)
        outbound.seek(2 * n * (width - left - 1))
        hits = np.zeros((len(lengths), n, left + 1), bool)
        for column in range(left, -1, -1):
            outbound.seek(2 * n, 1)
            order, common = np.fromfile(outbound, place, n), np.fromfile(outbound, np.uint16, n)
            for j, length in enumerate(lengths):
                full = common >= length
                full[:-1] |= common[1:] >= length
                hits[j, order[full], column] = True
    return [[h[k, left - o : left - o + w] for h in hits] for k, (o, w) in enumerate(zip(offs.tolist(), windows.tolist()))]


def _ranges(hit: np.ndarray) -> list[int]:
    """[a, b, a, b, ...] of the runs of true."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()


def constructed(pieces: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(anchor, h, ranges) of different pieces (anchor, h, off, windows, bytes): by length, their windows that repeat.

    Rows are dealt by anchor and sorted, so that classes pass whole; many classes share a construction.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def judge(pdf: pd.DataFrame) -> pd.DataFrame:
            _, group = np.unique(pdf["anchor"].to_numpy(), return_inverse=True)
            hits = repeated_windows(list(pdf["bytes"]), pdf["off"].to_numpy(np.int64), pdf["windows"].to_numpy(np.int64), group, lengths)
            out = pdf[["anchor", "h"]].assign(ranges=[[_ranges(x) for x in h] for h in hits])
            return out[[any(map(bool, r)) for r in out["ranges"]]]

        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH]
                held = part if held is None else pd.concat((held, part))
                last = held["anchor"].iloc[-1]
                whole = int(np.searchsorted(held["anchor"].to_numpy(), last))
                if len(held) >= BATCH and whole:
                    yield judge(held.iloc[:whole])
                    held = held.iloc[whole:]
        if held is not None and len(held):
            yield judge(held)

    dealt = pieces.repartition("anchor").sortWithinPartitions("anchor", "h")
    return dealt.mapInPandas(run, "anchor long, h long, ranges array<array<int>>")


def _cut(with_text: DataFrame, lengths: tuple[int, ...], gram: int) -> DataFrame:
    """Bytes of wanted pieces: (text, wanted array<struct<anchor, h, large>>) to one row a piece."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, wanted in zip(pdf["text"], pdf["wanted"], strict=True):
                raw = text.encode("utf-8", "replace")
                mine, open_ = digested(raw, lengths, gram), {(w["anchor"], w["h"]): w["large"] for w in wanted}
                for k in np.flatnonzero(np.isin(mine["h"], [h for _, h in open_])).tolist():
                    key = int(mine["anchor"][k]), int(mine["h"][k])
                    if key in open_:
                        a = int(mine["start"][k])
                        rows.append((*key, mine["off"][k], mine["windows"][k], open_.pop(key), raw[a : a + int(mine["size"][k])]))
            yield pd.DataFrame(rows, columns=["anchor", "h", "off", "windows", "large", "bytes"])

    return with_text.mapInPandas(run, "anchor long, h long, off int, windows int, large boolean, bytes binary")


def _by_hash(pieces: DataFrame, scratch: Scratch, lengths: tuple[int, ...]) -> DataFrame:
    """The same answer for classes too large for one task: windows counted by hash, with partial sums."""

    def hashes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for anchor, h, windows, raw in zip(pdf["anchor"], pdf["h"], pdf["windows"], pdf["bytes"], strict=True):
                for j, length in enumerate(lengths):
                    n = min(windows, len(raw) - length + 1)
                    if n > 0:
                        w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[k : k + length]) for k in range(n)), np.int64).reshape(-1, 2)
                        yield pd.DataFrame({"anchor": anchor, "h": h, "j": j, "k": np.arange(n, dtype=np.int32), "w1": w[:, 0], "w2": w[:, 1]})

    each = scratch.write("windows", pieces.select("anchor", "h", "windows", "bytes").mapInPandas(hashes, "anchor long, h long, j int, k int, w1 long, w2 long"))
    twice = each.groupBy("w1", "w2", "j").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("w1", "w2", "j")
    hit = each.join(twice, ["w1", "w2", "j"]).groupBy("anchor", "h").agg(*(F.sort_array(F.collect_list(F.when(F.col("j") == j, F.col("k")))).alias(f"k{j}") for j in range(len(lengths))))
    single = lambda ks: F.flatten(F.transform(ks, lambda k: F.array(k, k + 1)))
    return hit.select("anchor", "h", F.array(*(single(F.col(f"k{j}")) for j in range(len(lengths)))).alias("ranges"))


def _merge(lengths: tuple[int, ...]):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, t, found in zip(pdf["id"], pdf["t"], pdf["found"], strict=True):
                starts, ends = [], []
                for j, length in enumerate(lengths):
                    runs = []
                    for f in found:
                        edges = [0, min(f["windows"], f["size"] - length + 1)] if f["ranges"] is None else f["ranges"][j]
                        runs += [(f["start"] + int(a), f["start"] + int(b) - 1 + length) for a, b in zip(edges[::2], edges[1::2]) if b > a]
                    spans: list[list[int]] = []
                    for a, b in sorted(runs):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                    starts.append([x[0] for x in spans]), ends.append([x[1] for x in spans])
                rows.append((key, t, starts, ends))
            yield pd.DataFrame(rows, columns=["id", "t", "starts", "ends"])

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """(id string, t, starts, ends): by length, byte spans of `docs` (id string, t, text) that repeated strings cover.

    `t` is a hash of the text; `gram` is a power of two below the least length.
    """
    long = docs.where(F.octet_length("text") >= min(lengths))
    rows = scratch.write("placed", placed(long, lengths, gram))
    piece = scratch.write("pieces", rows.groupBy("anchor", "h").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t")))
    classes = piece.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    # a piece that stands twice is decided already, but others are held against it
    wanted = piece.join(classes, "anchor").groupBy("t").agg(F.collect_list(F.struct("anchor", "h", (F.col("kinds") > large).alias("large"))).alias("wanted"))
    one = long.select("t", "text").join(wanted.hint("merge"), "t").dropDuplicates(["t"])
    cut = scratch.write("cut", _cut(one.select("text", "wanted"), lengths, gram))
    partly = constructed(cut.where(~F.col("large")), lengths)
    if cut.where("large").limit(1).count():
        partly = partly.unionByName(_by_hash(cut.where("large"), scratch, lengths))
    whole = piece.where(F.col("n") > 1).select("anchor", "h", F.lit(None).cast("array<array<int>>").alias("ranges"))
    verdicts = scratch.write("verdicts", partly.join(whole.select("anchor", "h"), ["anchor", "h"], "left_anti").unionByName(whole))
    scratch.drop("cut", "pieces")
    found = rows.join(verdicts.hint("merge"), ["anchor", "h"]).groupBy("id", "t").agg(F.collect_list(F.struct("start", "windows", "size", "ranges")).alias("found"))
    spans = scratch.write("spans", found.mapInPandas(_merge(lengths), "id string, t long, starts array<array<int>>, ends array<array<int>>"))
    scratch.drop("placed", "verdicts")
    return spans


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", report: tuple[int, ...] = ()) -> DataFrame:
    """(row, raw, n_spans, covered): all columns of `docs` in a struct, the UTF-8 bytes left of its text, removed runs,
    and for each length of `report` how many bytes of the text strings of that length cover which repeat.

    A byte goes if a string of `length` bytes that covers it also starts elsewhere, in this text or another one;
    strings are judged on the input. Every copy goes, the first too. A null text is empty; texts shorter than
    `length` stay whole, and texts may be of any length; repeated rows are copies of each other; an empty table gives
    no rows. Columns of any name are carried.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(docs[text_col], F.lit(""))
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    spans = repeated_spans(keyed.select("id", "t", "text"), scratch, (length, *report))
    both = keyed.join(spans.hint("merge"), ["id", "t"], "left")
    raw = F.encode("text", "utf-8")
    starts, ends = F.col("starts")[0], F.col("ends")[0]
    edges = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("a"), F.concat(starts, F.array(F.octet_length("text"))).alias("b"))
    left = F.aggregate(edges, F.lit(b""), lambda acc, e: F.concat(acc, F.substring(raw, e["a"] + 1, e["b"] - e["a"])))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x)
    covered = F.array(*(F.coalesce(total(F.col("ends")[j + 1]) - total(F.col("starts")[j + 1]), F.lit(0).cast("long")) for j in range(len(report)))).cast("array<long>")
    return both.select("row", F.when(F.col("starts").isNull(), raw).otherwise(left).alias("raw"), F.coalesce(F.size(starts), F.lit(0)).cast("long").alias("n_spans"), covered.alias("covered"))


def as_text(raw):
    """Bytes as text; characters that a removed run has cut through are left out."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))
