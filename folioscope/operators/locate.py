"""Quote location: exact, normalised and fuzzy occurrences of quotes inside windows, and anchor pairs.

Exact occurrences are expressions where they are all that is asked for. Normalised and fuzzy ones need a
per-character index map and a sequence matcher; the cascade runs as one Arrow function for all quotes of a row, and a
dearer tier sees only what the cheaper ones left without a match.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let, strip

CANDIDATE = "struct<start_idx:int,end_idx:int,confidence:double,strategy:string>"
CANDIDATES = f"array<{CANDIDATE}>"


def exact_occurrences(text: Column, quote: Column, window_start: Column | None = None) -> Column:
    """All occurrences, overlapping ones too, as candidates with confidence 1."""
    base = window_start if window_start is not None else F.lit(0)
    none = F.array().cast("array<int>")
    literal = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    after = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + 1
    # as many steps as there are occurrences, each from behind the start of the one before
    walk = F.aggregate(F.sequence(F.lit(1), F.regexp_count(text, literal)), none, lambda acc, _: F.array_append(acc, F.position(quote, text, after(acc))))
    places = F.when((F.length(quote) > 0) & text.contains(quote), walk).otherwise(none)  # most windows end here
    candidate = lambda i: F.struct((base + i - 1).cast("int").alias("start_idx"), (base + i - 1 + F.length(quote)).cast("int").alias("end_idx"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("strategy"))
    return F.transform(places, candidate)


#: Characters of all quotes in one automaton; more quotes are searched for in several passes.
AUTOMATON_CHARS = 20_000_000


def quote_occurrences(docs: DataFrame, quotes: DataFrame, id_col: str = "document_id", quote_id: str = "quote_id") -> DataFrame:
    """(id_col, quote_id, start_idx, end_idx): every occurrence of every quote in every text, overlapping ones too.

    One pass over the texts with an automaton of all quotes (quote_id, quote); quotes are a query set that travels
    with the tasks, in blocks of a bounded number of characters. Null and empty quotes stand nowhere.
    """
    wanted = quotes.where(F.length("quote") > 0).select(quote_id, "quote")
    total = wanted.agg(F.sum(F.length("quote")).alias("n")).first()["n"] or 0
    blocks = int(total // AUTOMATON_CHARS) + 1
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {quote_id} {quotes.schema[quote_id].dataType.simpleString()}, start_idx int, end_idx int"
    out = None
    for k in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == k).collect() if total else []
        by_quote: dict[str, list] = {}
        for r in rows:
            by_quote.setdefault(r["quote"], []).append(r[quote_id])
        part = docs.select(id_col, "text").mapInPandas(_automaton_search(by_quote, [id_col, quote_id, "start_idx", "end_idx"]), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _automaton_search(by_quote: dict[str, list], names: list[str]):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for quote, ids in by_quote.items():
            automaton.add_word(quote, (len(quote), ids))
        automaton.make_automaton()
        for pdf in batches:
            rows = []
            for key, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                if isinstance(text, str) and by_quote:
                    rows += [(key, q, end + 1 - n, end + 1) for end, (n, ids) in automaton.iter(text) for q in ids]
            yield pd.DataFrame(rows, columns=names)

    return run


class _Forms(dict):
    """What each character becomes before white space is collapsed, by its code; filled as characters are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = "".join(" " if c.isspace() else c for c in unicodedata.normalize("NFKC", fixed.MATCH_REPLACEMENTS.get(char, char)))
        return self[code]


_FORMS = _Forms()
_SPACES = re.compile(" +")


@lru_cache(maxsize=16)
def _form(text: str) -> tuple[str, np.ndarray]:
    """match_form, kept for the last texts: the quotes of a window stand in neighbouring rows."""
    spaced = text.translate(_FORMS)
    source = np.arange(len(text))
    if len(spaced) != len(text):  # no character becomes empty, so equal lengths are one to one
        source = np.repeat(source, [len(_FORMS[ord(c)]) for c in text])
    blank = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32) == 32
    kept = ~blank
    kept[1:] |= ~blank[:-1]  # the first of each run, except before all else
    form = _SPACES.sub(" ", spaced).strip(" ")
    return form, source[kept][: len(form)]


def match_form(text: str) -> tuple[str, list[int]]:
    """Text as it is compared, and the source index of each of its characters."""
    form, source = _form(text)
    return form, source.tolist()


def exact_places(text: str, quote: str) -> list[tuple[int, int, float, str]]:
    """As exact_occurrences: all of them, overlapping ones too."""
    found, at = [], text.find(quote) if quote else -1
    while at >= 0:
        found.append((at, at + len(quote), 1.0, "exact"))
        at = text.find(quote, at + 1)
    return found


def normalized_occurrences(text: str, quote: str) -> list[tuple[int, int, float, str]]:
    (form, source), (wanted, _) = _form(text), _form(quote)
    found, at = [], form.find(wanted) if wanted else -1
    while at >= 0:
        found.append((int(source[at]), int(source[at + len(wanted) - 1]) + 1, 0.96, "normalized"))
        at = form.find(wanted, at + 1)
    return found


def fuzzy_occurrences(text: str, quote: str, threshold: float) -> list[tuple[int, int, float, str]]:
    """Fragments whose matching ratio reaches the threshold: the best of each start, the ten best of all.

    A ratio counts characters in common, whatever their order, at most; so with running counts of the quote's
    characters along the text, a bound on the ratio of every fragment is a difference of two rows, and only fragments
    within it meet the sequence matcher.
    """
    form, source = match_form(text)
    wanted, _ = match_form(quote)
    n = len(wanted)
    if n < 8 or not form:
        return []
    letters = sorted(set(wanted))
    codes, have = np.array(list(form)), np.array([wanted.count(c) for c in letters])
    running = np.zeros((len(form) + 1, len(letters)), np.int32)
    for k, c in enumerate(letters):
        running[1:, k] = np.cumsum(codes == c)
    best: dict[int, tuple[int, int, float, str]] = {}
    matcher = SequenceMatcher(None, "", "", autojunk=False)
    for size in range(max(4, math.floor(n * 0.75)), min(len(form), max(n + 24, math.floor(n * 1.25))) + 1):
        if 2 * min(n, size) < threshold * (n + size):
            continue  # even a perfect match of the shorter stays below the threshold
        common = np.minimum(running[size:] - running[:-size], have).sum(1)
        for at in np.flatnonzero(2.0 * common / (n + size) >= threshold).tolist():
            matcher.set_seqs(wanted, form[at : at + size])
            ratio = matcher.ratio()
            if ratio >= threshold:
                start, score = source[at], round(ratio, 4)
                if start not in best or score > best[start][2]:
                    best[start] = (start, source[at + size - 1] + 1, score, "fuzzy")
    return sorted(best.values(), key=lambda c: -c[2])[:10]


def best_pair(starts: list[dict], ends: list[dict], middle: float) -> dict | None:
    """What best_candidate finds among anchor_pairs, without their product: None if no end fits a start.

    Of the ends of one confidence, a start's best is one of the two beside the place that would put the pair's middle
    on the window's, so a start costs a search and not a pass over all ends.
    """
    if not starts or not ends or max(c["end_idx"] for c in ends) < min(c["start_idx"] for c in starts):
        return None
    if len(starts) == len(ends) == 1:  # most rows
        return _paired(starts[0], ends[0])
    best = None
    s = np.array([c["start_idx"] for c in starts], np.int64)
    for sure in dict.fromkeys(c["confidence"] for c in ends):
        held = [j for j, c in enumerate(ends) if c["confidence"] == sure]
        held.sort(key=lambda j: ends[j]["end_idx"])  # stable: of equal ends the first found is first
        e = np.array([ends[j]["end_idx"] for j in held], np.int64)
        above = np.searchsorted(e, np.maximum(s, 2 * middle - s))
        below = np.where(above > 0, np.searchsorted(e, e[above - 1]), -1)
        for at in (below, above):
            fits = np.flatnonzero((at >= 0) & (at < len(e)))
            fits = fits[e[at[fits]] >= s[fits]]
            for i, k in zip(fits.tolist(), at[fits].tolist(), strict=True):
                a, z = starts[i], ends[held[k]]
                key = (-_mean(a, z), abs((a["start_idx"] + z["end_idx"]) / 2 - middle), z["end_idx"] - a["start_idx"], i, held[k])
                if best is None or key < best[0]:
                    best = key, a, z
    return _paired(*best[1:])


def _mean(start: dict, end: dict) -> float:
    """The pair's confidence, rounded as F.round does."""
    a, z = start["confidence"], end["confidence"]
    return a if a == z else float(Decimal(repr((a + z) / 2)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def _paired(start: dict, end: dict) -> dict:
    return {"start_idx": start["start_idx"], "end_idx": end["end_idx"], "confidence": _mean(start, end), "strategy": f"anchors:start_{start['strategy']}+end_{end['strategy']}"}


def with_candidates(rows: DataFrame, quotes: dict[str, str], threshold: float = 0.86, pair: str | None = None) -> DataFrame:
    """rows (text, window_start, quote...) with the candidates of the first tier that finds any, for each quote -> name.

    All quotes of a row are looked for in one Arrow function, so that its text goes to Python once. Rows are neither
    joined nor keyed. With `pair`, that column is the best pair of the first two quotes' candidates.
    """
    names = list(quotes.values())
    fields = [("start_idx", pa.int32()), ("end_idx", pa.int32()), ("confidence", pa.float64()), ("strategy", pa.string())]

    def tiers(text: str | None, start: int, quote: str | None) -> list[dict]:
        if text is None or quote is None:
            return []
        hits = exact_places(text, quote)
        if not hits and quote.strip():
            hits = normalized_occurrences(text, quote) or fuzzy_occurrences(text, quote, threshold)
        return [{"start_idx": start + a, "end_idx": start + b, "confidence": c, "strategy": s} for a, b, c, s in hits]

    @F.arrow_udf(f"struct<{', '.join(f'{n}:{CANDIDATES}' for n in names)}{f', {pair}:{CANDIDATE}' if pair else ''}>")
    def found(*columns: pa.Array) -> pa.Array:
        texts, starts, ends, *wanted = (c.to_pylist() for c in columns)
        each = [[tiers(*r) for r in zip(texts, starts, w, strict=True)] for w in wanted]
        out = [pa.array(c, pa.list_(pa.struct(fields))) for c in each]
        if pair:
            out.append(pa.array([best_pair(a, z, (lo + hi) / 2) for a, z, lo, hi in zip(*each[:2], starts, ends, strict=True)], pa.struct(fields)))
        return pa.StructArray.from_arrays(out, [*names, *([pair] if pair else [])])

    got = rows.withColumn("__found", found("text", "window_start", "window_end" if pair else "window_start", *quotes))
    return got.withColumns({n: F.col(f"__found.{n}") for n in [*names, *([pair] if pair else [])]}).drop("__found")


def best_candidate(candidates: Column, window_start: Column, window_end: Column) -> Column:
    """Highest confidence, then nearest to the window's middle, then shortest, then first found."""
    middle = (window_start + window_end) / 2
    keyed = F.transform(candidates, lambda c, i: F.struct(-c["confidence"], F.abs((c["start_idx"] + c["end_idx"]) / 2 - middle), c["end_idx"] - c["start_idx"], i, c.alias("c")))
    return F.array_min(keyed)["c"]


def locate_quotes(rows: DataFrame, quote: str = "quote", threshold: float = 0.86) -> DataFrame:
    """rows with `candidates`, `best` and `status`."""
    found = with_candidates(rows, {quote: "candidates"}, threshold)
    best = best_candidate(F.col("candidates"), F.col("window_start"), F.col("window_end"))
    return found.withColumns({"best": best, "status": F.when(F.size("candidates") > 0, "located").otherwise("failed")})


def anchor_problem(start: Column, end: Column, least: int = 4, most: int = 80) -> Column:
    out = F.lit(None).cast("string")
    for name, anchor in (("end", end), ("start", start)):
        n = F.length(strip(anchor))
        out = F.when((n < least) | (n > most), F.format_string(f"{name} anchor length %d outside [{least}, {most}]", n)).otherwise(out)
    return out


def trim_anchor(anchor: Column, role: str, most: int = 80) -> Column:
    clean = strip(anchor)
    return F.right(clean, F.lit(most)) if role == "end" else F.left(clean, F.lit(most))


def anchor_pairs(starts: Column, ends: Column) -> Column:
    """Every start with every end that does not end before it: the candidates' product inside one window."""

    def with_start(s: Column, ends: Column) -> Column:
        fits = F.filter(ends, lambda e: e["end_idx"] >= s["start_idx"])
        pair = lambda e: F.struct(s["start_idx"].alias("start_idx"), e["end_idx"].alias("end_idx"), F.round((s["confidence"] + e["confidence"]) / 2, 4).alias("confidence"), F.concat(F.lit("anchors:start_"), s["strategy"], F.lit("+end_"), e["strategy"]).alias("strategy"))
        return F.transform(fits, pair)

    return let(ends, lambda es: F.flatten(F.transform(starts, lambda s: with_start(s, es))))


def locate_anchors(rows: DataFrame, threshold: float = 0.86) -> DataFrame:
    """rows (text, window_start, window_end, start_anchor, end_anchor) with the span between the anchors."""
    clean = rows.withColumns({"start_anchor": strip(F.col("start_anchor")), "end_anchor": strip(F.col("end_anchor"))})
    found = with_candidates(clean, {"start_anchor": "starts", "end_anchor": "ends"}, threshold, "best")
    found = found.withColumn("pairs", anchor_pairs(F.col("starts"), F.col("ends")))  # made only where it is read
    reason = (
        F.when(F.col("start_anchor") == "", "start anchor is empty")
        .when(F.col("end_anchor") == "", "end anchor is empty")
        .when(F.size("starts") == 0, "start anchor not found")
        .when(F.size("ends") == 0, "end anchor not found")
        .when(F.col("best").isNull(), "no ordered start/end anchor pair found")
    )
    return found.withColumns({"failure_reason": reason, "best": F.when(reason.isNull(), F.col("best")), "status": F.when(reason.isNull(), "located").otherwise("failed")}).drop("starts", "ends")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in `order`."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
