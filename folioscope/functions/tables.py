"""Table functions that SQL can call: windows of texts, their tokens, and extraction by a model.

All are polymorphic: the other columns of the table that is handed in come back beside the results, so that the
output of one can be the input of the next without a join. Each row is worked on alone, except in `token_counts`, which
sees the rows of one `PARTITION BY` key together.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

TEXT = "text"


def _others(table: AnalyzeArgument, made: list[StructField], name: str) -> list[StructField]:
    """The table's columns but its text; an error if it is no table, has no text, or a name meets a result's."""
    if not table.isTable:
        raise ValueError(f"{name} takes a table as its first argument")
    fields = table.dataType.fields
    if TEXT not in [f.name for f in fields]:
        raise ValueError(f"{name} takes a table with a column named {TEXT}")
    others = [f for f in fields if f.name != TEXT]
    if clash := sorted({f.name for f in others} & {f.name for f in made}):
        raise ValueError(f"{name} makes columns that the table has: {', '.join(clash)}")
    return others


def _rest(row: Row) -> tuple:
    return tuple(v for k, v in row.asDict(recursive=False).items() if k != TEXT)


WINDOW = [StructField("window_index", IntegerType()), StructField("window_start", IntegerType()), StructField("window_end", IntegerType()), StructField(TEXT, StringType())]


@udtf
class TextWindows:
    """text_windows(TABLE(t), size, overlap, least): overlapping slices of `size` characters of each text.

    A last slice shorter than `least` goes with the one before it. Null and empty texts have no window.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if not (size.isConstantExpression and overlap.isConstantExpression and size.value > 0 and 0 <= float(overlap.value) < 1):
            raise ValueError("text_windows takes a constant size above 0 and an overlap from 0 to below 1")
        return AnalyzeResult(StructType(_others(table, WINDOW, "text_windows") + WINDOW))

    def eval(self, row: Row, size: int, overlap: float, least: int) -> Iterator[tuple]:
        text = row[TEXT]
        if not text:
            return
        stride, length = max(1, round(size * (1 - float(overlap)))), len(text)
        starts = list(range(0, max(1, length - size + stride), stride))
        if len(starts) > 1 and length - starts[-1] < least:
            starts.pop()
        for k, start in enumerate(starts):
            end = length if k == len(starts) - 1 else start + size
            yield *_rest(row), k + 1, start, end, text[start:end]


COUNT = [StructField("token", StringType()), StructField("tf", LongType()), StructField("len", LongType())]


@udtf
class TokenCounts:
    """token_counts(TABLE(t) PARTITION BY key): how often each search token stands in the texts of a key.

    The columns beside the text are those of the key's least row, as rows of one key should not differ in them.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType(_others(table, COUNT, "token_counts") + COUNT))

    def __init__(self) -> None:
        self.counts: Counter[str] = Counter()
        self.rest: tuple | None = None

    def eval(self, row: Row) -> None:
        rest = _rest(row)
        self.rest = rest if self.rest is None else min(self.rest, rest, key=repr)
        for run in re.findall(r"[一-鿿]+|[A-Za-z0-9_]+", row[TEXT] or ""):
            if run[0] < "一":
                self.counts[run.lower()] += 1
            else:
                self.counts.update(run[i : i + n] for n in (1, 2, 3) for i in range(len(run) - n + 1))

    def terminate(self) -> Iterator[tuple]:
        length = sum(self.counts.values())
        for token, tf in self.counts.items():
            yield *self.rest, token, tf, length


SPAN = [StructField("span_index", IntegerType()), *(StructField(c, StringType()) for c in ("span_type", "summary")), StructField("salience_score", DoubleType()),
        *(StructField(c, StringType()) for c in ("start_anchor_quote", "end_anchor_quote", "key_quote", "error"))]


def extractor(make_client: Callable[[], object], prompt: Callable[[str], list[dict[str, str]]], attempts: int = 3):
    """extract_spans(TABLE(windows)): a row for each span of a model's answer, or one with the error of the last attempt.

    The client is made once a task. An answer counts if its outermost braces hold a JSON object with a list of spans.
    """

    @udtf
    class ExtractSpans:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(StructType(_others(table, SPAN, "extract_spans") + SPAN))

        def __init__(self) -> None:
            self.client = make_client()

        def eval(self, row: Row) -> Iterator[tuple]:
            error = ""
            for _ in range(max(1, attempts)):
                raw, _usage = self.client.complete(prompt(row[TEXT] or ""))
                try:
                    spans = json.loads(raw[raw.index("{") : raw.rindex("}") + 1])["spans"]
                    if not isinstance(spans, list):
                        raise ValueError("spans is no list")
                except (ValueError, KeyError) as e:
                    error = f"no spans in the answer: {e}"
                    continue
                text = lambda s, c: None if s.get(c) is None else str(s[c])
                for k, s in enumerate(x for x in spans if isinstance(x, dict)):
                    score = s.get("salience_score")
                    yield *_rest(row), k, text(s, "span_type"), text(s, "summary"), float(score) if isinstance(score, int | float) else None, *(text(s, c) for c in ("start_anchor_quote", "end_anchor_quote", "key_quote")), None
                return
            yield *_rest(row), None, None, None, None, None, None, None, error

    return ExtractSpans


class SliceClient:
    """A model that answers with two spans cut from fixed places of the passage."""

    def complete(self, messages: list[dict[str, str]]) -> tuple[str, dict[str, int]]:
        c = re.sub(r"\s+", " ", messages[-1]["content"]).strip()
        ends = c[80:120] or c[-40:]
        one = {"span_type": "progression", "summary": c[:100] or "空窗口", "salience_score": 0.5, "start_anchor_quote": c[:40], "end_anchor_quote": ends, "key_quote": c[:40]}
        two = {"span_type": "exposition", "summary": c[40:140] or c[:100] or "空窗口", "salience_score": 0.45, "start_anchor_quote": c[40:80] or c[:40], "end_anchor_quote": c[120:160] or ends, "key_quote": c[40:80] or c[:40]}
        return json.dumps({"spans": [one, two]}), {}


def register(spark: SparkSession, make_client: Callable[[], object] = SliceClient, prompt: Callable[[str], list[dict[str, str]]] = lambda text: [{"role": "user", "content": text}]) -> None:
    """Make the functions callable from SQL under their names."""
    spark.udtf.register("text_windows", TextWindows)
    spark.udtf.register("token_counts", TokenCounts)
    spark.udtf.register("extract_spans", extractor(make_client, prompt))
