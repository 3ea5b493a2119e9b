"""Span extraction around a model: requests, deterministic mock, payload parsing, batch results, status, usage."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import strip
from ..sources.scratch import settled
from . import locate

PAYLOAD = "struct<spans:array<struct<span_type:string,summary:string,entities:array<string>,salience_score:double,start_anchor_quote:string,end_anchor_quote:string,key_quote:string>>>"
#: What a window gives to locate its spans.
WINDOW = ("window_start", "window_end", "text")
RETRYABLE = ("start anchor not found", "end anchor not found", "no ordered start/end anchor pair found")


def select_windows(windows: DataFrame, ids: list[str] | None = None, ranges: list[str] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Windows by id, or by 1-based inclusive ranges (`a-b`, `a:b`, `n`) of their order; else by offset and limit.

    An id that no window has, and a range that reaches beyond the windows of every document, is an error.
    """
    order = Window.partitionBy("document_id").orderBy("chapter_index", "window_index")
    numbered = windows.withColumn("global_index", F.row_number().over(order))
    if not ids and not ranges:
        kept = numbered.where(F.col("global_index") > offset)
        return kept.where(F.col("global_index") <= offset + limit) if limit is not None else kept
    wanted = F.lit(False)
    if ids:
        names = list(dict.fromkeys(part.strip() for item in ids for part in item.split(",") if part.strip()))
        wanted = wanted | F.col("window_id").isin(*names)
        there = {r["window_id"] for r in windows.where(F.col("window_id").isin(*names)).select("window_id").distinct().collect()}  # at most the names
        if missing := [n for n in names if n not in there]:
            raise ValueError(f"windows not found: {', '.join(missing)}")
    last = 0
    for text in ranges or []:
        m = re.fullmatch(r"\s*(\d+)\s*(?:[-:]\s*(\d+)\s*)?", text)
        if not m or int(m[1]) < 1 or int(m[2] or m[1]) < int(m[1]):
            raise ValueError(f"bad window range: {text}")
        wanted, last = wanted | F.col("global_index").between(int(m[1]), int(m[2] or m[1])), max(last, int(m[2] or m[1]))
    if last and (most := numbered.agg(F.max("global_index")).first()[0] or 0) < last:
        raise ValueError(f"a window range reaches {last}, but there are {most} windows")
    return numbered.where(wanted)


def mock_spans(windows: DataFrame, keep_text: bool = False) -> DataFrame:
    """Two spans of each window from fixed slices of its compacted text: an extractor without a model.

    With `keep_text` they keep their window's bounds and text, so that they are located without a join.
    """
    compact = strip(F.regexp_replace("text", r"[\s\x1c-\x1f\x85\p{Z}]+", " "))
    cut = lambda a, b: F.substring(F.col("compact"), a + 1, b - a)
    or_else = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))
    first_end = or_else(cut(80, 120), F.right("compact", F.lit(40)))
    spans = F.array(
        F.struct(F.lit(0).alias("span_index"), F.lit("progression").alias("span_type"), or_else(cut(0, 100), F.lit("空窗口")).alias("summary"), F.lit(0.5).alias("salience_score"), cut(0, 40).alias("start_anchor_quote"), first_end.alias("end_anchor_quote"), cut(0, 40).alias("key_quote")),
        F.struct(F.lit(1).alias("span_index"), F.lit("exposition").alias("span_type"), or_else(cut(40, 140), cut(0, 100), F.lit("空窗口")).alias("summary"), F.lit(0.45).alias("salience_score"), or_else(cut(40, 80), cut(0, 40)).alias("start_anchor_quote"), or_else(cut(120, 160), first_end).alias("end_anchor_quote"), or_else(cut(40, 80), cut(0, 40)).alias("key_quote")),
    )
    held = ["document_id", "chapter_id", "window_id", *(WINDOW if keep_text else [])]
    each = windows.withColumn("compact", compact).select(*held, F.explode(spans).alias("s")).select(*held, "s.*")
    span_id = F.concat(F.lit("span_"), F.col("window_id"), F.lit("_"), F.lpad((F.col("span_index") + 1).cast("string"), 3, "0"))
    return each.withColumns({"span_id": span_id, "entities": F.array().cast("array<string>")})


def parse_payload(raw: Column) -> Column:
    """A model's answer as PAYLOAD: the whole text as JSON, or its outermost braces; null if neither parses."""
    strict = {"mode": "PERMISSIVE"}
    whole = F.from_json(raw, PAYLOAD, strict)
    inner = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), PAYLOAD, strict)
    return F.when(whole["spans"].isNotNull(), whole).when(inner["spans"].isNotNull(), inner)


def payload_problem(span: Column) -> Column:
    """Why a parsed span breaks the schema; null if it doesn't."""
    blank = lambda c: F.coalesce(strip(span[c]) == "", F.lit(True))
    out = F.lit(None).cast("string")
    for c in ("end_anchor_quote", "start_anchor_quote", "summary"):
        out = F.when(blank(c), f"{c} is blank").otherwise(out)
    return F.when(~F.coalesce(span["salience_score"].between(0, 1), F.lit(False)), "salience_score outside [0, 1]").otherwise(out)


def span_type(raw: Column) -> Column:
    return F.when(F.lower(strip(raw)).isin(*fixed.SPAN_TYPES), F.lower(strip(raw))).otherwise("other")


def locate_spans(spans: DataFrame, windows: DataFrame | None = None, least: int = 4, most: int = 80, threshold: float = 0.86) -> DataFrame:
    """Extracted spans with coordinates, confidence and status, found from their anchors inside their windows.

    Without windows, the spans hold the bounds and texts of theirs.
    """
    rows = spans if windows is None else spans.join(windows.select("window_id", *WINDOW), "window_id")
    rows = rows.withColumns({"start_anchor": locate.trim_anchor(F.col("start_anchor_quote"), "start", most), "end_anchor": locate.trim_anchor(F.col("end_anchor_quote"), "end", most)})
    problem = locate.anchor_problem(F.col("start_anchor"), F.col("end_anchor"), least, most)
    found = locate.locate_anchors(rows, threshold).withColumn("failure_reason", F.coalesce(problem, "failure_reason"))
    ok = F.col("failure_reason").isNull()
    a, b = F.when(ok, F.col("best.start_idx")), F.when(ok, F.col("best.end_idx"))
    located = F.when(ok, F.substring(F.col("text"), a - F.col("window_start") + 1, b - a))
    keep = [c for c in spans.columns if c not in WINDOW]
    return found.select(*keep, "window_start", "window_end", a.alias("span_start_idx"), b.alias("span_end_idx"), located.alias("located_text"), F.when(ok, F.col("best.confidence")).otherwise(0.0).alias("locator_confidence"), F.when(ok, "located").otherwise("failed").alias("locator_status"), "failure_reason")


class ChatClient(Protocol):
    def complete(self, messages: list[dict[str, str]]) -> tuple[str, dict[str, int]]: ...


def extraction_messages(text: str, least: int = 4, most: int = 80) -> list[dict[str, str]]:
    """What a model is asked for a window: JSON with the spans, each between two anchors quoted from the text."""
    rules = (
        "Divide the passage into semantic spans and answer with one JSON object, {\"spans\": [...]}. Each span has span_type "
        f"(one of {', '.join(fixed.SPAN_TYPES)}), summary, entities, salience_score from 0 to 1, key_quote, start_anchor_quote and "
        f"end_anchor_quote. Anchors are copied from the passage, {least} to {most} characters each; the end anchor does not stand before the start anchor."
    )
    return [{"role": "system", "content": rules}, {"role": "user", "content": text}]


def _located(spans: list[dict], text: str, most: int, threshold: float) -> list[str | None]:
    """Why each span of a parsed answer is not found in its window; None where it is."""
    find = lambda q: locate.normalized_occurrences(text, q) or locate.fuzzy_occurrences(text, q, threshold)
    out: list[str | None] = []
    for s in spans:
        a, b = str(s.get("start_anchor_quote") or "").strip()[:most], str(s.get("end_anchor_quote") or "").strip()[-most:]
        starts, ends = find(a) if a else [], find(b) if b else []
        if not starts or not ends:
            out.append("start anchor not found" if not starts else "end anchor not found")
        else:
            out.append(None if any(e[1] >= x[0] for x in starts for e in ends) else "no ordered start/end anchor pair found")
    return out


def extract(windows: DataFrame, make_client: Callable[[], ChatClient], prompt: Callable[[str], list[dict[str, str]]] = extraction_messages, retries: int = 2, most: int = 80, threshold: float = 0.86) -> DataFrame:
    """(window_id, raw_output, attempts, input_tokens, output_tokens, error): one model call a window.

    It is repeated while the answer holds no JSON object, or holds spans that RETRYABLE reasons keep from being
    located; tokens add up over the attempts, and the last answer that parsed is kept. The client is made once a task.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            rows = []
            for window_id, text in zip(pdf["window_id"], pdf["text"], strict=True):
                used, error, kept = [0, 0], None, None
                for attempt in range(1, max(1, retries + 1) + 1):
                    raw, usage = client.complete(prompt(text))
                    used = [used[0] + usage.get("input_tokens", 0), used[1] + usage.get("output_tokens", 0)]
                    try:
                        payload = json.loads(raw[raw.index("{") : raw.rindex("}") + 1])
                    except ValueError as e:
                        error = str(e) if kept is None else None
                        kept = kept if kept is not None else None
                        last = raw
                        continue
                    kept = last = raw
                    error = None
                    spans = [s for s in payload.get("spans") or [] if isinstance(s, dict)]
                    if not any(reason in RETRYABLE for reason in _located(spans, text, most, threshold)):
                        break
                rows.append((window_id, last if kept is None else kept, attempt, *used, error))
            yield pd.DataFrame(rows, columns=["window_id", "raw_output", "attempts", "input_tokens", "output_tokens", "error"])

    return windows.select("window_id", "text").mapInPandas(run, "window_id string, raw_output string, attempts int, input_tokens int, output_tokens int, error string")


def failed_windows(windows: DataFrame, answers: DataFrame, spans: DataFrame) -> DataFrame:
    """One synthetic failed span for each answered window without any span: its id, status and reason.

    answers (window_id, raw_output, attempts, error); spans (window_id, ...) are those that were parsed.
    """
    lost = answers.join(spans.select("window_id"), "window_id", "left_anti").join(windows.select("window_id", "document_id", "chapter_id", "window_start", "window_end"), "window_id")
    reason = F.coalesce("error", F.lit("window extraction produced no valid spans"))
    return lost.select(F.concat(F.lit("span_"), "window_id", F.lit("_001")).alias("span_id"), "document_id", "chapter_id", "window_id", F.lit(1).alias("span_index_in_window"), "window_start", "window_end", F.lit("failed").alias("locator_status"), F.lit(False).alias("parsed"), reason.alias("failure_reason"), "attempts", "raw_output")


def with_usage(spans: DataFrame, answers: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """Spans with the window's tokens and cost on its first span, and none on the others."""
    first = F.row_number().over(Window.partitionBy("window_id").orderBy("span_id")) == 1
    of = spans.join(answers.select("window_id", F.col("input_tokens").alias("__in"), F.col("output_tokens").alias("__out")), "window_id", "left").withColumn("__first", first)
    tokens = {c: F.when(F.col("__first"), F.coalesce(x, F.lit(0))).otherwise(0) for c, x in (("input_tokens", "__in"), ("output_tokens", "__out"))}
    return of.withColumns(tokens).withColumn("cost", usage_cost(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out)).drop("__in", "__out", "__first")


def persisted(results: DataFrame, candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a run writes: its spans, its locator candidates, and a failure for each span that is not located.

    A failure's stage is `locator` where the answer parsed (column `parsed`), else `extraction`.
    """
    lost = results.where(F.col("locator_status") != "located")
    stage = F.when(F.coalesce("parsed", F.lit(True)), "locator").otherwise("extraction")
    failures = lost.select("window_id", "span_id", stage.alias("stage"), F.coalesce("failure_reason", F.lit("unknown failure")).alias("reason"), "attempts", "raw_output")
    out = {"spans": results.drop("parsed", "failure_reason", "attempts", "raw_output"), "extraction_failures": failures}
    return out | ({"locator_candidates": candidates} if candidates is not None else {})


def replace_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Locator candidates with those of the spans that `new` holds replaced."""
    return old.join(new.select("span_id").distinct(), "span_id", "left_anti").unionByName(new)


def replace_failures(old: DataFrame, new: DataFrame, windows: DataFrame) -> DataFrame:
    """Failures with those of the windows extracted again taken out and the new ones appended."""
    return old.join(windows.select("window_id").distinct(), "window_id", "left_anti").unionByName(new)


def batch_requests(windows: DataFrame, model: str, system: str) -> DataFrame:
    """(custom_id, line): one JSON request line a window."""
    message = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    body = F.struct(F.lit(model).alias("model"), message.alias("messages"))
    line = F.to_json(F.struct(F.col("window_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    return windows.select(F.col("window_id").alias("custom_id"), line.alias("line"))


#: Fixed value: lines that a provider takes in one file.
BATCH_FILE_LINES = 5000


def write_batch_files(requests: DataFrame, path: str, most: int = BATCH_FILE_LINES) -> DataFrame:
    """Request lines in files of at most `most` lines, one folder `file=<n>` each; (file, lines) of what was written.

    Lines are numbered by the counts of the partitions before them, so that no task sees more than its own.
    """
    held = settled(requests.select("custom_id", "line"), "requests").withColumn("task", F.spark_partition_id())
    sizes = held.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    place = F.row_number().over(Window.partitionBy("task").orderBy("custom_id"))
    numbered = held.join(sizes.select("task", before.alias("before")), "task").withColumn("file", F.floor((F.col("before") + place - 1) / most).cast("int"))
    numbered.repartition("file").sortWithinPartitions("file", "custom_id").select("file", F.col("line").alias("value")).write.mode("overwrite").partitionBy("file").text(path)
    return numbered.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


BATCH_LINE = "struct<custom_id:string,response:struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:int,completion_tokens:int,total_tokens:int>>>,error:string>"


def batch_outputs(lines: DataFrame) -> DataFrame:
    """(custom_id, raw_output, error, total_tokens) of response lines in a column `value`."""
    r = F.from_json("value", BATCH_LINE)
    status = r["response"]["status_code"]
    error = F.coalesce(r["error"], F.when(status != 200, F.concat(F.lit("status "), status.cast("string"))))
    return lines.select(r["custom_id"].alias("custom_id"), r["response"]["body"]["choices"][0]["message"]["content"].alias("raw_output"), error.alias("error"), F.coalesce(r["response"]["body"]["usage"]["total_tokens"], F.lit(0)).alias("total_tokens"))


def batch_apply(windows: DataFrame, outputs: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(window_id, payload, retry_reason, total_tokens): each window's parsed output, or why it has to be asked again."""
    out = windows.select("window_id").join(outputs.withColumnRenamed("custom_id", "window_id"), "window_id", "left")
    out = out.withColumn("there", F.col("error").isNotNull() | F.col("raw_output").isNotNull())
    if prior is not None:
        out = out.join(prior.select("window_id", F.col("total_tokens").alias("prior_tokens")), "window_id", "left")
    else:
        out = out.withColumn("prior_tokens", F.lit(0))
    payload = parse_payload(F.col("raw_output"))
    reason = F.when(~F.col("there"), "batch output missing").when(F.col("error").isNotNull(), F.col("error")).when(payload.isNull(), "payload does not parse")
    return out.select("window_id", F.when(reason.isNull(), payload).alias("payload"), reason.alias("retry_reason"), (F.coalesce("total_tokens", F.lit(0)) + F.coalesce("prior_tokens", F.lit(0))).alias("total_tokens"))


def batch_rounds(windows: DataFrame, submit: Callable[[DataFrame], DataFrame], live: Callable[[DataFrame], DataFrame], threshold: int = 3, rounds: int = 3) -> tuple[list[DataFrame], DataFrame]:
    """Submit; repeat what has to be asked again while it is more than `threshold` windows and rounds are left; a
    small rest goes to `live`, a large one comes back deferred. Only counts reach the driver."""
    done, pending = [], windows
    for _ in range(rounds):
        applied = settled(batch_apply(pending, submit(pending)), "applied")
        done.append(applied.where(F.col("retry_reason").isNull()))
        pending = pending.join(applied.where(F.col("retry_reason").isNotNull()).select("window_id"), "window_id", "left_semi")
        left = pending.limit(threshold + 1).count()
        if not left:
            return done, pending
        if left <= threshold:
            done.append(live(pending))
            return done, pending.limit(0)
    return done, pending


def window_status(windows: DataFrame, spans: DataFrame, failures: DataFrame) -> DataFrame:
    """Windows in order with their counts of spans and failures, extracted or pending."""
    s = spans.groupBy("window_id").agg(F.count(F.lit(1)).alias("span_count"), F.count_if(F.col("locator_status") == "located").alias("located_count"), F.count_if(F.col("locator_status") != "located").alias("failed_span_count"))
    f = failures.groupBy("window_id").agg(F.count(F.lit(1)).alias("failure_count"))
    out = windows.join(s, "window_id", "left").join(f, "window_id", "left").na.fill(0, ["span_count", "located_count", "failed_span_count", "failure_count"])
    order = Window.partitionBy("document_id").orderBy("chapter_index", "window_index")
    status = F.when((F.col("span_count") > 0) | (F.col("failure_count") > 0), "extracted").otherwise("pending")
    return out.select("document_id", "chapter_id", "window_id", F.row_number().over(order).alias("global_index"), "span_count", "located_count", "failed_span_count", "failure_count", status.alias("status"))


def usage_cost(input_tokens: Column, output_tokens: Column, price_in: float, price_out: float, digits: int = 6) -> Column:
    return F.round(input_tokens / 1000 * price_in + output_tokens / 1000 * price_out, digits)


def extraction_report(spans: DataFrame, failures: DataFrame | None = None, samples: int = 5) -> DataFrame:
    """(document_id, spans, located, rates, tokens and cost if spans bear them, failures, first summaries)."""
    located = F.count_if(F.col("locator_status") == "located")
    used = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cost") if c in spans.columns]
    first = F.slice(F.array_sort(F.collect_list(F.struct("span_id", "summary"))), 1, samples)
    out = spans.groupBy("document_id").agg(F.count(F.lit(1)).alias("total_spans"), located.alias("located_spans"), F.round(located / F.count(F.lit(1)), 4).alias("locator_success_rate"), *used, *([F.transform(first, lambda s: s["summary"]).alias("samples")] if samples and "summary" in spans.columns else []))
    if failures is None:
        return out
    lost = failures.join(spans.select("window_id", "document_id").distinct(), "window_id").groupBy("document_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    lost = lost.groupBy("document_id").agg(F.sum("n").alias("failure_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("failures_by_stage"))
    return out.join(lost, "document_id", "left").na.fill(0, ["failure_count"])


#: States in which a batch changes no more.
TERMINAL = ("completed", "failed", "expired", "cancelled", "cancelling")


def poll_batch(status: Callable[[], dict], wait: bool = True, interval: float = 30.0, timeout: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The batch's state once it is terminal, or when waiting ends; a second at least lies between two calls."""
    began = clock()
    while True:
        now = status()
        if not wait or now["status"] in TERMINAL or (timeout is not None and clock() - began >= timeout):
            return now
        sleep(max(1.0, interval))


def batch_report(run_id: str, batch: dict, windows: int, rounds: list[dict] | None = None) -> dict:
    """The report of a batch that has brought nothing yet: counts of zero beside the batch's own state."""
    counts = dict.fromkeys(("span_count", "extraction_success_count", "extraction_failed_count", "locator_success_count", "locator_failed_count"), 0)
    rates = dict.fromkeys(("structured_success_rate", "locator_success_rate", "estimated_cost_yuan"), 0)
    state = {k: batch.get(k) for k in ("batch_id", "status", "input_file_id", "output_file_id", "error_file_id", "request_counts")}
    return {"run_id": run_id, "mode": "batch", "window_count": windows, **counts, **rates, "usage": usage_total([]), "batch": state, "retry_rounds": rounds or []}


def usage_total(parts: list[dict[str, int]]) -> dict[str, int]:
    return {k: sum(int(p.get(k, 0)) for p in parts) for k in ("input_tokens", "output_tokens", "total_tokens")}
