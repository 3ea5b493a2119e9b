"""The state of model batches as a stream: rounds, deadlines, a terminal marker, and what has to be asked again.

A line tells that a request was submitted, that its output or an error came, or how its batch stands. A round opens
with its first line and closes when its time is up, or a while after its batch became terminal, whichever is first; its
deadline is an event time, and a round is reported when the watermark has passed it. Lines are held by time, kind
and request until then; the batches of a group share the calls to the store and one timer. So the report depends on the lines alone: not on their order, on repeats, on how micro-batches
are cut, or on a restart in between. Lines later than a deadline belong to the next round, which asks only what
is left over; after the last round, and behind the watermark, lines count no more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.extraction import TERMINAL

MISSING = "batch output missing"
REPORT = "batch_id string, round int, status string, windows int, done int, retry array<string>, reasons array<string>, closed_ms bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups that batches are dealt into by the hash of their id: a group's lines are stored and read together.
GROUPS = 512
#: Shares of a group's closed batches that are read and written together.
SHELVES = 16
KEY = ["batch_id", "at_ms", "kind", "custom_id"]


class BatchRounds(StatefulProcessor):
    """State of a group of batches; a call to the store carries a group's lines, not one line.

    What comes is appended as one chunk. A group's timer stands at the least deadline that its lines can have; when it
    is due, all rounds of the group whose deadline is past are closed, and what is left is one chunk again. Of a batch
    whose first round is closed its number and what it asks again are held.
    """

    def __init__(self, timeout_ms: int, grace_ms: int, rounds: int) -> None:
        self.timeout_ms, self.grace_ms, self.rounds = timeout_ms, grace_ms, rounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "at bigint")
        self.lines = handle.getListState("lines", "batch_id array<string>, at_ms array<bigint>, kind array<string>, custom_id array<string>, detail array<string>")
        self.numbers = handle.getMapState("numbers", "shelf int", "batch_id array<string>, round array<int>, open array<array<string>>")

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([pdf[[*KEY, "detail"]] for pdf in rows]).groupby(KEY, as_index=False, sort=False)["detail"].min()
        if len(new):
            self.lines.appendValue(tuple(new[c].tolist() for c in (*KEY, "detail")))
            self._wake(int(self._bounds(new["at_ms"], new["kind"], new["detail"]).min()))
        yield pd.DataFrame()

    def _bounds(self, at: pd.Series, kind: pd.Series, detail: pd.Series) -> pd.Series:
        """The latest end of a round that holds each line; the least of them is the round's deadline."""
        ends = (kind == "status") & detail.isin(TERMINAL)
        return at + ends.map({True: min(self.grace_ms, self.timeout_ms), False: self.timeout_ms})

    def _wake(self, at: int) -> None:
        before = self.due.get()[0] if self.due.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        chunks = [pd.DataFrame(dict(zip((*KEY, "detail"), chunk, strict=True))) for chunk in self.lines.get()]
        self.due.clear()
        self.lines.clear()
        held = pd.concat(chunks).groupby(KEY, as_index=False, sort=False)["detail"].min()
        held["bound"] = self._bounds(held["at_ms"], held["kind"], held["detail"])
        past = held["batch_id"].isin(held.loc[held["bound"] <= now, "batch_id"])
        kept, reports = held[~past].values.tolist(), []
        shelves: dict[int, dict[str, list[list]]] = {}
        for row in held[past].values.tolist():
            shelves.setdefault(crc32(row[0].encode()) % SHELVES, {}).setdefault(row[0], []).append(row)
        for shelf, batches in shelves.items():
            stored = self.numbers.getValue((shelf,))
            known = {} if stored is None else {name: (number, set(asked)) for name, number, asked in zip(*stored, strict=True)}
            for name, rows in batches.items():
                left, told, known[name] = self._closed(name, rows, now, *known.get(name, (1, None)))
                kept += left
                reports += told
            self.numbers.updateValue((shelf,), tuple(map(list, zip(*((n, k, sorted(a)) for n, (k, a) in known.items() if k > 1), strict=True))))
        if kept:
            self.lines.appendValue(tuple(list(c) for c in zip(*(r[:5] for r in kept), strict=True)))
            self._wake(min(r[5] for r in kept))
        yield pd.DataFrame(reports, columns=["batch_id", "round", "status", "windows", "done", "retry", "reasons", "closed_ms"]) if reports else pd.DataFrame()

    def _closed(self, name: str, rows: list[list], now: int, number: int, asked: set[str] | None) -> tuple[list[list], list[tuple], tuple]:
        """(lines still open, reports, number and requests of the next round) of one batch; rows (KEY, detail, bound)."""
        reports = []
        while number <= self.rounds and rows and (deadline := min(r[5] for r in rows)) <= now:
            mine = [(r[1], r[2], r[3], r[4]) for r in rows if r[1] <= deadline]
            rows = [r for r in rows if r[1] > deadline]
            state = round_state(mine, asked)
            left = {k: reason for k, reason in sorted(state.items()) if reason is not None}
            told = [d for _, kind, _, d in sorted(mine) if kind == "status" and d in TERMINAL]
            reports.append((name, number, told[0] if told else "timeout", len(state), len(state) - len(left), list(left), list(left.values()), deadline))
            number, asked = (number + 1, set(left)) if left else (self.rounds + 1, set())
        if number > self.rounds:
            rows, asked = [], set()
        return rows, reports, (number, asked)

    def close(self) -> None:
        pass


def round_state(lines: list[tuple[int, str, str, str]], asked: set[str] | None) -> dict[str, str | None]:
    """Each request's reason to be asked again, None if it is done, from a round's lines (at, kind, request, detail).

    Any output settles a request; else its first error is the reason. `asked` are the only requests of a later round.
    """
    out: dict[str, str | None] = {} if asked is None else dict.fromkeys(asked, MISSING)
    for _, kind, custom_id, detail in sorted(lines):
        if kind == "status" or (asked is not None and custom_id not in asked):
            continue
        known = out.get(custom_id, MISSING)
        out[custom_id] = None if kind == "output" or known is None else detail if kind == "error" and known == MISSING else known
    return out


def batch_states(lines: DataFrame, timeout: str = "24 hours", grace: str = "10 minutes", rounds: int = 3, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """A report (see REPORT) for each closed round of the batches in a stream of lines.

    lines: batch_id, at (timestamp), kind (submitted, output, error, status), custom_id, detail (an error's text or a
    status). Lines without batch, time or kind are left out; a null request or detail is an empty string. The session
    must use the RocksDB provider of state.
    """
    span = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    known = lines.where(F.col("batch_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin("submitted", "output", "error", "status"))
    known = known.select(F.col("batch_id").cast("string").alias("batch_id"), "at", F.unix_millis("at").alias("at_ms"), "kind", blank("custom_id"), blank("detail"))
    known = known.withColumn("part", F.pmod(F.xxhash64("batch_id"), F.lit(groups)))
    return known.withWatermark("at", late).groupBy("part").transformWithStateInPandas(BatchRounds(span(timeout), span(grace), rounds), REPORT, "Append", "EventTime")


def replayed(states: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """The reports written under `out` after all that is there has been read; a later call with the same folders goes on."""
    spark = states.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        states.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(REPORT).parquet(out)
