"""The stream of batch lines, replayed in pieces, out of order, with repeats and a restart, against a plain reading of all lines."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pandas as pd

from folioscope.streaming import batches

LINE = "batch_id string, at timestamp, kind string, custom_id string, detail string"
MINUTE = 60_000
START = datetime(2024, 3, 1, tzinfo=timezone.utc)
TIMEOUT, GRACE, LATE = 300, 20, 60


def lines_of(seed=5, n=1500):
    """(batch_id, minute, kind, custom_id, detail) over 3,000 minutes, in order."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        kind = rnd.choices(["submitted", "output", "error", "status"], [3, 2, 3, 1])[0]
        detail = rnd.choice(["in_progress", "validating", "completed", "failed"]) if kind == "status" else rnd.choice(["rate limited", "too long"]) if kind == "error" else None
        out.append((f"b{rnd.randint(0, 11)}", k * 2 + rnd.randint(0, 1), kind, None if kind == "status" else f"w{rnd.randint(0, 6)}", detail))
    return out


def plain(lines, rounds):
    """Reports by reading each batch's lines in order."""
    reports = []
    for batch in sorted({x[0] for x in lines}):
        held = {}
        for _, at, kind, custom_id, detail in (x for x in lines if x[0] == batch):
            key = (at, kind, custom_id or "")
            held[key] = min(held.get(key, detail or ""), detail or "")
        rest, asked = sorted((*k, d) for k, d in held.items()), None
        for number in range(1, rounds + 1):
            if not rest:
                break
            ends = [x[0] for x in rest if x[1] == "status" and x[3] in ("completed", "failed")]
            deadline = min([rest[0][0] + TIMEOUT] + [e + GRACE for e in ends[:1]])
            mine = [x for x in rest if x[0] <= deadline]
            rest = [x for x in rest if x[0] > deadline]
            done, wrong = {x[2] for x in mine if x[1] == "output"}, {}
            for x in mine:
                if x[1] == "error":
                    wrong.setdefault(x[2], x[3])
            every = asked if asked is not None else {x[2] for x in mine if x[1] != "status"}
            left = {w: wrong.get(w, batches.MISSING) for w in sorted(every - done)}
            told = [x[3] for x in mine if x[1] == "status" and x[3] in ("completed", "failed")]
            reports.append((batch, number, told[0] if told else "timeout", len(every), len(every & done), tuple(left), tuple(left.values())))
            if not left:
                break
            asked = set(left)
    return reports


def write(folder, number, rows):
    path = os.path.join(folder, f"{number:03d}.json")
    with open(path, "w") as f:
        for batch, minute, kind, custom_id, detail in rows:
            f.write(json.dumps({"batch_id": batch, "at": (START + timedelta(minutes=minute)).isoformat(), "kind": kind, "custom_id": custom_id, "detail": detail}) + "\n")
    os.utime(path, (1_700_000_000 + number, 1_700_000_000 + number))


def replay(spark, folder, out, checkpoint, rounds):
    stream = spark.readStream.schema(LINE).option("maxFilesPerTrigger", 1).json(str(folder))
    states = batches.batch_states(stream, f"{TIMEOUT} minutes", f"{GRACE} minutes", rounds, f"{LATE} minutes")
    rows = batches.replayed(states, str(out), str(checkpoint)).where("batch_id <> 'end'").collect()
    return sorted((r["batch_id"], r["round"], r["status"], r["windows"], r["done"], tuple(r["retry"]), tuple(r["reasons"])) for r in rows)


def test_a_replay_with_disorder_repeats_and_a_restart(spark, tmp_path):
    lines, rnd = lines_of(), random.Random(9)
    folder = tmp_path / "lines"
    folder.mkdir()
    # every line comes up to 50 minutes late, a quarter of them twice; lines that tell nothing are mixed in
    arrivals = [(x[1] + rnd.randint(0, 50), x) for x in lines] + [(x[1] + rnd.randint(0, 50), x) for x in lines if rnd.random() < 0.25]
    arrivals += [(k * 300, ("b1", k * 300, "gossip", "w1", "x")) for k in range(10)]
    arrivals.sort(key=lambda x: x[0])
    files = [[x for t, x in arrivals if k * 400 <= t < (k + 1) * 400] for k in range(8)]
    for k, rows in enumerate(files[:2]):
        write(folder, k, rows)
    first = replay(spark, folder, tmp_path / "out", tmp_path / "state", 3)
    want = sorted(plain(lines, 3))
    assert 0 < len(first) < len(want) and set(first) <= set(want)
    for k, rows in enumerate(files[2:], 2):
        write(folder, k, rows)
    for k in range(4):
        write(folder, 8 + k, [("end", 100_000 + k * 10_000, "submitted", "w", None)])
    got = replay(spark, folder, tmp_path / "out", tmp_path / "state", 3)
    assert got == want
    assert {x[1] for x in got} == {1, 2, 3} and {"timeout", "completed", "failed"} == {x[2] for x in got}
    assert replay(spark, folder, tmp_path / "out", tmp_path / "state", 3) == want  # nothing new, nothing twice


def test_round_state_of_repeated_and_foreign_lines():
    lines = [(3, "error", "a", "late error"), (1, "error", "a", "first"), (2, "output", "b", ""), (4, "error", "b", "after"), (1, "submitted", "c", ""), (1, "status", "", "completed")]
    assert batches.round_state(lines, None) == {"a": "first", "b": None, "c": batches.MISSING}
    assert batches.round_state(lines, {"b", "d"}) == {"b": None, "d": batches.MISSING}
    assert batches.round_state([], None) == {}


class Counted:
    """A store in memory that counts its calls, and the handle that gives it."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, {}, set()

    def state(self, name, *_):
        held, outer = self.kept.setdefault(name, {}), self

        class State:
            def __getattr__(self, call):
                outer.calls += 1
                return {
                    "exists": lambda: bool(held), "get": lambda: held[0] if name == "due" else list(held.values()), "update": lambda v: held.update({0: v}), "clear": held.clear,
                    "appendValue": lambda v: held.update({len(held): v}), "getValue": held.get, "updateValue": lambda k, v: held.update({k: v}),
                }[call]

        return State()

    getValueState = getListState = getMapState = state  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_lines_of_many_batches_share_calls_to_the_store():
    lines = [(f"b{k % 400}", k * 1000, *x) for k, x in enumerate([("submitted", "a", ""), ("output", "a", ""), ("error", "b", "late")] * 400)]
    store, told = Counted(), []
    rounds = batches.BatchRounds(TIMEOUT * MINUTE, GRACE * MINUTE, 2)
    rounds.init(store)
    list(rounds.handleInputRows((0,), iter([pd.DataFrame(lines, columns=["batch_id", "at_ms", "kind", "custom_id", "detail"])]), None))
    for _ in range(3):
        now = max(store.timers, default=0) + TIMEOUT * MINUTE * 2
        for at in list(store.timers):
            store.timers.discard(at)
            timer, watermark = (type("T", (), {f"get{n}": lambda self, t=t: t})() for n, t in (("ExpiryTimeInMs", at), ("CurrentWatermarkInMs", now)))
            told += [r for pdf in rounds.handleExpiredTimer((0,), watermark, timer) for r in pdf.to_dict("records")]
    want = plain([(b, at // MINUTE, k, c, d) for b, at, k, c, d in lines], 1)
    assert len(told) == len(want) == 400 and sum(r["done"] for r in told) == sum(x[4] for x in want)
    assert store.calls < 60  # one call and more a line before
