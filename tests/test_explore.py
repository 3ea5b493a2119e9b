"""Walks against a plain walker that keeps every open span; budgets, searches inside the walk, hot hubs, traces."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.operators import explore

SPANS = "document_id string, span_id string, chapter_id string, span_start_idx int, summary string, entities array<string>, key_quote string, span_type string, salience_score double"
ASKED = "query_id string, document_id string, question string, budget int, vector array<double>"


def made(seed=3, n=160):
    """Two documents; a hub of every third span, entities of two words, words that are in texts only."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        d = f"d{k % 2}"
        names = [f"hall {rnd.randint(0, 5)}"] * (rnd.random() < 0.4) + [f"king{rnd.randint(0, 9)}"] * (rnd.random() < 0.5) + ["common"] * (k % 3 == 0)
        text = " ".join(rnd.choice(["river", "stone", "night", "song", "ash"]) for _ in range(rnd.randint(0, 5))) + (" rareword" if k in (40, 41) else "")
        rows.append((d, f"s{k:03d}", f"{d}_c{k // 50}", k * 3, text, names or None, None, rnd.choice(["mixed", "other", None]), rnd.choice([None, 0.25, 0.5, rnd.random()])))
    asked = [("q0", "d0", "Common KING3 hall 2", 9, None), ("q1", "d1", "rareword king1", 7, None), ("q2", "d0", "nothing known", 6, [1.0, 0.5]), ("q3", "d1", "common song night river", 3, None),
             ("q4", "d0", None, 5, None), ("q5", "d1", "rareword", 0, None), ("q6", "dx", "common", 4, [1.0, 0.0]), ("q7", "d0", "absent king0 common", 12, [0.2, 1.0]),
             ("q9", "d1", "nothing", 12, [0.3, -1.0])]
    vectors = [(r[0], r[1], [math.cos(k), math.sin(k)]) for k, r in enumerate(rows) if k % 5]
    return rows, asked, vectors


words = lambda text: [w.lower() for w in re.findall("[A-Za-z0-9_]+", text or "")]


def plain_walk(rows, asked, vectors, s):
    visits, ends = {}, {}
    for query, d, question, budget, vector in asked:
        own = {r[1]: r for r in rows if r[0] == d}
        text = {i: words(" ".join([r[4] or "", " ".join(r[5] or []), r[6] or ""])) for i, r in own.items()}
        sal = {i: (1 + round(r[8] or 0.0, 6)) / 2 for i, r in own.items()}
        hubs = defaultdict(set)
        for i, r in own.items():
            for e in r[5] or []:
                hubs["entity::" + e].add(i)
            if r[7]:
                hubs["type::" + r[7]].add(i)
        order = [i for _, i in sorted((r[3], i) for i, r in own.items())]
        beside = defaultdict(list)
        for a, b in zip(order, order[1:]):
            beside[a].append(b)
            beside[b].append(a)
        df = Counter(w for t in text.values() for w in set(t))
        n, mean_len = len(own), sum(map(len, text.values())) / max(1, len(own))
        raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
        idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
        asks = list(dict.fromkeys(words(question)))
        findable = {w for w in asks if w in df}
        seen, covered, reason = [], set(), "budget" if budget < 1 else None

        def keyword(left):
            scores = {}
            for i, t in text.items():
                part = [idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean_len)) for w in left if w in t]
                if part and i not in seen:
                    scores[i] = round(sum(part), 6)
            best = sorted(scores, key=lambda i: (-scores[i], i))[: s.found]
            return {i: round(1 / math.log2(k + 2), 9) for k, i in enumerate(best)}

        def near():
            cos = lambda v: round(sum(a * b for a, b in zip(v, vector)) / math.hypot(*v) / math.hypot(*vector), 9)
            best = sorted(((-cos(v), i) for e, i, v in vectors if e == d and i not in seen))[: s.found] if vector else []
            return {i: round(1 / math.log2(k + 2), 9) for k, (_, i) in enumerate(best)}

        opened = {}

        def put(found):
            for i, x in found.items():
                if i not in seen:
                    opened[i] = max(x, opened.get(i, -1))

        def refill():
            if len(opened) < min(s.width, budget - len(seen)):
                a, b = keyword([w for w in asks if w in findable - covered]), near()
                put(a)
                put(b)

        def hub(h, weight):
            w = round(weight / math.log2(len(hubs[h]) + 1), 9)
            put({i: w * sal[i] for i in hubs[h]})

        if reason is None:
            named = [h for h in hubs if h.startswith("entity::") and set(words(h[8:])) <= set(asks)]
            for h in named:
                hub(h, 1.0)
            known = {w for h in named for w in words(h[8:])}
            put(keyword([w for w in asks if w not in known]))
            refill()
        for step in range(1, s.rounds + 1):
            if reason:
                break
            now = sorted(opened, key=lambda i: (-opened[i], i))[: min(s.width, budget - len(seen))]
            for i in now:
                visits[query, i] = (step, len(seen) + 1, round(opened[i], 8))
                seen.append(i)
                covered |= findable & set(text[i])
            scores = {i: opened.pop(i) for i in now}
            if not now:
                reason = "exhausted"
            elif findable and len(covered) >= s.goal * len(findable):
                reason = "covered"
            elif len(seen) >= budget:
                reason = "budget"
            elif step == s.rounds:
                reason = "rounds"
            else:
                for i in now:
                    for h in [h for h in hubs if i in hubs[h]]:
                        hub(h, scores[i] * s.decay)
                    put({j: round(scores[i] * s.near, 9) for j in beside[i]})
                refill()
        ends[query] = (reason, len(seen), sorted(covered))
    return visits, ends


@pytest.fixture(scope="module")
def walked(spark):
    rows, asked, vectors = made()
    spans = spark.createDataFrame(rows, SPANS).withColumn("rank", F.lit("clash"))
    graph = explore.graph(spans, 12, block=8)
    s = explore.Settings(width=3, rounds=3, found=2)
    questions = spark.createDataFrame([*asked, asked[0], ("q8", None, "common", 4, None)], ASKED).withColumn("words", F.lit("clash"))
    return explore.explore(questions, graph, s, spark.createDataFrame(vectors, "document_id string, span_id string, vector array<double>")), s, graph


def test_walks_equal_a_walker_that_cuts_nothing(walked):
    walk, s, _ = walked
    visits, ends = plain_walk(*made(), s)
    got = {(r["query_id"], r["span_id"]): (r["round"], r["place"], round(r["score"], 8)) for r in walk.visits.collect()}
    told = {r["query_id"]: (r["reason"], r["visited"], sorted(r["covered"])) for r in walk.questions.collect()}
    assert got == visits
    assert told == ends
    assert {x[0] for x in told.values()} >= {"covered", "budget", "exhausted", "rounds"}


def test_budgets_hold_and_no_span_is_visited_twice(walked):
    walk, _, _ = walked
    budgets = {q: b for q, _, _, b, _ in made()[1]}
    rows = walk.visits.collect()
    assert len({(r["query_id"], r["span_id"]) for r in rows}) == len(rows)
    for q, n in Counter(r["query_id"] for r in rows).items():
        assert n <= budgets[q]
        assert sorted(r["place"] for r in rows if r["query_id"] == q) == list(range(1, n + 1))


def test_a_hub_of_a_third_of_all_spans_sends_on_no_more_than_the_budget(walked):
    _, _, graph = walked
    common = graph.heads.where("hub_id = 'entity::common'").collect()
    assert all(r["degree"] > 20 and len(r["first"]) == 12 for r in common) and len(common) == 2


def test_searches_are_called_from_inside(walked):
    walk, _, _ = walked
    rows = {(r["query_id"], r["span_id"]) for r in walk.visits.collect()}
    assert ("q1", "s041") in rows  # a word that names no hub
    assert any(q == "q2" for q, _ in rows)  # nothing but a vector leads anywhere


def test_a_trace_is_written_once(walked):
    walk, _, _ = walked
    nodes, edges = explore.trace(walk)
    again = explore.trace(walk)
    assert nodes.exceptAll(again[0]).isEmpty() and edges.exceptAll(again[1]).isEmpty()
    kinds = {r["edge_type"]: r["count"] for r in edges.groupBy("edge_type").count().collect()}
    assert kinds["SUPPORTED_BY"] == kinds["CITES"] == walk.visits.count() and kinds["ANSWERS"] == 9
    assert nodes.select("node_id").distinct().count() == nodes.count() == 18


def test_empty_tables_and_too_large_budgets(spark):
    rows, asked, _ = made()
    none = explore.graph(spark.createDataFrame([], SPANS), 4)
    got = explore.explore(spark.createDataFrame(asked[:1], ASKED).withColumn("budget", F.lit(4)), none)
    assert got.visits.count() == 0 and [r["reason"] for r in got.questions.collect()] == ["exhausted"]
    assert explore.explore(spark.createDataFrame([], ASKED), none).visits.count() == 0
    with pytest.raises(Exception, match="a budget above 4"):
        explore.explore(spark.createDataFrame(asked[:1], ASKED), none)
