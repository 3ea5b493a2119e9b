"""The explorer: a best-first walk over the hub graph for all questions at once, with searches called from inside it.

A walk begins at the hubs that a question names; words that name no hub go to the keyword search. Each round visits
the best open spans of every question, up to a width and what is left of its budget, and opens what they lead to:
over their hubs, and to the span before and after. A question whose open spans run short asks the keyword search for
the words it has not covered yet, and the vector search if it has a vector. A question stops when the spans it has
visited hold all its words that its document holds, when its budget is spent, when nothing is left to open, or after
the last round.

A span's score is the best of what reaches it, not the sum. So a question with n visits left can never come to an
open span that stands behind n others, and of a hub's spans, in the order of their salience, never past as many as its
whole budget: both lists are cut there without a change of the walk, and a hub that holds a third of all spans sends
on no more rows than any other. Every round's tables are stored, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import settled
from . import hubs, index
from .index import top_k

Q = ["query_id", "document_id"]


@dataclass(frozen=True)
class Settings:
    """`width` visits a round; `decay` for a step over a hub, `near` for one to a neighbour; `goal` share of words that
    is enough; `found` hits that a search brings in; `rounds` at most."""

    width: int = 4
    rounds: int = 4
    decay: float = 0.5
    near: float = 0.5
    goal: float = 1.0
    found: int = 4


@dataclass
class Graph:
    """Stored tables of a walk: spans with words, their hubs, the heads of hubs, neighbours, postings, word weights."""

    spans: DataFrame
    edges: DataFrame
    heads: DataFrame
    beside: DataFrame
    postings: DataFrame
    weights: DataFrame
    most: int


@dataclass
class Walk:
    """visits (query_id, document_id, span_id, score, round, place) and questions (with tokens, covered, visited, reason)."""

    visits: DataFrame
    questions: DataFrame


def graph(spans: DataFrame, most: int, block: int = hubs.BLOCK) -> Graph:
    """The tables of walks with budgets up to `most`. Spans with a null id are left out, a null salience is 0."""
    spans = spans.where(F.col("span_id").isNotNull() & F.col("document_id").isNotNull())
    text = index.bm25_text(F.col("summary"), F.col("entities"), F.col("key_quote"))
    words = F.coalesce(F.array_distinct(tokens(text)), F.array().cast("array<string>"))
    salience = F.round(F.coalesce(F.col("salience_score").cast("double"), F.lit(0.0)), 6).alias("salience")
    held = settled(spans.select("document_id", "span_id", words.alias("words"), salience), "spans")
    edges = settled(hubs.hub_edges(spans, block).select("document_id", "hub_id", "span_id", "block", "degree"), "hubs")
    best = [F.desc("salience"), F.asc("span_id")]
    ranked = edges.join(held.select("document_id", "span_id", "salience"), ["document_id", "span_id"])
    ranked = top_k(top_k(ranked, ["document_id", "hub_id", "block"], most, best), ["document_id", "hub_id"], most, best)
    heads = settled(ranked.groupBy("document_id", "hub_id", "degree").agg(F.collect_list(F.struct("span_id", "salience")).alias("first")), "heads")
    after = hubs.next_spans(spans).select("document_id", "from_id", "to_id")
    beside = after.unionByName(after.select("document_id", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))
    posted = settled(index.postings(spans, "span_id", text, ["document_id"]), "postings")
    weights = settled(index.token_weights(posted, spans, ["document_id"], "span_id"), "weights")
    return Graph(held, edges, heads, settled(beside, "beside"), posted, weights, most)


def _discounted(weight: Column, count: Column) -> Column:
    return F.round(weight / F.log2(count + 1), 9)


def _down(reached: DataFrame, heads: DataFrame) -> DataFrame:
    """Weights that stand at hubs (Q, hub_id, weight), passed to the hubs' first spans by salience."""
    met = reached.join(heads.select("document_id", "hub_id", "first"), ["document_id", "hub_id"])
    each = met.select(*Q, "weight", F.explode("first").alias("s"))
    return each.select(*Q, "s.span_id", (F.col("weight") * (1 + F.col("s.salience")) / 2).alias("score"))


def named_hubs(questions: DataFrame, heads: DataFrame) -> DataFrame:
    """(Q, hub_id, degree, name): entity hubs all of whose words stand in the question's `words`."""
    name = tokens(F.substring(F.col("hub_id"), len("entity::") + 1, 1 << 20))
    entities = heads.where(F.col("hub_id").startswith("entity::")).select("document_id", "hub_id", "degree", name.alias("name")).where(F.size("name") > 0)
    asked = questions.select(*Q, "words", F.explode("words").alias("first_word"))
    met = asked.join(entities.withColumn("first_word", F.col("name")[0]), ["document_id", "first_word"])
    return met.where(F.size(F.array_except("name", "words")) == 0).select(*Q, "hub_id", "degree", "name")


def keyword_search(asked: DataFrame, graph_: Graph, visits: DataFrame | None, k: int) -> DataFrame:
    """(Q, span_id, score): the k best texts not visited yet for asked (Q, left: words); the score tells the place."""
    questions = asked.where(F.size("left") > 0).select(*Q, F.array_join("left", " ").alias("question"))
    scores = index.bm25_scores(questions, graph_.postings, graph_.weights, ["document_id"], "span_id")
    return _placed(scores, visits, k, [F.round("score", 6).desc(), F.asc("span_id")])


def vector_search(asked: DataFrame, vectors: DataFrame, graph_: Graph, visits: DataFrame | None, k: int) -> DataFrame:
    """(Q, span_id, score): the k nearest spans not visited yet for asked (Q, vector); visits are fewer than `most`."""
    wanted = asked.where(F.col("vector").isNotNull()).select(*Q, "vector")
    near = index.nearest(wanted, vectors.where(F.col("vector").isNotNull()), ["document_id"], "query_id", "span_id", k + graph_.most)
    return _placed(near, visits, k, [F.desc("score"), F.asc("span_id")])


def _placed(scores: DataFrame, visits: DataFrame | None, k: int, order: list[Column]) -> DataFrame:
    new = scores if visits is None else scores.join(visits.select(*Q, "span_id"), [*Q, "span_id"], "left_anti")
    best = top_k(new, Q, k, order)
    return best.select(*Q, "span_id", _discounted(F.lit(1.0), F.col("rank")).alias("score"))


def _opened(rows: DataFrame, state: DataFrame, visits: DataFrame | None) -> DataFrame:
    """Of rows (Q, span_id, score) the spans that questions in `state` may still come to, each with its best score."""
    best = rows.groupBy(*Q, "span_id").agg(F.max("score").alias("score"))
    if visits is not None:
        best = best.join(visits.select(*Q, "span_id"), [*Q, "span_id"], "left_anti")
    going = state.where(F.col("reason").isNull()).select(*Q, (F.col("budget") - F.col("visited")).alias("remaining"))
    ranked = top_k(best.join(going, Q), Q, 1 << 30, [F.desc("score"), F.asc("span_id")])
    return ranked.where(F.col("rank") <= F.col("remaining")).select(*Q, "span_id", "score")


def explore(questions: DataFrame, graph_: Graph, settings: Settings = Settings(), vectors: DataFrame | None = None) -> Walk:
    """Walks of questions (query_id, document_id, question, budget, and `vector` if vectors are given).

    Rows of one query and document are one question, the first by its text; a null text has no words, a null budget
    is none, and a budget above the graph's `most` is an error. A question whose words its document does not hold
    never counts as covered. With no question or no span there is no visit. Ties go to the smaller span id.
    """
    s = settings
    both = [F.coalesce("budget", F.lit(0)).alias("budget"), F.coalesce("question", F.lit("")).alias("question")]
    vector = [F.col("vector")] if vectors is not None else []
    one = questions.where(F.col("query_id").isNotNull() & F.col("document_id").isNotNull()).select(*Q, *both, *vector)
    told = F.raise_error(F.concat(F.lit(f"a budget above {graph_.most}: "), F.col("r.budget").cast("string"))).cast("int")
    rows = one.groupBy(*Q).agg(F.min_by(F.struct(*(c for c in one.columns if c not in Q)), F.struct("question", "budget")).alias("r"))
    rows = rows.select(*Q, F.when(F.col("r.budget") > graph_.most, told).otherwise(F.greatest(F.col("r.budget"), F.lit(0)).cast("int")).alias("budget"), F.coalesce(F.array_distinct(tokens(F.col("r.question"))), F.array().cast("array<string>")).alias("words"), *([F.col("r.vector").alias("vector")] if vector else []))
    asked = settled(rows, "asked")
    held = asked.select(*Q, F.explode("words").alias("token")).join(graph_.weights.select("document_id", "token"), ["document_id", "token"])
    held = held.groupBy(*Q).agg(F.collect_list("token").alias("tokens"))
    none = F.array().cast("array<string>")
    state = asked.select(*Q, "budget").join(held, Q, "left").select(*Q, "budget", F.coalesce("tokens", none).alias("tokens"), none.alias("covered"), F.lit(0).alias("visited"), F.when(F.col("budget") < 1, "budget").alias("reason"))
    state = settled(state, "state")

    named = settled(named_hubs(asked, graph_.heads), "named")
    start = _down(named.select(*Q, "hub_id", _discounted(F.lit(1.0), F.col("degree")).alias("weight")), graph_.heads)
    known = named.groupBy(*Q).agg(F.flatten(F.collect_set("name")).alias("known"))
    left = asked.join(known, Q, "left").select(*Q, F.array_except("words", F.coalesce("known", none)).alias("left"))
    opened = settled(_opened(start.unionByName(keyword_search(left, graph_, None, s.found)), state, None), "open")
    opened = _refilled(opened, state, asked, graph_, None, s, vectors)

    rounds: list[DataFrame] = []
    for step in range(1, s.rounds + 1):
        going = state.where(F.col("reason").isNull())
        if going.isEmpty():
            break
        ranked = top_k(opened.join(going.select(*Q, "visited", "budget", "tokens"), Q), Q, s.width, [F.desc("score"), F.asc("span_id")])
        now = ranked.where(F.col("rank") <= F.col("budget") - F.col("visited"))
        now = now.select(*Q, "span_id", "score", F.lit(step).alias("round"), (F.col("visited") + F.col("rank")).cast("int").alias("place"), "tokens")
        now = settled(now, "visits")
        rounds.append(now.drop("tokens"))
        visits = functools.reduce(DataFrame.unionByName, rounds)

        gained = now.join(graph_.spans.select("document_id", "span_id", "words"), ["document_id", "span_id"]).groupBy(*Q)
        gained = gained.agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_distinct(F.flatten(F.collect_list(F.array_intersect("tokens", "words")))).alias("new"))
        met = state.join(gained, Q, "left").withColumns({"covered": F.array_union("covered", F.coalesce("new", none)), "visited": F.col("visited") + F.coalesce("n", F.lit(0))})
        enough = (F.size("tokens") > 0) & (F.size("covered") >= s.goal * F.size("tokens"))
        ended = F.when(F.col("n").isNull(), "exhausted").when(enough, "covered").when(F.col("visited") >= F.col("budget"), "budget").when(F.lit(step == s.rounds), "rounds")
        state = settled(met.withColumn("reason", F.coalesce("reason", ended)).drop("n", "new"), "state")
        if step == s.rounds:
            break

        going = state.where(F.col("reason").isNull()).select(*Q)
        walked = now.join(going, Q)
        reached = walked.join(graph_.edges.select("document_id", "span_id", "hub_id", "degree"), ["document_id", "span_id"]).groupBy(*Q, "hub_id", "degree").agg(F.max("score").alias("score"))
        over = _down(reached.select(*Q, "hub_id", _discounted(F.col("score") * s.decay, F.col("degree")).alias("weight")), graph_.heads)
        along = walked.select(*Q, F.col("span_id").alias("from_id"), "score").join(graph_.beside, ["document_id", "from_id"]).select(*Q, F.col("to_id").alias("span_id"), F.round(F.col("score") * s.near, 9).alias("score"))
        opened = settled(_opened(opened.unionByName(over).unionByName(along), state, visits), "open")
        opened = _refilled(opened, state, asked, graph_, visits, s, vectors)
    if not rounds:
        rounds = [opened.select(*Q, "span_id", "score", F.lit(0).alias("round"), F.lit(0).alias("place")).limit(0)]
    return Walk(functools.reduce(DataFrame.unionByName, rounds), state)


def _refilled(opened: DataFrame, state: DataFrame, asked: DataFrame, graph_: Graph, visits: DataFrame | None, s: Settings, vectors: DataFrame | None) -> DataFrame:
    """opened, with the searches' hits for questions that have fewer open spans than the next round could visit."""
    going = state.where(F.col("reason").isNull())
    counts = opened.groupBy(*Q).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.least(F.lit(s.width), F.col("budget") - F.col("visited"))
    short = going.join(counts, Q, "left").where(F.coalesce("n", F.lit(0)) < wanted).select(*Q, F.array_except("tokens", "covered").alias("left"))
    short = settled(short, "short")
    if short.isEmpty():
        return opened
    hits = keyword_search(short, graph_, visits, s.found)
    if vectors is not None:
        hits = hits.unionByName(vector_search(short.join(asked.select(*Q, "vector"), Q), vectors, graph_, visits, s.found))
    return settled(_opened(opened.unionByName(hits), state, visits), "open")


def trace(walk: Walk, cited: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What a walk leaves behind in the graph: nodes (document_id, node_id, node_type, payload) and edges (document_id,
    from_id, to_id, edge_type, weight).

    A question SUPPORTED_BY the spans it visited; its answer ANSWERS it and CITES the spans of `cited` (Q, span_id),
    or without it the spans visited. Ids depend on document and question only, so writing a walk twice changes nothing.
    """
    own = lambda kind: F.concat(F.lit(f"{kind}::"), F.substring(F.sha2(F.concat_ws("\u0001", F.col("document_id"), F.col("query_id").cast("string")), 256), 1, 16))
    asked = walk.questions.select(*Q, own("question").alias("question_node"), own("answer").alias("answer_node"), F.to_json(F.struct("tokens", "covered", "visited", "reason")).alias("payload"))
    node = lambda column, kind: asked.select("document_id", F.col(column).alias("node_id"), F.lit(kind).alias("node_type"), "payload")
    ids = asked.drop("payload")
    edge = lambda rows, start, end, kind, weight: rows.select("document_id", F.col(start).alias("from_id"), F.col(end).alias("to_id"), F.lit(kind).alias("edge_type"), weight.alias("weight"))
    visited = walk.visits.join(ids, Q)
    quoted = visited if cited is None else cited.select(*Q, "span_id").distinct().join(ids, Q)
    edges = (
        edge(visited, "question_node", "span_id", "SUPPORTED_BY", F.col("score"))
        .unionByName(edge(ids, "answer_node", "question_node", "ANSWERS", F.lit(1.0)))
        .unionByName(edge(quoted, "answer_node", "span_id", "CITES", F.lit(1.0)))
    )
    return node("question_node", "Question").unionByName(node("answer_node", "Answer")), edges
