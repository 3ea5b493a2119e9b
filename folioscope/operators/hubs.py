"""The structure and hub graph: where spans stand in their text, and the hubs (entities, span types) they hang on.

Spans are never linked in pairs: two of them meet over a hub, in two hops. A hub may hold any share of all spans, so
its edges lie in blocks of its neighbours; an expansion adds up what reaches a hub first, sends that to each of the
hub's blocks, and adds up by span what comes out of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settled
from .index import top_k

#: Spans a block of a hub holds about.
BLOCK = 10_000
SALTS = 16
#: Characters of a document in which spans are put in order together.
STRETCH = 100_000


def _edge(rows: DataFrame, start: Column, end: Column, kind: str) -> DataFrame:
    return rows.select("document_id", start.alias("from_id"), end.alias("to_id"), F.lit(kind).alias("edge_type"))


def next_spans(spans: DataFrame) -> DataFrame:
    """NEXT_SPAN_IN_TEXT edges: each span to the one that starts next in its document, ties by id.

    Spans are put in order stretch by stretch of the text, so that a long document is many tasks, whatever chapters its
    spans are in; the last span of a stretch goes to the first of the next that has one.
    """
    at, stretch = F.struct("span_start_idx", "span_id"), F.floor(F.col("span_start_idx") / STRETCH).alias("stretch")
    rows = spans.select("document_id", "span_start_idx", "span_id", stretch)
    ends = rows.groupBy("document_id", "stretch").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    after = F.lead("first").over(Window.partitionBy("document_id").orderBy("first"))
    crossing = ends.withColumn("after", after).where(F.col("after").isNotNull())
    inside = F.lead("span_id").over(Window.partitionBy("document_id", "stretch").orderBy("span_start_idx", "span_id"))
    within = rows.select("document_id", "span_id", inside.alias("after")).where(F.col("after").isNotNull())
    return _edge(within, F.col("span_id"), F.col("after"), "NEXT_SPAN_IN_TEXT").unionByName(_edge(crossing, F.col("last.span_id"), F.col("after.span_id"), "NEXT_SPAN_IN_TEXT"))


def structure_edges(spans: DataFrame, windows: DataFrame, chapters: DataFrame) -> DataFrame:
    """(document_id, from_id, to_id, edge_type): spans in chapters and windows, and each of the three to the next in order."""
    of = lambda rows, key, order: rows.withColumn("after", F.lead(key).over(Window.partitionBy("document_id").orderBy(*order))).where(F.col("after").isNotNull())
    return (
        _edge(spans, F.col("span_id"), F.col("chapter_id"), "IN_CHAPTER")
        .unionByName(_edge(spans, F.col("span_id"), F.col("window_id"), "IN_WINDOW"))
        .unionByName(_edge(of(chapters, "chapter_id", ["chapter_index"]), F.col("chapter_id"), F.col("after"), "NEXT_CHAPTER"))
        .unionByName(_edge(of(windows, "window_id", ["chapter_id", "window_index"]), F.col("window_id"), F.col("after"), "NEXT_WINDOW"))
        .unionByName(next_spans(spans))
    )


def hub_edges(spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(document_id, hub_id, edge_type, span_id, block, blocks, degree): every span beside its hubs, a hub's spans in blocks.

    An entity that a span names twice is one edge. Degrees are summed before they meet the edges over SALTS.
    """
    entity = spans.select("document_id", "span_id", F.explode(F.array_distinct("entities")).alias("name")).where(F.col("name").isNotNull())
    entity = entity.select("document_id", "span_id", F.concat(F.lit("entity::"), "name").alias("hub_id"), F.lit("MENTIONS_ENTITY").alias("edge_type"))
    kind = spans.where(F.col("span_type").isNotNull()).select("document_id", "span_id", F.concat(F.lit("type::"), "span_type").alias("hub_id"), F.lit("HAS_SPAN_TYPE").alias("edge_type"))
    each = entity.unionByName(kind)
    keys = ["document_id", "hub_id", "edge_type"]
    degrees = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("degree")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = each.withColumn("salt", F.pmod(F.xxhash64("span_id"), F.lit(SALTS)).cast("int")).join(degrees, [*keys, "salt"]).drop("salt")
    met = met.withColumn("blocks", F.ceil(F.col("degree") / block).cast("int"))
    return met.select(*keys, "span_id", F.pmod(F.xxhash64("span_id", F.lit(1)), "blocks").cast("int").alias("block"), "blocks", "degree")


def hub_degrees(edges: DataFrame) -> DataFrame:
    """(document_id, hub_id, edge_type, degree, blocks) of hub edges."""
    return edges.groupBy("document_id", "hub_id", "edge_type").agg(F.count(F.lit(1)).alias("degree"), F.max("blocks").alias("blocks"))


def expand(seeds: DataFrame, edges: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query_id, document_id, span_id, score, rank): the k spans that seeds (query_id, document_id, span_id, weight) reach best.

    A hub passes on the weight that comes to it, divided by the logarithm of its degree plus one; seeds themselves are
    left out; scores are rounded to `digits`, ties go to the smaller id.

    Spans on the same hubs have the same score: they are one class that is scored once, of which the k smallest ids
    besides seeds are all that can be answers. So a hub costs its classes, not its spans. Seeds are one row a question
    and span.
    """
    by, of, hub = ["query_id", "document_id"], ["document_id", "head"], ["document_id", "hub_id", "edge_type"]
    most = seeds.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    hung = edges.groupBy("document_id", "span_id").agg(F.sort_array(F.collect_list(F.struct("hub_id", "edge_type"))).alias("hubs"))
    heads = hung.groupBy("document_id", "hubs").agg(F.min("span_id").alias("head"), F.count(F.lit(1)).alias("size"))
    heads = settled(heads.select("*", F.xxhash64("hubs").alias("code")), "heads")
    alike = heads.select("document_id", "hubs", "code", "head")
    first = settled(top_k(hung.withColumn("code", F.xxhash64("hubs")), ["document_id", "code", "hubs"], k + most, [F.asc("span_id")], "at").join(alike, ["document_id", "code", "hubs"]).select(*of, "span_id"), "first")

    # the hubs of one span of each class, in blocks of the same size as before
    own = edges.join(heads.select("document_id", F.col("head").alias("span_id")), ["document_id", "span_id"], "left_semi").select(*hub, F.col("span_id").alias("head"), "degree", "blocks")
    held = own.groupBy(*hub).agg(F.ceil(F.count(F.lit(1)) * F.max("blocks") / F.max("degree")).cast("int").alias("parts"))
    own = settled(own.select(*hub, "head").join(held, hub).select(*hub, "head", F.pmod(F.xxhash64("head", F.lit(1)), "parts").cast("int").alias("block")), "classes")
    up = seeds.join(edges.select(*hub, "span_id", "degree"), ["document_id", "span_id"])
    reached = up.groupBy(*by, "hub_id", "edge_type", "degree").agg(F.sum("weight").alias("weight")).join(held, hub)
    passed = reached.withColumn("weight", F.col("weight") / F.log(F.col("degree") + 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    down = passed.select(*by, "hub_id", "edge_type", "block", "weight").join(own, [*hub, "block"])
    sums = down.groupBy(*by, "head").agg(F.round(F.sum("weight"), digits).alias("score"))

    # classes behind k spans of better ones, seeds not counted, cannot hold an answer
    taken = seeds.join(hung, ["document_id", "span_id"]).join(heads.select("document_id", "hubs", "head"), ["document_id", "hubs"]).groupBy(*by, "head").agg(F.count(F.lit(1)).alias("taken"))
    free = sums.join(heads.select(*of, "size"), of).join(taken, [*by, "head"], "left").withColumn("free", F.col("size") - F.coalesce("taken", F.lit(0)))
    better = F.sum("free").over(Window.partitionBy(*by).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("free").over(Window.partitionBy(*by, "score"))
    open_ = free.withColumn("better", better).where(F.col("better") < k).select(*by, "head", "score")
    spans = open_.join(first, of).select(*by, "span_id", "score").join(seeds.select(*by, "span_id"), [*by, "span_id"], "left_anti")
    return top_k(spans, by, k, [F.desc("score"), F.asc("span_id")])
