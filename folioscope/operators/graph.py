"""Center spans, their members, and the property graph around them: all documents in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import chapter_number, contains_any, distinct_tokens, uuid5_hex
from .index import cosine, nearest_others, top_k


def cluster_type(span_type: Column, summary: Column, entities: Column) -> Column:
    kind, words = F.lower(span_type), F.concat_ws(" ", summary, F.array_join(entities, " "))
    out = F.when(contains_any(words, fixed.CLUSTER_WORDS["location"]), "location")
    for name in ("faction", "power_system", "mystery"):
        out = out.when(contains_any(words, fixed.CLUSTER_WORDS[name]), name)
    out = out.when(kind == "interaction", "character").when(kind.isin("progression", "transition") | contains_any(words, fixed.HISTORY_WORDS), "history")
    return out.when((kind == "reflection") & (F.size(entities) > 0), "character").otherwise("history")


def type_bonus(span_type: Column, of_cluster: Column) -> Column:
    out = F.lit(0.0)
    for name, kinds in fixed.CENTER_SPAN_TYPES.items():
        out = F.when((of_cluster == name) & F.lower(span_type).isin(*kinds), 1.0).otherwise(out)
    return out


def normalized_weights(weights: dict[str, float] | None = None, use_vectors: bool = True) -> dict[str, float]:
    """Weights of a member's component scores that sum to 1; without vectors theirs is 0; the defaults if none is left."""
    given = fixed.GRAPH_WEIGHTS | {k: float(v) for k, v in (weights or {}).items()}
    if set(given) != set(fixed.GRAPH_WEIGHTS):
        raise ValueError(f"unknown weights: {sorted(set(given) - set(fixed.GRAPH_WEIGHTS))}")
    total = sum(given.values())
    given = {k: v / total for k, v in given.items()} if total > 0 else dict(fixed.GRAPH_WEIGHTS)
    if not use_vectors:
        given["vector"] = 0.0
        total = sum(given.values())
        given = {k: v / total for k, v in given.items()} if total > 0 else dict(fixed.GRAPH_WEIGHTS)
    return given


def vector_coverage(spans: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """(document_id, source, requested, loaded, coverage): how many of a document's spans have a vector."""
    if vectors is None:
        none = spans.groupBy("document_id").agg(F.count(F.lit(1)).alias("requested"))
        return none.select("document_id", F.lit("disabled").alias("source"), "requested", F.lit(0).cast("long").alias("loaded"), F.lit(0.0).alias("coverage"))
    held = spans.select("document_id", "span_id").join(vectors.select("span_id", F.lit(1).alias("there")).dropDuplicates(["span_id"]), "span_id", "left")
    sums = held.groupBy("document_id").agg(F.count(F.lit(1)).alias("requested"), F.count("there").alias("loaded"))
    return sums.select("document_id", F.lit("vectors").alias("source"), "requested", "loaded", F.round(F.col("loaded") / F.col("requested"), 6).alias("coverage"))


def entity_counts(spans: DataFrame) -> DataFrame:
    """(document_id, entity, n): in how many spans of a document each entity stands."""
    return spans.select("document_id", F.explode(F.array_distinct("entities")).alias("entity")).groupBy("document_id", "entity").agg(F.count(F.lit(1)).alias("n"))


def type_order(spans: DataFrame) -> DataFrame:
    """(document_id, cluster_type, size, top_salience, type_rank): a document's types, larger and more salient first."""
    sizes = spans.groupBy("document_id", "cluster_type").agg(F.count(F.lit(1)).alias("size"), F.max("salience_score").alias("top_salience"), F.min("ord").alias("first_ord"))
    order = Window.partitionBy("document_id").orderBy(F.desc("size"), F.desc("top_salience"), "first_ord")
    return sizes.withColumn("type_rank", F.row_number().over(order)).drop("first_ord")


def with_vectors(spans: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """spans with `vector`: that of `vectors` by id, else the one they hold, else null."""
    if vectors is not None:
        return spans.drop("vector").join(vectors.select("span_id", "vector"), "span_id", "left")
    return spans if "vector" in spans.columns else spans.withColumn("vector", F.lit(None).cast("array<double>"))


def medoid_scores(spans: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(span_id, medoid): 0.7 of the mean of a span's 8 best cosines to others of its type, 0.3 of its salience.

    Pairs stand inside one document and type only and are scored as matrix products, 8 kept a block; the work is
    still quadratic in such a group.
    """
    rows = with_vectors(spans, vectors).where(F.col("vector").isNotNull()).select("document_id", "cluster_type", "span_id", "salience_score", "vector")
    near = nearest_others(rows.drop("salience_score"), ["document_id", "cluster_type"], "of", "span_id", 8)
    best = top_k(near, ["of"], 8, [F.desc("score"), F.asc("span_id")]).groupBy(F.col("of").alias("span_id")).agg(F.avg("score").alias("mean"))
    score = F.when(F.col("mean").isNull(), 0.3 * F.col("salience_score")).otherwise(0.7 * F.greatest(F.lit(0.0), F.col("mean")) + 0.3 * F.col("salience_score"))
    return rows.join(best, "span_id", "left").select("span_id", score.alias("medoid"))


def centers(spans: DataFrame, vectors: DataFrame | None = None, clusters: int = 4) -> DataFrame:
    """(document_id, cluster_type, type_rank, center columns): the center of each of a document's leading types.

    Spans that hold their `vector` need no table of vectors, here and below.
    """
    types = type_order(spans).where(F.col("type_rank") <= clusters).select("document_id", "cluster_type", "type_rank")
    rows = spans.join(types, ["document_id", "cluster_type"])
    if vectors is not None or "vector" in spans.columns:
        rows = rows.join(medoid_scores(spans, vectors), "span_id", "left")
    else:
        rows = rows.withColumn("medoid", F.lit(None).cast("double"))
    order = Window.partitionBy("document_id", "cluster_type").orderBy(F.col("medoid").isNotNull().desc(), type_bonus(F.col("span_type"), F.col("cluster_type")).desc(), F.desc("medoid"), F.desc("salience_score"), F.size("entities").desc(), F.coalesce("span_start_idx", F.lit(0)), "ord")
    first = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select("document_id", "cluster_type", "type_rank", *(F.col(c).alias(f"center_{c}") for c in ("span_id", "summary", "entities", "chapter_id")))


def proximity(gap: Column) -> Column:
    return F.when(gap == 0, 1.0).when(gap == 1, 0.6).when(gap == 2, 0.35).otherwise(0.2 / gap)


def member_scores(centers_: DataFrame, spans: DataFrame, vectors: DataFrame | None = None, weights: dict[str, float] = fixed.GRAPH_WEIGHTS) -> DataFrame:
    """Every span of a document scored as a member of each of its clusters, with its component scores.

    Spans meet the centers of their document; a center's vector comes from the span that it is, among those met, and
    vectors go no further.
    """
    counts = entity_counts(spans)
    totals = counts.groupBy("document_id").agg(F.sum("n").alias("mentions"), F.min("n").alias("rarest"))
    if vectors is not None:
        totals = totals.join(spans.join(vectors.select("span_id"), "span_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_vectors")), "document_id", "left")
    elif "vector" in spans.columns:
        totals = totals.join(spans.groupBy("document_id").agg(F.count("vector").alias("n_vectors")), "document_id", "left")
    else:
        totals = totals.withColumn("n_vectors", F.lit(0).cast("long"))
    total = F.greatest(F.lit(1), F.when(F.coalesce("n_vectors", F.lit(0)) > 0, F.col("n_vectors")).otherwise(F.col("mentions")))
    idf = lambda n: 1 + F.log((total + 1.0) / (n + 1.0))
    spans_ = with_vectors(spans, vectors)
    met = centers_.withColumnRenamed("cluster_type", "of_type").join(spans_, "document_id")
    met = met.withColumn("shared", F.array_sort(F.array_intersect("center_entities", "entities")))
    each = met.select("center_span_id", "span_id", "document_id", F.explode("shared").alias("entity")).join(counts, ["document_id", "entity"]).join(totals, "document_id")
    by_entity = each.groupBy("center_span_id", "span_id").agg(F.least(F.lit(1.0), F.sum(idf(F.col("n"))) / F.greatest(F.lit(1.0), 2 * F.max(idf(F.col("rarest"))))).alias("entity"))
    is_center = F.col("span_id") == F.col("center_span_id")
    of_center = F.first(F.when(is_center, F.struct("vector")), ignorenulls=True).over(Window.partitionBy("document_id", "center_span_id"))
    met = met.withColumn("center", of_center).where(F.col("center").isNotNull())
    both = F.col("vector").isNotNull() & F.col("center.vector").isNotNull()
    near = F.when(both, F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("vector"), F.col("center.vector"))))).otherwise(0.0)
    scored = met.withColumn("near", near).drop("vector", "center").join(by_entity, ["center_span_id", "span_id"], "left")
    words = lambda summary, entities: distinct_tokens(F.concat_ws("\n", summary, F.array_join(entities, "\n")))
    overlap = F.size(F.array_intersect(words("summary", "entities"), words("center_summary", "center_entities")))
    parts = {
        "vector": F.col("near"),
        "entity": F.coalesce("entity", F.lit(0.0)),
        "bm25": F.least(F.lit(1.0), overlap / 20.0),
        "chapter": proximity(F.abs(chapter_number(F.col("chapter_id")) - chapter_number(F.col("center_chapter_id")))),
        "salience": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("salience_score"))),
    }
    scored = scored.withColumns({f"part_{k}": v for k, v in parts.items()})
    score = F.when(is_center, 1.0).otherwise(sum((w * F.col(f"part_{k}") for k, w in weights.items()), F.lit(0.0)))
    reasons = F.array_compact(
        F.array(
            F.when(is_center, "center_span"),
            F.when(F.col("cluster_type") == F.col("of_type"), "same_cluster_type"),
            F.when(F.size("shared") > 0, F.concat(F.lit("shared_entities:"), F.array_join(F.slice("shared", 1, 4), ","))),
            F.when(F.col("part_chapter") == 1.0, "same_chapter").when(F.col("part_chapter") >= 0.5, "adjacent_chapter"),
            F.when(F.col("part_bm25") > 0, F.format_string("bm25_overlap:%.3f", "part_bm25")),
            F.when(F.col("part_vector") > 0, F.format_string("vector_similarity:%.3f", "part_vector")),
        )
    )
    return scored.select(
        "document_id", F.col("of_type").alias("cluster_type"), "type_rank", "center_span_id", "center_summary", "span_id", "entities", "ord",
        F.coalesce("span_start_idx", F.lit(0)).alias("span_start_idx"), "salience_score", is_center.alias("is_center"), F.round(score, 6).alias("score"),
        *(F.round(f"part_{k}", 6).alias(f"{k}_component" if k == "salience" else f"{k}_score") for k in parts), F.when(F.size(reasons) == 0, F.array(F.lit("salience_fallback"))).otherwise(reasons).alias("reasons"),
    )


def members(scores: DataFrame, limit: int = 8, least: int = 5) -> DataFrame:
    """The leading members of each cluster, its center first; clusters with too few drop out."""
    by = Window.partitionBy("document_id", "center_span_id")
    order = by.orderBy(F.desc("is_center"), F.desc("score"), F.desc("salience_score"), "span_start_idx", "ord")
    ranked = scores.withColumn("member_rank", F.row_number().over(order)).where(F.col("member_rank") <= max(limit, least))
    return ranked.withColumn("n", F.count(F.lit(1)).over(by)).where(F.col("n") >= least).drop("n")


def clusters(members_: DataFrame) -> DataFrame:
    """One row a cluster: id, name, summary, members in order, confidence."""
    keys = ["document_id", "cluster_type", "center_span_id"]
    listed = members_.groupBy(*keys).agg(F.first("center_summary").alias("center_summary"), F.min("type_rank").alias("type_rank"), F.array_sort(F.collect_list(F.struct("member_rank", "span_id"))).alias("m"), F.avg(F.when(~F.col("is_center"), F.col("score"))).alias("mean"))
    named = members_.select(*keys, "member_rank", F.posexplode("entities").alias("pos", "entity")).groupBy(*keys, "entity").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("member_rank", "pos")).alias("first"))
    hit = F.lit(False)
    for name, words in fixed.ENTITY_WORDS.items():
        hit = hit | ((F.col("cluster_type") == name) & contains_any(F.col("entity"), words))
    top = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first"))
    lead = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("hit"), F.desc("n"), F.length("entity").desc(), "first"))
    ranked = named.withColumn("hit", hit).withColumns({"top": top, "lead": lead})
    chosen = ranked.groupBy(*keys).agg(F.max(F.when(F.col("lead") == 1, F.col("entity"))).alias("lead_entity"), F.array_sort(F.collect_list(F.when(F.col("top") <= 3, F.struct("top", "entity")))).alias("top3"))
    label = F.col("cluster_type")
    for name, text in fixed.CLUSTER_TYPE_LABELS.items():
        label = F.when(F.col("cluster_type") == name, text).otherwise(label)
    out = listed.join(chosen, keys, "left")
    about = F.coalesce(F.array_join(F.transform("top3", lambda t: t["entity"]), "、"), "center_summary")
    cluster_id = F.concat(F.lit("cluster_"), F.left(uuid5_hex(F.concat_ws("::", F.lit("cluster"), "document_id", "cluster_type", "center_span_id")), F.lit(16)))
    return out.select(
        cluster_id.alias("cluster_id"), *keys, "type_rank",
        F.concat(label, F.lit("："), F.coalesce("lead_entity", "center_summary")).alias("cluster_name"),
        F.concat(label, F.lit("聚合，以中心 Span「"), F.col("center_summary"), F.lit("」为锚点，成员主要涉及："), about, F.lit("。")).alias("summary"),
        F.transform("m", lambda x: x["span_id"]).alias("member_span_ids"),
        F.round(F.least(F.lit(1.0), F.coalesce("mean", F.lit(1.0))), 4).alias("confidence"),
    )


def edges(clusters_: DataFrame, members_: DataFrame, chapters: DataFrame) -> DataFrame:
    """SUPPORTS, RELATED_TO, MENTIONS_ENTITY and ADJACENT_CHAPTER edges, one a stable id, the last write kept."""
    of = members_.join(clusters_.select("document_id", "center_span_id", "cluster_id"), ["document_id", "center_span_id"])
    edge = lambda df, a, b, ta, tb, kind, weight: df.select("document_id", a.alias("from_id"), b.alias("to_id"), F.lit(ta).alias("from_type"), F.lit(tb).alias("to_type"), F.lit(kind).alias("edge_type"), weight.cast("double").alias("weight"), F.col("at"))
    at = F.struct(F.col("type_rank").cast("int").alias("c"), F.col("member_rank").cast("int").alias("m"))
    of = of.withColumn("at", at)
    supports = edge(of, F.col("cluster_id"), F.col("span_id"), "CenterSpanCluster", "Span", "SUPPORTS", F.col("score"))
    related = edge(of.where(~F.col("is_center")), F.col("center_span_id"), F.col("span_id"), "Span", "Span", "RELATED_TO", F.least(F.lit(1.0), F.col("score")))
    mentions = of.withColumn("entity", F.explode("entities"))
    mentions = edge(mentions, F.col("span_id"), F.concat(F.lit("entity::"), F.col("document_id"), F.lit("::"), F.col("entity")), "Span", "Entity", "MENTIONS_ENTITY", F.lit(1.0))
    after = F.lead("chapter_id").over(Window.partitionBy("document_id").orderBy("chapter_index"))
    next_ = chapters.withColumns({"after": after, "at": F.struct(F.lit(0).alias("c"), F.col("chapter_index").cast("int").alias("m"))}).where(F.col("after").isNotNull())
    adjacent = edge(next_, F.col("chapter_id"), F.col("after"), "Chapter", "Chapter", "ADJACENT_CHAPTER", F.lit(1.0))
    every = supports.unionByName(related).unionByName(mentions).unionByName(adjacent)
    edge_id = F.concat(F.lit("edge_"), F.left(uuid5_hex(F.concat_ws("::", "document_id", "from_id", "to_id", "edge_type")), F.lit(20)))
    last = every.groupBy("document_id", "from_id", "to_id", "from_type", "to_type", "edge_type").agg(F.max_by("weight", "at").alias("weight"))
    return last.select(edge_id.alias("edge_id"), "document_id", "from_id", "to_id", "from_type", "to_type", "edge_type", F.round("weight", 6).alias("weight"))


def walk(edges_: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop) reached from `start` (node) along edges in either direction, each at its least number of hops."""
    both = edges_.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(edges_.select("to_id", "from_id")).distinct()
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    front = seen
    for k in range(1, hops + 1):
        front = front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(front)
    return seen


def nodes(clusters_: DataFrame, spans: DataFrame, chapters: DataFrame, edges_: DataFrame) -> DataFrame:
    """(document_id, node_id, node_type, name, properties) of all that the edges join: clusters, spans, chapters, entities."""
    node = lambda df, key, kind, name, props: df.select("document_id", key.alias("node_id"), F.lit(kind).alias("node_type"), name.alias("name"), props.alias("properties"))
    ends = edges_.select("document_id", F.col("from_id").alias("id"), F.col("from_type").alias("kind")).union(edges_.select("document_id", "to_id", "to_type")).distinct()
    used = lambda kind, key: ends.where(F.col("kind") == kind).select("document_id", F.col("id").alias(key))
    c = node(clusters_, F.col("cluster_id"), "CenterSpanCluster", F.col("cluster_name"), F.to_json(F.struct("cluster_type", "summary", "confidence")))
    s = node(spans.join(used("Span", "span_id"), ["document_id", "span_id"]), F.col("span_id"), "Span", F.col("summary"), F.to_json(F.struct("chapter_id", "span_type", "salience_score", "span_start_idx", "span_end_idx")))
    h = node(chapters, F.col("chapter_id"), "Chapter", F.col("chapter_title"), F.to_json(F.struct("chapter_index")))
    e = ends.where("kind = 'Entity'")
    e = node(e, F.col("id"), "Entity", F.substring_index("id", "::", -1), F.lit("{}"))
    return c.unionByName(s).unionByName(h).unionByName(e)


def write_graph(nodes_: DataFrame, edges_: DataFrame, path: str) -> None:
    """The property graph as node and edge tables; the subgraphs of the documents written replace those stored."""
    for name, rows in (("nodes", nodes_), ("edges", edges_)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(f"{path}/{name}")
