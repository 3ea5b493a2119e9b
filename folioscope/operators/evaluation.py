"""Chapter-level retrieval metrics for all questions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

METRICS = ("weighted_recall", "hit", "ndcg", "core_recall", "facet_coverage", "noise")


def chapter_ranking(results: DataFrame) -> DataFrame:
    """(question_id, chapter_id, score, best_span_id, hit_count, sources, rank): span results rolled up to chapters."""
    rows = results.where(F.col("chapter_id").isNotNull() & (F.col("chapter_id") != ""))
    best = F.max_by(F.struct("span_id", "rank"), F.struct("score", -F.col("rank")))
    one = rows.groupBy("question_id", "chapter_id").agg(F.max("score").alias("score"), best.alias("b"), F.count(F.lit(1)).alias("hit_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.min("rank").alias("first"))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "first"))
    return one.select("question_id", "chapter_id", "score", F.col("b.span_id").alias("best_span_id"), "hit_count", "sources", rank.alias("rank"))


def normalize_gold(gold: DataFrame) -> DataFrame:
    """Gold chapters with weights that sum to 1: from weights, else relevances, else equal."""
    by = Window.partitionBy("question_id")
    w, r = F.greatest(F.lit(0.0), F.col("weight")), F.greatest(F.lit(0.0), F.col("relevance"))
    ws, rs, n = F.sum(w).over(by), F.sum(r).over(by), F.count(F.lit(1)).over(by)
    return gold.withColumn("weight", F.when(ws > 0, w / ws).when(rs > 0, r / rs).otherwise(1 / n))


def question_scores(questions: DataFrame, gold: DataFrame, predicted: DataFrame, negatives: DataFrame, cutoffs: tuple[int, ...] = fixed.CUTOFFS) -> DataFrame:
    """One row a question with every metric at every cutoff.

    questions (question_id, profile, query_type, required_facets), gold (question_id, chapter_id, weight, relevance,
    facet), predicted (question_id, chapter_id, chapter_index, rank), negatives (question_id, chapter_id,
    chapter_index).
    """
    q = ["question_id"]
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    ideal = gold.withColumn("ideal_rank", F.row_number().over(Window.partitionBy(*q).orderBy(F.desc("relevance"))))
    facet = F.when(F.trim("facet") != "", F.col("facet"))
    of_gold = ideal.groupBy(*q).agg(F.count(F.lit(1)).alias("gold_n"), F.count_if(F.col("relevance") >= 3).alias("core_n"), F.collect_set(facet).alias("gold_facets"), *(F.sum(F.when(F.col("ideal_rank") <= k, gain(F.col("relevance"), F.col("ideal_rank")))).alias(f"ideal_{k}") for k in cutoffs))
    bad_id = negatives.where(F.col("chapter_id") != "").select(*q, "chapter_id").distinct().withColumn("bad_id", F.lit(True))
    bad_index = negatives.where(F.col("chapter_index") > 0).select(*q, "chapter_index").distinct().withColumn("bad_index", F.lit(True))
    hits = predicted.join(gold.select(*q, "chapter_id", "weight", "relevance", facet.alias("facet"), F.lit(True).alias("is_gold")), [*q, "chapter_id"], "left").join(bad_id, [*q, "chapter_id"], "left").join(bad_index, [*q, "chapter_index"], "left")
    noisy = F.coalesce("bad_id", "bad_index", F.lit(False))
    aggs = [F.count(F.lit(1)).alias("predicted_chapter_count"), F.min(F.when(F.col("is_gold"), F.col("rank"))).alias("first_gold")]
    for k in cutoffs:
        at = lambda x, k=k: F.when(F.col("rank") <= k, x)
        aggs += [
            F.sum(at(F.coalesce("weight", F.lit(0.0)))).alias(f"recall_{k}"), F.count(at(F.col("is_gold"))).alias(f"hits_{k}"),
            F.sum(at(gain(F.coalesce("relevance", F.lit(0.0)), F.col("rank")))).alias(f"dcg_{k}"), F.count_if((F.col("rank") <= k) & (F.col("relevance") >= 3)).alias(f"core_{k}"),
            F.collect_set(at(F.col("facet"))).alias(f"facets_{k}"), F.count_if((F.col("rank") <= k) & noisy).alias(f"noisy_{k}"), F.count_if(F.col("rank") <= k).alias(f"there_{k}"),
        ]
    found = questions.join(of_gold, q, "left").join(hits.groupBy(*q).agg(*aggs), q, "left")
    asked = F.filter("required_facets", lambda f: f != "")
    required = F.when(F.size(asked) > 0, F.array_distinct(asked)).otherwise(F.coalesce("gold_facets", F.array().cast("array<string>")))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = {"gold_chapter_count": zero("gold_n"), "predicted_chapter_count": zero("predicted_chapter_count")}
    for k in cutoffs:
        covered = F.size(F.array_intersect(F.coalesce(f"facets_{k}", F.array().cast("array<string>")), required))
        out |= {
            f"weighted_recall_at_{k}": F.coalesce(f"recall_{k}", F.lit(0.0)), f"hit_at_{k}": F.when(zero(f"hits_{k}") > 0, 1.0).otherwise(0.0),
            f"ndcg_at_{k}": ratio(F.coalesce(f"dcg_{k}", F.lit(0.0)), F.coalesce(f"ideal_{k}", F.lit(0.0))), f"core_recall_at_{k}": ratio(zero(f"core_{k}"), zero("core_n")),
            f"facet_coverage_at_{k}": ratio(covered, F.size(required)), f"noise_at_{k}": ratio(zero(f"noisy_{k}"), zero(f"there_{k}")),
        }
    out["mrr"] = F.coalesce(1 / F.col("first_gold"), F.lit(0.0))
    out["missed_weight_at_20"] = 1 - F.coalesce("recall_20", F.lit(0.0)) if 20 in cutoffs else F.lit(1.0)
    return found.select("question_id", "profile", "query_type", *(v.alias(k) for k, v in out.items()))


def metric_means(scores: DataFrame, cutoffs: tuple[int, ...] = fixed.CUTOFFS) -> DataFrame:
    """(grouping, group, question_count, metric means): overall, by profile and by query type, as grouping sets."""
    names = ["mrr", "missed_weight_at_20", *(f"{m}_at_{k}" for k in cutoffs for m in METRICS)]
    known = scores.withColumns({c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")) for c in ("profile", "query_type")})
    sets = [[], [F.col("profile")], [F.col("query_type")]]
    got = known.groupingSets(sets, "profile", "query_type").agg(F.grouping("profile").alias("gp"), F.grouping("query_type").alias("gt"), F.count(F.lit(1)).alias("question_count"), *(F.round(F.avg(c), 6).alias(c) for c in names))
    kind: Column = F.when(F.col("gp") == 0, "profile").when(F.col("gt") == 0, "query_type").otherwise("overall")
    return got.select(kind.alias("grouping"), F.coalesce("profile", "query_type", F.lit("all")).alias("group"), "question_count", *names)


def failure_report(scores: DataFrame, limit: int = 50) -> DataFrame:
    """The worst questions; of those listed, perfect ones are left out. Scores count to 9 digits."""
    worst = scores.orderBy(*(F.round(c, 9) for c in ("weighted_recall_at_20", "facet_coverage_at_20", "mrr")), "question_id").limit(limit)
    return worst.where(F.round("weighted_recall_at_20", 9) < 1)
