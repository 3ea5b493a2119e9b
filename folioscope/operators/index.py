"""Keyword and vector indexes as tables, scoring and top-k search for many questions in one plan."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let, tokens
from ..sources.scratch import settled

#: Replicas of a scope's size, over which its vectors are dealt into blocks.
SALTS = 8
#: Differences of components that a task holds at a time.
GAPS = 1 << 20
#: Distances that are worked on at a time, few enough for a core's cache.
NEAR = 1 << 16
#: Digits that scores and distances are rounded to.
DIGITS = 9


def bm25_text(summary: Column, entities: Column, key_quote: Column) -> Column:
    some = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws("\n", some(summary), some(F.array_join(entities, " ")), some(key_quote))


def postings(docs: DataFrame, id_col: str, text: Column, scope: list[str]) -> DataFrame:
    """(scope, token, id, tf, len): the inverted index, one row for each token of each text.

    Texts are dealt out by their id once; their tokens, which are larger, are counted where they lie.
    """
    each = docs.select(*scope, id_col, text.alias("text")).repartition(id_col).select(*scope, id_col, tokens(F.col("text")).alias("ts")).withColumn("len", F.size("ts"))
    return each.select(*scope, id_col, "len", F.explode("ts").alias("token")).groupBy(*scope, id_col, "len", "token").agg(F.count(F.lit(1)).alias("tf"))


def token_weights(postings_: DataFrame, docs: DataFrame, scope: list[str], id_col: str) -> DataFrame:
    """(scope, token, idf, avgdl): Okapi idf, negative ones replaced by a share of the mean."""
    sizes = docs.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_docs"))
    lengths = postings_.groupBy(*scope).agg(F.sum("tf").alias("n_tokens"))
    df = postings_.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("df"))
    raw = df.join(sizes, scope).join(lengths, scope).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy(*scope).agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, fixed.BM25_EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.join(mean, scope).select(*scope, "token", idf.alias("idf"), (F.col("n_tokens") / F.col("n_docs")).alias("avgdl"))


def bm25_scores(queries: DataFrame, postings_: DataFrame, weights: DataFrame, scope: list[str], id_col: str, few: bool = False) -> DataFrame:
    """(query_id, scope, id, score) for every text that shares a token with a query (query_id, scope, question).

    Tokens of a few questions are sent to the postings, which then stay where they are.
    """
    asked = queries.select("query_id", *scope, F.explode(tokens(F.col("question"))).alias("token")).groupBy("query_id", *scope, "token").agg(F.count(F.lit(1)).alias("qtf"))
    tf, k1, b = F.col("tf"), fixed.BM25_K1, fixed.BM25_B
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    asked = asked.join(weights, [*scope, "token"])
    met = (F.broadcast(settled(asked, "asked")) if few else asked).join(postings_, [*scope, "token"])
    return met.groupBy("query_id", *scope, id_col).agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, keys: list[str], k: int, order: list[Column], name: str = "rank") -> DataFrame:
    """The first k of each key in `order`, numbered from 1."""
    ranked = scores.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other lengths, or a zero norm."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def distance(metric: str, a: Column, b: Column) -> Column:
    """Similarity under a metric, greater is nearer."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if metric == "euclid":
        return -F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x))
    if metric == "manhattan":
        return -F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + F.abs(x))
    raise ValueError(f"unknown distance: {metric}")


def _packed(rows: DataFrame, sizes: DataFrame, scope: list[str], id_col: str, name: str, other: str, groups: int) -> DataFrame:
    """Blocks of one scope's vectors beside each block number of the other side: (group, scope, q_block, c_block, name_ids, name_vectors).

    Rows meet the sizes of their scope over SALTS, so that neither a scope's rows nor its blocks are one task's. A pair
    of blocks is a group of its own, except where it is all of its scope: such small scopes share `groups` groups.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, [*scope, "salt"])
    dealt = dealt.select(*scope, F.pmod(F.xxhash64(id_col, F.lit(1)), f"n_{name}").cast("int").alias(f"{name}_block"), f"n_{name}", f"n_{other}", F.col(id_col).alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("v"))
    packed = dealt.groupBy(*scope, f"{name}_block", f"n_{name}", f"n_{other}").agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    ids = F.transform("rows", lambda r: r["id"]).cast(f"array<{kind}>")
    beside = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(f"{other}_block")
    whole = (F.col("n_q") == 1) & (F.col("n_c") == 1)
    pairs = packed.select(*scope, "n_q", "n_c", f"{name}_block", beside, ids.alias(f"{name}_ids"), F.transform("rows", lambda r: r["v"]).alias(f"{name}_vectors"))
    group = F.when(whole, F.pmod(F.xxhash64(*scope), F.lit(groups))).otherwise(F.xxhash64(*scope, "q_block", "c_block"))
    return pairs.withColumn("group", group).drop("n_q", "n_c")


def euclid(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """[x, y] distances rounded to DIGITS: from a matrix product, and from the differences where its error could tell.

    The error of a squared distance is below `slack`; a distance that it could carry over a rounding step, as that
    of vectors nearly alike, is made anew.
    """
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    slack = 8 * (x.shape[1] + 4) * np.finfo(float).eps * (xx.max(initial=0.0) + yy.max(initial=0.0))
    slack = slack if np.isfinite(slack) else np.inf
    out = np.empty((len(x), len(y)))
    step, most = max(1, NEAR // max(1, len(y))), max(1, GAPS // max(1, x.shape[1]))
    for k in range(0, len(x), step):
        square = np.maximum(xx[k : k + step, None] + yy[None, :] - 2 * (x[k : k + step] @ y.T), 0.0)
        d = np.sqrt(square)
        scaled = d * 10.0**DIGITS
        steps = np.rint(scaled)
        out[k : k + step] = steps / 10.0**DIGITS
        near = (0.5 - np.abs(scaled - steps)) * d <= slack * 10.0**DIGITS + 1e-6 * (d + square)
        i, j = np.nonzero(near | ~(square < np.inf) | (square <= 4 * slack))
        for n in range(0, len(i), most):
            gaps = x[i[n : n + most] + k] - y[j[n : n + most]]
            out[i[n : n + most] + k, j[n : n + most]] = np.round(np.sqrt((gaps * gaps).sum(1)), DIGITS)
    return out


def _scores(metric: str, a: list, b: list) -> np.ndarray:
    """[a, b] similarities; vectors of unlike length, and under cosine zero ones, are 0 to each other."""
    sizes_a, sizes_b = (np.array([len(v) for v in x]) for x in (a, b))
    out = np.zeros((len(a), len(b)))
    for d in np.intersect1d(sizes_a, sizes_b):
        if d:
            i, j = np.flatnonzero(sizes_a == d), np.flatnonzero(sizes_b == d)
            x, y = np.stack([a[k] for k in i]), np.stack([b[k] for k in j])
            if metric == "cosine":
                x, y = (np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0) for m in (x, y))
            if metric in ("cosine", "dot"):
                got = x @ y.T
            elif metric == "euclid":
                got = -euclid(x, y)
            else:
                got = np.empty((len(i), len(j)))
                step = max(1, GAPS // (len(j) * int(d)))
                for k in range(0, len(i), step):
                    got[k : k + step] = -np.abs(x[k : k + step, None, :] - y[None, :, :]).sum(2)
            if got.shape == out.shape:
                return got
            out[np.ix_(i, j)] = got
    return out


def _best(q: np.ndarray, q_vectors: list, c: np.ndarray, c_vectors: list, k: int, metric: str, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores): the k nearest candidates of each query."""
    by_id = np.argsort(c, kind="stable")
    s, c = np.round(_scores(metric, q_vectors, [c_vectors[k] for k in by_id]), DIGITS) + 0.0, c[by_id]
    s[np.isnan(s)] = -np.inf
    if others:
        s[q[:, None] == c[None, :]] = -np.inf
    least = np.partition(s, len(c) - k, axis=1)[:, len(c) - k] if k < len(c) else np.full(len(q), -np.inf)
    rows, at = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    score = s[rows, at]
    order = np.lexsort((-score, rows))  # equal scores stay in the order of ids
    rows, at, score = rows[order], at[order], score[order]
    first = (np.arange(len(rows)) - np.searchsorted(rows, rows) < k) & np.isfinite(score)
    return q[rows[first]], c[at[first]], score[first]


def nearest(queries: DataFrame, vectors: DataFrame, scope: list[str], query_id: str, id_col: str, k: int, metric: str = "cosine", block: int = 1024, others: bool = False) -> DataFrame:
    """(query_id, scope, id_col, score): of each block of a query's scope the k nearest, by blocked matrix products.

    Both sides have (scope, id, vector). Every pair of a query block and a candidate block is a key of its own, so a
    scope of many blocks is as many tasks; scopes of one pair are computed some together, about `block` vectors at a
    time, so that many small ones do not cost a call each. A pair costs one product of vectors normalised once a block, and a query
    keeps k candidates a block, so what leaves a block is bounded. `others` leaves out pairs of one id. Scores are
    rounded to 9 digits, ties go to the smaller id.
    """
    if metric not in ("cosine", "dot", "euclid", "manhattan"):
        raise ValueError(f"unknown distance: {metric}")
    out = [f"{query_id} {queries.schema[query_id].dataType.simpleString()}", *(f"{c} {queries.schema[c].dataType.simpleString()}" for c in scope), f"{id_col} {vectors.schema[id_col].dataType.simpleString()}", "score double"]
    names = [query_id, *scope, id_col, "score"]

    pair = [*scope, "q_block", "c_block"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held = {key: (np.asarray(ids), list(vs)) for *key, ids, vs in right[[*pair, "c_ids", "c_vectors"]].itertuples(index=False, name=None) for key in [tuple(key)]}
        found = []
        for *key, ids, vs in left[[*pair, "q_ids", "q_vectors"]].itertuples(index=False, name=None):
            if tuple(key) in held:
                q, c, score = _best(np.asarray(ids), list(vs), *held[tuple(key)], k, metric, others)
                found.append((q, *(np.repeat(np.array([x], object), len(q)) for x in key[: len(scope)]), c, score))
        if not found:
            return pd.DataFrame(columns=names)
        return pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)), columns=names)

    count = lambda rows, name: rows.groupBy(*scope).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = count(queries, "n_q").join(count(vectors, "n_c"), scope)
    groups = max(1, -(-vectors.count() // block))
    left, right = _packed(queries, sizes, scope, query_id, "q", "c", groups), _packed(vectors, sizes, scope, id_col, "c", "q", groups)
    right = right.toDF(*right.columns)  # columns of its own, where both sides come from one table
    return left.groupBy("group").cogroup(right.groupBy("group")).applyInPandas(run, ", ".join(out))  # Python holds one group at a time


def nearest_others(vectors: DataFrame, scope: list[str], query_id: str, id_col: str, k: int, metric: str = "cosine", block: int = 1024) -> DataFrame:
    """What `nearest` gives where the vectors (scope, id, vector) ask for each other, under `query_id` and `id_col`.

    Scopes of at most `block` vectors are computed some together, and their vectors are sent there once; those of
    larger scopes go through pairs of blocks.
    """
    sizes = vectors.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"))
    large = settled(sizes.where(F.col("n") > block).select(*scope), "scopes")
    split = large.limit(1).count() > 0
    small = vectors.join(large, scope, "left_anti") if split else vectors
    names, kinds = [query_id, *scope, id_col, "score"], {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = ", ".join([f"{query_id} {kinds[id_col]}", *(f"{c} {kinds[c]}" for c in scope), f"{id_col} {kinds[id_col]}", "score double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for key, part in pdf.groupby(scope, sort=False):
            ids, vs = part[id_col].to_numpy(), list(part["vector"])
            q, c, score = _best(ids, vs, ids, vs, k, metric, True)
            found.append((q, *(np.repeat(np.array([x], object), len(q)) for x in key), c, score))
        if not found:
            return pd.DataFrame(columns=names)
        return pd.DataFrame(dict(zip(names, (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)), columns=names)

    groups = max(1, -(-vectors.count() // block))
    dealt = small.select(*scope, id_col, F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.pmod(F.xxhash64(*scope), F.lit(groups)).alias("group"))
    out = dealt.groupBy("group").applyInPandas(run, schema)
    if split:
        rest = vectors.join(large, scope, "left_semi")
        out = out.unionByName(nearest(rest.withColumnRenamed(id_col, query_id), rest, scope, query_id, id_col, k, metric, block, others=True).select(*names))
    return out


def vector_search(queries: DataFrame, vectors: DataFrame, scope: list[str], id_col: str, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, scope, id, score, rank) of the k nearest vectors inside a query's scope, an exact scan in blocks."""
    scored = nearest(queries.select("query_id", *scope, "vector"), vectors.select(*scope, id_col, "vector"), scope, "query_id", id_col, k, metric)
    return top_k(scored, ["query_id", *scope], k, [F.desc("score"), F.asc(id_col)])


def hash_embedding(text: Column, dimensions: int) -> Column:
    """A deterministic unit vector from a text's chained SHA-256 digests, each made once a row."""
    rounds = range((dimensions + 31) // 32)
    raw = F.concat(*(F.unhex(F.sha2(F.concat(F.encode(text, "utf-8"), F.unhex(F.lit(f"{k:08x}"))), 256)) for k in rounds))

    def values(digits: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5)

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(F.when(norm == 0, 1.0).otherwise(norm), lambda n: F.transform(v, lambda x: x / n))

    return let(let(F.hex(raw), values), unit)


def embed_with_cache(inputs: DataFrame, cache: DataFrame, embed) -> DataFrame:
    """(cache_key, input_text) with vectors: known keys from the cache, the rest embedded once each."""
    wanted = inputs.select("cache_key", "input_text").dropDuplicates(["cache_key"])
    known = wanted.join(cache.select("cache_key", "vector"), "cache_key")
    new = embed(wanted.join(cache, "cache_key", "left_anti"))
    every = known.withColumn("hit", F.lit(True)).unionByName(new.select("cache_key", "input_text", "vector").withColumn("hit", F.lit(False)))
    return inputs.drop("input_text").join(every, "cache_key")


def save_postings(postings_: DataFrame, docs: DataFrame, path: str, scope: list[str], id_col: str) -> None:
    """The inverted index as two tables: postings by bucket of the token, and the weights of the tokens."""
    postings_.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(64))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    token_weights(postings_, docs, scope, id_col).write.mode("overwrite").parquet(f"{path}/weights")


def load_postings(spark: SparkSession, path: str, asked: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, weights); with the tokens that are asked for, only their buckets are read."""
    held, weights = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/weights")
    if asked is not None:
        buckets = [r["b"] for r in spark.createDataFrame([(t,) for t in asked], "t string").select(F.pmod(F.xxhash64("t"), F.lit(64)).alias("b")).distinct().collect()]
        held = held.where(F.col("bucket").isin(*buckets) & F.col("token").isin(*asked))
    return held.drop("bucket"), weights


def embedded_in_batches(inputs: DataFrame, make_client, size: int, batch: int = 32) -> DataFrame:
    """(cache_key, input_text, vector) from an embedding client made once a task, `batch` texts a call; answers of
    another number or size are errors."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in batches:
            vectors: list[list[float]] = []
            for at in range(0, len(pdf), batch):
                texts = pdf["input_text"].iloc[at : at + batch].tolist()
                got = client.embed(texts)
                if len(got) != len(texts) or any(len(v) != size for v in got):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts, of sizes {sorted({len(v) for v in got})}")
                vectors += [[float(x) for x in v] for v in got]
            yield pdf[["cache_key", "input_text"]].assign(vector=vectors)

    return inputs.select("cache_key", "input_text").mapInPandas(run, "cache_key string, input_text string, vector array<double>")
