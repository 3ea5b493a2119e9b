"""Quality rules in DataFrame expressions only: base statistics, then robust multivariate outliers.

Each (language, source) group gets minimum-covariance-determinant estimates of location and scatter of five
transformed statistics. Three starts, all about the medians, are tried: absolute deviations alone, the covariance of
the hyperbolic tangents of standardised rows, and that of their spatial signs. Each takes TRIALS concentration steps,
every one of which takes mean and covariance of the share `h` of rows nearest to the estimate before; the start that
comes to the least determinant goes on for the steps left. A statistic is often constant over the concentrated rows,
and the least determinant would then be zero whatever the others do; so, as in the regularised form of the
estimator, a fixed diagonal, FLOORS, is added to the scatter. Every step is two aggregations with partial sums before
their shuffle, so a source with a third of all rows is no hot key.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least standard deviation of each transformed statistic.
FLOORS = (0.35, 0.45, 0.35, 0.5, 0.12)
P = len(FLOORS)
#: Squared distance beyond which a row is an outlier: a chi-square of 5 degrees exceeds it once in 10^5.
CUTOFF = 30.856
SHARE, TRIALS, STEPS, LEAST_GROUP = 0.75, 2, 4, 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 5-word window which stands in the text twice or more."""

    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(w[i + k] for k in range(5))))
        return F.when(F.size(w) >= 5, hashed).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        def of_sorted(z: Column) -> Column:
            same = lambda e, k: F.coalesce(F.try_element_at(z, k)["h"] == e["h"], F.lit(False))
            twice = F.filter(z, lambda e, k: F.when(k > 0, same(e, k)).otherwise(F.lit(False)) | same(e, k + 2))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.sequence(e["i"], e["i"] + 4)))))

        found = let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)

    return let(windows(words), covered)


def statistics(text: Column) -> Column:
    """A struct of the base statistics of a whole text; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    return let(words, of_words)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def transformed(s: Column) -> list[Column]:
    """The statistic vector: lengths and counts as logarithms, shares as roots."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return [
        F.log1p(s["n_words"].cast("double")),
        s["word_chars"] / words,
        F.log1p(100 * s["n_symbols"] / F.greatest(s["word_chars"], F.lit(1))),
        F.log1p(s["n_dup_lines"].cast("double")),
        F.sqrt(s["n_repeat_words"] / words),
    ]


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    for k in range(1, 400):
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def consistency(p: int, share: float) -> float:
    """Factor that makes the scatter of the nearest `share` of normal rows the scatter of all."""
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(p / 2, mid / 2) < share else (low, mid)
    return share / _gamma_p(p / 2 + 1, low / 2)


def _whitening(cov: Callable[[int, int], Column], df: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and w: the inverse of the Cholesky factor of a covariance, row by row, as one array."""
    df = df.select(*keep, *(cov(i, j).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)))
    col = F.col
    for j in range(P):
        rest = col(f"c{j}{j}") - sum((col(f"l{j}{k}") * col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2 * 1e-3))))
        df = df.withColumns({f"l{i}{j}": (col(f"c{i}{j}") - sum((col(f"l{i}{k}") * col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / col(f"l{j}{j}") for i in range(j + 1, P)})
    for i in range(P):
        df = df.withColumns({f"w{i}{j}": (F.lit(1.0) if i == j else -sum((col(f"l{i}{k}") * col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0))) / col(f"l{i}{i}") for j in range(i + 1)})
    return df.select(*keep, F.array(*(col(f"w{i}{j}") for i in range(P) for j in range(i + 1))).alias("w"))


def squared_distance(x: Callable[[int], Column], m: Column, w: Column) -> Column:
    at = [(i, j) for i in range(P) for j in range(i + 1)]
    rows = [sum((w[k] * (x(j) - m[j]) for k, (i2, j) in enumerate(at) if i2 == i), F.lit(0.0)) for i in range(P)]
    return sum((r * r for r in rows), F.lit(0.0))


def _starts(named: DataFrame, least: int) -> DataFrame:
    """(mg, k, m, w): three starts for each group of rows (g, x0..x4)."""
    xs = [f"x{i}" for i in range(P)]
    middle = named.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(x, 0.5, 2000).alias(f"m{i}") for i, x in enumerate(xs))).where(F.col("n") >= least)
    middle = middle.withColumnRenamed("g", "mg")
    spread = named.join(middle, F.col("g").eqNullSafe(F.col("mg"))).groupBy("mg").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(P)), *(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 2000).alias(f"s{i}") for i, x in enumerate(xs))
    )
    spread = spread.withColumns({f"s{i}": F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOORS[i] ** 2) for i in range(P)})
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(xs)]
    norm = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    each = named.join(spread, F.col("g").eqNullSafe(F.col("mg"))).select("mg", *(F.col(f"{c}{i}") for c in "ms" for i in range(P)), *(F.tanh(v).alias(f"t{i}") for i, v in enumerate(z)), *(F.coalesce(F.try_divide(v, norm), F.lit(0.0)).alias(f"u{i}") for i, v in enumerate(z)))
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = each.groupBy("mg").agg(*(F.first(f"{c}{i}").alias(f"{c}{i}") for c in "ms" for i in range(P)), *(F.avg(F.col(f"{c}{i}") * F.col(f"{c}{j}")).alias(f"{c}{i}{j}") for c in "tu" for i, j in pairs))
    sums = sums.withColumn("m", F.array(*(F.col(f"m{i}") for i in range(P))))
    scaled = lambda i, j: F.col(f"s{i}") * F.col(f"s{j}")
    floor = lambda i, j: FLOORS[i] ** 2 if i == j else 0.0
    made = (
        lambda i, j: scaled(i, j) if i == j else F.lit(0.0),
        lambda i, j: scaled(i, j) * F.col(f"t{i}{j}") + floor(i, j),
        lambda i, j: scaled(i, j) * F.col(f"u{i}{j}") * P + floor(i, j),
    )
    out = None
    for k, cov in enumerate(made):
        one = _whitening(cov, sums.withColumn("k", F.lit(k)), ["mg", "k", "m"])
        out = one if out is None else out.unionByName(one)
    return out


def _concentrated(named: DataFrame, now: DataFrame, share: float) -> DataFrame:
    """A concentration step of every estimate (mg, k, m, w)."""
    factor, xs = consistency(P, share), [f"x{i}" for i in range(P)]
    far = named.join(now, F.col("g").eqNullSafe(F.col("mg"))).withColumn("d", squared_distance(lambda i: F.col(f"x{i}"), F.col("m"), F.col("w")))
    near = far.groupBy("mg", "k").agg(F.percentile_approx("d", share, 2000).alias("q")).toDF("qg", "qk", "q")
    kept = far.join(near, F.col("mg").eqNullSafe(F.col("qg")) & (F.col("k") == F.col("qk"))).where(F.col("d") <= F.col("q"))
    sums = kept.groupBy("mg", "k").agg(*(F.avg(x).alias(f"a{i}") for i, x in enumerate(xs)), *(F.covar_pop(xs[i], xs[j]).alias(f"v{i}{j}") for i in range(P) for j in range(i + 1)))
    sums = sums.withColumn("m", F.array(*(F.col(f"a{i}") for i in range(P))))
    return _whitening(lambda i, j: factor * F.col(f"v{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0), sums, ["mg", "k", "m"])


def log_determinant(w: Column) -> Column:
    """Of the scatter whose Cholesky factor has the inverse w."""
    return -2 * sum((F.log(w[i * (i + 1) // 2 + i]) for i in range(P)), F.lit(0.0))


def estimates(rows: DataFrame, scratch: Scratch, share: float = SHARE, steps: int = STEPS, least: int = LEAST_GROUP) -> DataFrame:
    """MCD estimates (lang, source, m, w) of rows (lang, source, x0..x4); keys have no nulls.

    Groups under `least` rows share one estimate, stored under each of their keys; with fewer than `least` rows
    together they get none.
    """
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    keys = scratch.write("keys", sizes.select("lang", "source", F.when(F.col("n") >= least, F.struct("lang", "source")).alias("g")))
    named = rows.join(keys, ["lang", "source"]).select("g", *(f"x{i}" for i in range(P)))
    now = scratch.write("starts", _starts(named, least))
    for step in range(steps):
        now = _concentrated(named, now, share)
        if step + 1 == TRIALS or step + 1 == steps:
            best = F.min_by(F.struct("k", "m", "w"), F.struct(log_determinant(F.col("w")), "k"))
            now = now.groupBy("mg").agg(best.alias("best")).select("mg", "best.*")
        now = scratch.write(f"step{step}", now)
    return scratch.write("estimates", keys.join(now, F.col("g").eqNullSafe(F.col("mg"))).select("lang", "source", "m", "w"))


def judged(docs: DataFrame, text_col: str = "text", cutoff: float = CUTOFF, keep_text: bool = True) -> DataFrame:
    """All columns of `docs` (without the text, if not kept) in a struct `row`, their statistics `s`, `distance`
    (squared; null where a group is too small), `failed` (base rules) and `kept`.

    Rows are never merged: repeated rows are judged alike. A null language or source is a group of its own. Null
    and empty texts fail the base rules; texts may be of any length. An empty table gives no rows. Columns that bear
    the names used here do no harm, as they stay inside `row`.
    """
    scratch = Scratch(docs.sparkSession)
    key = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit(""))
    held = [docs[c] for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*held).alias("row"), key("lang").alias("lang"), key("source").alias("source"), statistics(docs[text_col]).alias("s"))
    rows = scratch.write("statistics", rows)
    vectors = rows.where(~base_failed(F.col("s"))).select("lang", "source", *(x.alias(f"x{i}") for i, x in enumerate(transformed(F.col("s")))))
    found = estimates(scratch.write("vectors", vectors), scratch)
    xs = transformed(F.col("s"))
    out = rows.join(found, ["lang", "source"], "left").select("row", "s", squared_distance(lambda i: xs[i], F.col("m"), F.col("w")).alias("distance"))
    failed = base_failed(F.col("s"))
    return out.withColumns({"failed": failed, "kept": ~failed & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)})
