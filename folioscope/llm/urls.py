"""URL filters in DataFrame expressions only: host and path rules, then a ratio of character language models.

URLs that a rule decides are the labelled ones. Accepted and rejected ones each train a variable-order Markov
model over characters (contexts of 0 to DEPTH, Witten-Bell smoothing down to add-one); what is scored is the mean
over a URL's characters of the difference of the two models' log probabilities. It is looked up as a back-off model:
the log ratio at the longest context that was seen with the character, and the log ratio of the escape masses of
every longer context that was seen without it. Characters are read as they are, digits too, since rules may part URLs
by a digit; each different host and path is scored once. The threshold is the one that best separates labelled URLs
held out of the models.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

DEPTH = 4
#: Symbols that add-one smoothing allows for.
ALPHABET = 256
HELD_OUT = 4  # one labelled URL in so many sets the threshold
#: Grams up to which their ratios are broadcast; beyond, the join is Spark's choice.
BROADCAST = 1_000_000


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _modelled(host: Column, path: Column) -> Column:
    """What the models read: host and path between edge marks."""
    return F.concat(F.lit("\x02"), host, path, F.lit("\x03"))


def _grams(seq: Column) -> Column:
    """Every (pos, order, gram): the character at pos with 0 to DEPTH before it."""

    def at(i: Column) -> Column:
        orders = F.sequence(F.lit(0), F.least(F.lit(DEPTH), i - 1))
        return F.transform(orders, lambda o: F.struct(i.alias("pos"), o.alias("order"), F.substring(seq, i - o, o + 1).alias("gram")))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(seq)), at))


def log_ratios(labelled: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, v, back) from (seq, accepted boolean): v is the log ratio of the gram's last character after the others, back
    that of the escape masses after the whole gram (null where nothing follows it). The empty gram has the log ratio of a
    character that neither model has seen."""
    each = labelled.select("accepted", F.explode(_grams(F.col("seq"))).alias("g")).select("accepted", F.col("g.gram").alias("gram"))
    hit = F.col("accepted")
    counts = scratch.write("grams", each.groupBy("gram").agg(F.count(F.when(hit, 1)).alias("a"), F.count(F.when(~hit, 1)).alias("r")).withColumn("order", F.length("gram") - 1))
    kinds = {"a": "pa", "r": "pr"}
    lower = None
    levels, backs = [], []
    for order in range(DEPTH + 1):
        here = counts.where(F.col("order") == order).select("gram", "a", "r")
        if order == 0:
            total = here.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(f"n{k}") for k in kinds))
            n = {k: total.select(f"n{k}").scalar() for k in kinds}
            level = here.select("gram", *((F.col(k) + 1) / (n[k] + ALPHABET + 1) for k in kinds)).toDF("gram", *kinds.values())
            unseen = total.select(F.lit("").alias("gram"), (F.log(F.col("nr") + ALPHABET + 1) - F.log(F.col("na") + ALPHABET + 1)).alias("v"), F.lit(None).cast("double").alias("back"))
        else:
            context = F.expr(f"substring(gram, 1, {order})")
            here = here.withColumn("context", context).withColumn("suffix", F.expr("substring(gram, 2)"))
            seen = here.groupBy("context").agg(*(F.sum(k).alias(f"n{k}") for k in kinds), *(F.count(F.when(F.col(k) > 0, 1)).alias(f"t{k}") for k in kinds))
            mixed = here.join(seen, "context").join(lower.select(F.col("gram").alias("suffix"), *(F.col(p).alias(f"l{k}") for k, p in kinds.items())), "suffix")
            share = lambda k: F.when(F.col(f"n{k}") == 0, F.col(f"l{k}")).otherwise((F.col(k) + F.col(f"t{k}") * F.col(f"l{k}")) / (F.col(f"n{k}") + F.col(f"t{k}")))
            level = mixed.select("gram", *(share(k).alias(p) for k, p in kinds.items()))
            escape = lambda k: F.when(F.col(f"n{k}") == 0, 0.0).otherwise(F.log(F.col(f"t{k}") / (F.col(f"n{k}") + F.col(f"t{k}"))))
            backs.append(seen.select(F.col("context").alias("gram"), (escape("a") - escape("r")).alias("back")))
        lower = scratch.write(f"order{order}", level)
        levels.append(lower)
    every, back = levels[0], backs[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    for more in backs[1:]:
        back = back.unionByName(more)
    known = every.join(back, "gram", "left").select("gram", (F.log("pa") - F.log("pr")).alias("v"), "back")
    return scratch.write("ratios", known.unionByName(unseen))


def scores(seqs: DataFrame, ratios: DataFrame) -> DataFrame:
    """(h1, h2, score) of distinct sequences: the mean over positions of the difference of the models' log probabilities.

    A gram gives its own ratio to the position where it ends, and its escape ratio to the next one, where it counts if
    no gram as long as it and more was seen there. A gram that stands in most URLs is a hot key of the join when the
    ratios are too many to broadcast; the join may be split there, and each position's rows are combined before they
    are shuffled again.
    """
    each = seqs.select("h1", "h2", F.length("seq").alias("n"), F.explode(_grams(F.col("seq"))).alias("g")).select("h1", "h2", "n", "g.*")
    small = ratios.limit(BROADCAST + 1).count() <= BROADCAST
    known = each.join(F.broadcast(ratios) if small else ratios, "gram")
    here = F.struct("pos", "order", "v", F.lit(None).cast("double").alias("back"))
    after = F.struct((F.col("pos") + 1).alias("pos"), (F.col("order") + 1).alias("order"), F.lit(None).cast("double").alias("v"), "back")
    follows = F.col("back").isNotNull() & (F.col("order") < DEPTH) & (F.col("pos") < F.col("n"))
    told = known.select("h1", "h2", "n", F.explode(F.when(follows, F.array(here, after)).otherwise(F.array(here))).alias("e")).select("h1", "h2", "n", "e.*")
    longest = F.max(F.when(F.col("v").isNotNull(), F.col("order"))).alias("longest")
    escapes = [F.coalesce(F.max(F.when(F.col("v").isNull() & (F.col("order") == k), F.col("back"))), F.lit(0.0)).alias(f"b{k}") for k in range(1, DEPTH + 1)]
    places = told.groupBy("h1", "h2", "n", "pos").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("order"))).alias("v"), longest, *escapes)
    unseen = ratios.where("gram = ''").select("v").scalar()
    passed = sum((F.when(F.coalesce("longest", F.lit(-1)) < k, F.col(f"b{k}")).otherwise(0.0) for k in range(1, DEPTH + 1)), F.lit(0.0))
    sums = places.groupBy("h1", "h2", "n").agg(F.sum(F.coalesce("v", unseen) + passed).alias("v"), F.count(F.lit(1)).alias("told"))
    return sums.select("h1", "h2", ((F.col("v") + unseen * (F.col("n") - F.col("told"))) / F.col("n")).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row `cut`: the score in steps of 0.01 that best parts accepted from rejected; 0 without both kinds."""
    edge = F.greatest(F.lit(-500), F.least(F.lit(500), F.floor(F.col("score") * 100))).cast("int")
    bins = scored.groupBy(edge.alias("bin")).agg(F.count(F.when(F.col("accepted"), 1)).alias("a"), F.count(F.when(~F.col("accepted"), 1)).alias("r"))
    up = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)  # at most 1001 rows
    down = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    good = F.sum("a").over(up) / F.sum("a").over(every) + F.coalesce(F.sum("r").over(down), F.lit(0)) / F.sum("r").over(every)
    both = (F.sum("a").over(every) > 0) & (F.sum("r").over(every) > 0)
    middle = (F.col("bin") + F.coalesce(F.lag("bin").over(Window.orderBy("bin")), "bin")) / 2  # of the gap below
    ranked = bins.select(middle.alias("middle"), F.when(both, good).alias("good"))
    best = F.max(F.when(F.col("good").isNotNull(), F.struct("good", -F.abs(F.col("middle")), "middle")))
    return ranked.agg(best.alias("best")).select(F.coalesce(F.col("best.middle") / 100, F.lit(0.0)).alias("cut"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """`pages` with host, path, rule, verdict ('allow' or 'block') and score (columns of these names are replaced).

    A null URL, or one without '://', has empty host and path and is judged by the method. Repeated rows are
    judged alike; an empty table gives no rows; without labelled URLs all are allowed.
    """
    scratch = Scratch(pages.sparkSession)
    mine = {"host", "path", "rule", "verdict", "score"}
    kept = [c for c in pages.columns if c not in mine or c == url_col]
    rows = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.where(F.col("ruled").isNotNull()).select(_modelled(F.col("host"), F.col("path")).alias("seq"), (F.col("ruled.verdict") == "allow").alias("accepted"))
    apart = F.pmod(F.xxhash64("seq"), F.lit(HELD_OUT)) == 0
    ratios = log_ratios(labelled.where(~apart).select("seq", "accepted"), scratch)
    rows = rows.withColumn("seq", _modelled(F.col("host"), F.col("path"))).withColumns({"h1": F.xxhash64("seq"), "h2": F.xxhash64("seq", F.lit(1))})
    found = scratch.write("scores", scores(rows.groupBy("h1", "h2").agg(F.first("seq").alias("seq")), ratios))
    scored = rows.join(found, ["h1", "h2"], "left").withColumn("score", F.coalesce(F.col("score"), F.lit(0.0)))
    held_out = scored.where(F.col("ruled").isNotNull() & apart).select((F.col("ruled.verdict") == "allow").alias("accepted"), "score")
    cut = scratch.write("cut", threshold(held_out)).scalar()
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select(*kept, "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "score")
