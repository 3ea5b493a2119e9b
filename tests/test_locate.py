"""The cascade of quote location: best pairs without their product, forms against a walk over characters, one pass."""

import random
import unicodedata
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from folioscope import queries
from folioscope.functions import fixed
from folioscope.operators import extraction, locate, segment


def test_best_pair_equals_the_best_of_the_product():
    rnd = random.Random(4)
    some = lambda n, sure: [{"start_idx": (x := rnd.randint(0, 14)), "end_idx": x + rnd.randint(0, 5), "confidence": rnd.choice(sure), "strategy": "s"} for _ in range(n)]
    for _ in range(3000):
        starts, ends = (some(rnd.randint(0, 6), rnd.choice([[1.0], [0.96], [0.8675, 0.8674, 0.9001]])) for _ in range(2))
        middle = rnd.randint(0, 40) / 2
        mean = lambda a, z: float(Decimal(repr((a["confidence"] + z["confidence"]) / 2)).quantize(Decimal("0.0001"), ROUND_HALF_UP))
        pairs = [(-mean(a, z), abs((a["start_idx"] + z["end_idx"]) / 2 - middle), z["end_idx"] - a["start_idx"], i, j, a["start_idx"], z["end_idx"]) for i, a in enumerate(starts) for j, z in enumerate(ends) if z["end_idx"] >= a["start_idx"]]
        got = locate.best_pair(starts, ends, middle)
        assert (got is None) == (not pairs)
        if pairs:
            want = min(pairs)
            assert (got["start_idx"], got["end_idx"], got["confidence"]) == (want[5], want[6], -want[0])


def test_match_form_equals_a_walk():
    def walk(text):
        out = []
        for at, char in enumerate(text):
            for c in unicodedata.normalize("NFKC", fixed.MATCH_REPLACEMENTS.get(char, char)):
                if not c.isspace():
                    out.append((c, at))
                elif out and out[-1][0] != " ":
                    out.append((" ", at))
        if out and out[-1][0] == " ":
            out.pop()
        return "".join(c for c, _ in out), [at for _, at in out]

    rnd = random.Random(5)
    for _ in range(2000):
        text = "".join(rnd.choice("ab é…“　\n\t  ﬁ㎏①΅高𝒜") for _ in range(rnd.randint(0, 30)))
        assert locate.match_form(text) == walk(text)


def test_spans_that_keep_their_text_are_located_in_one_pass(spark):
    """The same rows as by a join with the windows, pairs of repeats included; no shuffle behind that of the files."""
    texts = [("d0", "ab " * 500), ("d1", "a" * 900), ("d2", "one\n\ntwo  three “four” " * 40), ("d3", None), ("d4", "short"), ("d5", "  \n ")]
    docs = spark.createDataFrame(texts, "document_id string, text string")
    w = segment.windows(segment.chapters(docs, keep_text=True), docs, size=400, least=100, most=600)
    kept = extraction.locate_spans(extraction.mock_spans(w, keep_text=True))
    met = extraction.locate_spans(extraction.mock_spans(w), w)
    assert kept.columns == met.columns and kept.count() > 10
    assert sorted(kept.collect()) == sorted(met.collect())
    pairs = locate.locate_anchors(w.withColumns({"start_anchor": F.lit("ab ab"), "end_anchor": F.lit("b ab")}))
    by_product = locate.best_candidate(F.col("pairs"), F.col("window_start"), F.col("window_end"))
    assert pairs.where("status = 'located'").count() and not pairs.where("status = 'located'").where(F.col("best") != by_product).count()
    plan = queries.QUERIES["locate_mock_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
