import re
from collections import defaultdict
from itertools import permutations

from folioscope.llm import audit

SCHEMA = "doc_id long, text string, lang string, part string, word string, mask int, good boolean"


def brute(docs, labels):
    said = lambda k: {d for d, *v in labels if d is not None and v[k] == 1}
    good, toxic = said(0), said(1)
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    parts = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        parts[lang or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                failing = sum(f in r[0] for r in rows)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels):
    frame = spark.createDataFrame([(*d, "x", "y", 1, True) for d in docs], SCHEMA).repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in audit.audit(frame, said).collect()}
    assert got == brute(docs, labels)


def test_equals_a_loop_over_all_orders(spark):
    long, varied = "Aa bb " * 150, " ".join(f"w{k}" for k in range(210))
    docs = [
        (1, varied, "en"), (2, varied, "de"), (3, varied, "en"), (4, long, "en"), (5, long, None), (6, None, "en"), (7, "", ""), (8, " \t\n\x0b\x0c\r ", "en"),
        (9, "ABC #", "de"), (10, varied + " |", "de"), (11, "é" * 50 + "A", "fr"), (12, "a b c　d \x1f e", "fr"), (None, varied, "en"), (None, None, None), (13, "$" + long, "en"), (14, "  lead and trail  ", "en"),
    ]
    labels = [(1, 1, 0), (3, 1, 1), (3, 1, 1), (4, 0, 1), (9, 1, None), (9, None, 1), (None, 1, 1), (99, 1, 1), (6, 0, 0)]
    check(spark, docs, labels)


def test_repeated_rows_and_copies_are_counted_each(spark):
    """Rows of one id and text, of one id and other texts, and many copies of one text."""
    docs = [(1, "a b a", "en")] * 3 + [(1, "c", "en"), (2, "x y " * 120, "en"), (2, "x y " * 120, "en")] + [(k, "a b a", "de") for k in range(20, 90)]
    check(spark, docs, [(1, 1, 1), (30, 1, 0)])


def test_very_long_text_and_empty_tables(spark):
    check(spark, [(1, "word " * 300_000 + "%", "en"), (2, "x" * 1_000_000, "en")], [])
    empty = spark.createDataFrame([], SCHEMA)
    assert audit.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
