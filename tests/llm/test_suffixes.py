import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import suffixes
from folioscope.llm.common import Scratch


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        out.append((bytes(b for b, g in zip(r, gone) if not g), sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))))
    return out


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9))) for _ in range(n))


def corpus(seed):
    rnd = random.Random(seed)
    shared = [words(rnd, 40) for _ in range(4)]
    texts = [words(rnd, rnd.randint(0, 200)) + rnd.choice(["", *shared]) + words(rnd, rnd.randint(0, 60)) for _ in range(60)]
    base = words(rnd, 150)
    texts += [base, base, base.replace("a", "b", 3), base[7:] + "x", "ab" * 300, "abab" * 120, None, "", "é" * 500]
    return texts


def test_column_wise_order_and_prefixes_equal_sorted_suffixes():
    rnd = random.Random(3)
    raws = [bytes(rnd.choice(b"ab") for _ in range(12)) for _ in range(30)]
    group = np.sort(np.array([rnd.randint(0, 3) for _ in raws]))

    class Sink(list):
        def write(self, data):
            self.append(data)

    sink = Sink()
    columns = iter([np.array([r[c] + 1 for r in raws], np.uint16) for c in range(11, -1, -1)])
    suffixes.column_wise(columns, 12, group.astype(np.uint16), sink, 100, 1)
    order, common = np.frombuffer(sink[-2], np.uint16), np.frombuffer(sink[-1], np.uint16)
    assert order.tolist() == sorted(range(30), key=lambda k: (group[k], raws[k], order.tolist().index(k)))
    for a, b, n in zip(order, order[1:], common[1:]):
        same = next((i for i in range(12) if raws[a][i] != raws[b][i]), 12) if group[a] == group[b] else 0
        assert n == same


def cut_out(text, r, j):
    raw = (text or "").encode()
    cuts = [] if r is None else list(zip(r["starts"][j], r["ends"][j]))
    return b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(raw)])), len(cuts)


@pytest.mark.parametrize("seed,large,lengths", [(1, suffixes.LARGE, (100,)), (2, 1, (100, 60)), (3, suffixes.LARGE, (100, 60))])
def test_equals_brute_force(spark, seed, large, lengths):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    keyed = docs.selectExpr("cast(id as string) id", "xxhash64(coalesce(text, '')) t", "text")
    spans = {int(r["id"]): r for r in suffixes.repeated_spans(keyed, Scratch(spark), lengths, 16, large).collect()}
    for j, length in enumerate(lengths):
        for k, expected in enumerate(brute(texts, length)):
            assert cut_out(texts[k], spans.get(k), j) == expected, (length, k)


def test_production_lengths_on_documents_and_a_very_long_text(spark):
    """400 and 240 bytes with the production grams against brute force, planted passages of 55 words among them."""
    rnd = random.Random(21)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()]
    passage, other = words(rnd, 55), words(rnd, 120)
    texts += [words(rnd, 80) + passage + words(rnd, 50), passage + words(rnd, 90), words(rnd, 30) + other, other + words(rnd, 9)]
    texts += [words(rnd, 20_000) + passage, "x" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in suffixes.deduplicated(rows, report=(240,)).selectExpr("row.doc_id doc_id", "raw", "n_spans", "covered").collect()}
    for k, (kept, n) in enumerate(brute(texts, 400)):
        assert (bytes(got[k]["raw"]), got[k]["n_spans"]) == (kept, n), k
    for k, (kept, _) in enumerate(brute(texts, 240)):
        assert got[k]["covered"] == [len((texts[k] or "").encode()) - len(kept)], k


def test_operator_with_repeated_rows_and_clashing_columns(spark):
    text = words(random.Random(9), 120)
    rows = [(1, text, "s"), (1, text, "s"), (2, "unlike " + words(random.Random(8), 90), "s"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = suffixes.deduplicated(docs).selectExpr("row.doc_id doc_id", "n_spans", "sha2(raw, 256) h", "row.id id").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r["doc_id"] or -1, r["n_spans"], r["h"] == empty) for r in got) == [(-1, 0, True), (1, 1, True), (1, 1, True), (2, 0, False)]
    assert suffixes.deduplicated(docs.limit(0)).count() == 0
