import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from folioscope.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_respects_every_limit(rule):
    rnd = random.Random(4)
    for _ in range(20):
        histogram = Counter(rnd.randint(1, 100) for _ in range(rnd.randint(0, 400)))
        limits = packing.Limits(100, 7, 6000 if rule == "dot" else 10_000, rule=rule)
        bins = packing.best_fit(dict(histogram), limits) if max(histogram, default=0) ** 2 <= limits.attention else []
        if not bins:
            continue
        placed: Counter = Counter()
        for b in bins:
            assert sum(n * k for n, k, _ in b.holds) <= limits.tokens
            assert sum(k for _, k, _ in b.holds) <= limits.documents
            assert sum(n * n * k for n, k, _ in b.holds) <= limits.attention
            for n, k, _ in b.holds:
                placed[n] += k * b.count
        assert placed == histogram


def test_tight_limits_bind():
    histogram = {10: 300, 40: 20, 100: 2}
    free = sum(b.count for b in packing.best_fit(histogram, packing.Limits(100, 100, 10_000)))
    assert free == 40
    few = packing.best_fit(histogram, packing.Limits(100, 4, 10_000))
    assert max(sum(k for _, k, _ in b.holds) for b in few) == 4 and sum(b.count for b in few) > 75
    short = packing.best_fit({10: 300, 40: 20}, packing.Limits(100, 100, 2000))
    assert max(sum(n * n * k for n, k, _ in b.holds) for b in short) <= 2000 and sum(b.count for b in short) >= 31


def test_near_the_lower_bound():
    rnd = random.Random(5)
    histogram = dict(Counter(int(rnd.expovariate(1 / 400)) % 2048 + 1 for _ in range(20_000)))
    bins = sum(b.count for b in packing.best_fit(histogram, packing.Limits()))
    assert bins <= 1.005 * -(-sum(n * c for n, c in histogram.items()) // 2048)


def test_encoder_equals_library():
    mine, library, rnd = packing.ByteEncoder(PATH), Library.from_file(PATH), random.Random(6)
    library.no_truncation(), library.no_padding()
    pool = "aAbBeE'tsSlLdD  \n\t\r\x1c\x85\xa0 éñ漢1²<|endoftext|>!.,😀"
    for _ in range(800):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "<|endoftext|> x"])
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_cover_documents_and_sequences_are_gapless(spark):
    rows = [(1, "word " * 5000, "n"), (2, None, "n"), (3, "", "n"), (4, "short text", "n"), (4, "short text", "n"), (None, "x y", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(docs, PATH).collect()
    library = Library.from_file(PATH)
    library.no_truncation(), library.no_padding()
    full = library.encode("word " * 5000, add_special_tokens=False).ids + [0]
    mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == 1)
    assert [m[0] for m in mine][0] == 0 and mine[0][1] == (len(full) % 2048 or 2048) and all(m[1] == 2048 for m in mine[1:])
    for start, length, crc in mine:
        assert crc == zlib.crc32(np.array(full[start : start + length], "<u4").tobytes())
    assert sum(r["doc_id"] == 4 for r in got) == 2 and sum(r["length"] == 1 for r in got) == 2
    for sequence in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == sequence), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_ranks_by_shuffle_or_broadcast_place_alike(spark, monkeypatch):
    rnd = random.Random(3)
    docs = spark.createDataFrame([(k, "w " * rnd.randint(0, 3000)) for k in range(200)], "doc_id long, text string").repartition(7)
    made = []
    for limit in (packing.BROADCAST_BYTES, 0):
        monkeypatch.setattr(packing, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(packing, "BROADCAST_SLOTS", limit)
        rows = packing.pack(docs, PATH, packing.Limits(documents=3)).collect()
        by = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append(r)
        for held in by.values():
            at = 0
            for r in sorted(held, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 2048 and len(held) <= 3
        made.append((len(by), len(rows)))
    assert made[0] == made[1]
