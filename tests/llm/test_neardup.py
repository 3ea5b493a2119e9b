import random

import numpy as np
import pytest
import xxhash

from folioscope.llm import neardup


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_equals_the_full_table():
    rnd = random.Random(3)
    for _ in range(3000):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 25))]
        b = [x for x in a if rnd.random() > 0.1]
        for _ in range(rnd.randint(0, 4)):
            b.insert(rnd.randint(0, len(b)), rnd.randint(0, 4))
        most = rnd.randint(0, 12)
        assert neardup.banded_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def variant(rnd, words, share):
    return " ".join(w if rnd.random() > share else "".join(rnd.choice("xyz") for _ in range(6)) for w in words)


def test_classes_equal_brute_force(spark):
    rnd = random.Random(5)
    bases = [["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(rnd.randint(60, 160))] for _ in range(15)]
    texts = [variant(rnd, b, s) for b in bases for s in (0, 0, 0.02, 0.05, 0.08)] + ["", None, "one", "one", "two words"]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, class_id string").repartition(3)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs).collect()}
    split = [neardup.words_of(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if split[a] and split[b] and neardup.edit_similarity(split[a], split[b], 0.8) > 0:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {k: r["class_id"] for k, r in got.items()} == {k: find(k) for k in range(len(texts))}
    kept = sorted(r["doc_id"] for r in neardup.keep_one(docs).select("doc_id").collect())
    assert kept == [k for k in range(len(texts)) if find(k) == k]


def test_order_counts():
    words = [f"w{k}" for k in range(100)]
    assert neardup.edit_similarity(words, words[50:] + words[:50], 0.8) == 0


def test_nulls_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1) for r in got) == [(-1, -1), (1, 1), (1, 1), (2, 2)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_shared_passage_hides_no_pair(spark):
    """Most sketches fall into one passage of all documents: every pair of an equal sketch is still tried."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(60):
        own = [word() for _ in range(40)]
        texts += [" ".join(passage + own), " ".join(passage + [word() if k % 2 else w for k, w in enumerate(own)])]
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()}
    split = [neardup.words_of(t) for t in texts]
    hashes = [np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)) for w in split]
    sketches = [neardup.order_minhash(neardup.labelled_grams(h)) for h in hashes]
    bags = [neardup.word_bits(neardup.labelled_grams(h, 1)) for h in hashes]
    tried = 0
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            near = np.bitwise_count(bags[a] ^ bags[b]).sum() <= neardup.most_apart(0.8)
            if near and (sketches[a] == sketches[b]).any() and neardup.edit_similarity(split[a], split[b], 0.8) > 0:
                tried += 1
                assert got[a] == got[b]
    assert tried >= 50


def test_keep_one_of_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "x"), (1, text, "x"), (None, "a b c", "y"), (None, "a b c", "z"), (None, None, "n"), (7, text + " more", "q"), (8, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = sorted(((r["doc_id"] or -1, r["text"] or "") for r in neardup.keep_one(docs).collect()))
    assert kept == [(-1, ""), (-1, "a b c"), (1, text), (8, "")]
    assert neardup.keep_one(docs).columns == docs.columns
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_ids_have_to_be_integers(spark):
    docs = spark.createDataFrame([("a", "x y")], "doc_id string, text string")
    with pytest.raises(TypeError):
        neardup.near_duplicates(docs)


def test_very_long_texts_meet(spark):
    rnd = random.Random(2)
    words = [f"w{rnd.randint(0, 5000)}" for _ in range(25_000)]
    other = list(words)
    for k in range(0, 25_000, 20):
        other[k] = "x"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_recall_with_and_without_the_word_bound():
    """Of pairs with one word in ten replaced, nearly all share a sketch, and the bound takes none of them away."""
    rnd = random.Random(9)
    shared = bounded = 0
    for _ in range(300):
        a = [f"w{rnd.randint(0, 900)}" for _ in range(rnd.randint(60, 400))]
        b = [w if rnd.random() > 0.1 else "zz" + w for w in a]
        ha, hb = (np.fromiter((xxhash.xxh3_64_intdigest(w) for w in x), np.uint64, len(x)) for x in (a, b))
        found = (neardup.order_minhash(neardup.labelled_grams(ha)) == neardup.order_minhash(neardup.labelled_grams(hb))).any()
        apart = np.bitwise_count(neardup.word_bits(neardup.labelled_grams(ha, 1)) ^ neardup.word_bits(neardup.labelled_grams(hb, 1))).sum()
        assert found <= (neardup.most_apart(0.8, 1.0, None) >= apart)
        shared += found
        bounded += found and apart <= neardup.most_apart(0.8)
    assert shared >= 295 and bounded >= shared - 1


def test_bits_estimate_the_word_sets_similarity():
    rnd = random.Random(4)
    for share in (0.2, 0.5, 0.8):
        apart = []
        for _ in range(40):
            common = [f"c{rnd.random()}" for _ in range(int(300 * share))]
            ha, hb = (np.fromiter((xxhash.xxh3_64_intdigest(w) for w in common + [f"{k}{rnd.random()}" for _ in range(300 - len(common))]), np.uint64, 300) for k in "ab")
            apart.append(np.bitwise_count(neardup.word_bits(ha) ^ neardup.word_bits(hb)).sum() / neardup.BITS)
        jaccard = int(300 * share) / (600 - int(300 * share))
        assert abs(np.mean(apart) - (1 - jaccard) / 2) < 0.015


def test_entries_stay_if_any_other_keeps_the_bounds():
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = 80
        keys, docs = rng.integers(0, 6, n).astype(np.uint64), rng.integers(0, 60, n)
        size_of = rng.integers(50, 90, 60)
        bits_of = rng.integers(0, 1 << 62, (60, neardup.BITS // 64)).astype(np.uint64)
        bits_of[30:45] = bits_of[0] ^ rng.integers(0, 4, (15, neardup.BITS // 64)).astype(np.uint64)
        sizes, bits = size_of[docs], bits_of[docs]
        expected = []
        for i in range(n):
            for j in range(n):
                low, high = min(sizes[i], sizes[j]), max(sizes[i], sizes[j])
                if keys[i] == keys[j] and docs[i] != docs[j] and low >= 0.8 * high and np.bitwise_count(bits[i] ^ bits[j]).sum() <= neardup.most_apart(0.8, low / high):
                    expected.append(i)
                    break
        assert neardup.partnered(keys, docs, sizes, bits, 0.8, neardup.FAR).tolist() == expected
