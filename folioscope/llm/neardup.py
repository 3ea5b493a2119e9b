"""Near duplicates by Order MinHash, verified by banded alignment.

A document is the sequence of its words' SHINGLE-grams, each labelled with its occurrence number. One sketch of
Order MinHash takes the ELL labelled grams of least hash and keeps them in text order, so that two documents
share it with a probability that follows their edit similarity. Links stand if a banded bit-parallel alignment of
the words finds an edit similarity of at least `similarity`; classes are the connected components.

Documents with an equal sketch are tried in three rounds. The first tries them with the smallest id among them:
within each chunk of documents, at once, and then among the chunks' smallest. The second tries the smallest of each
class so far with each other; these two connect the large classes by few links. The third tries every pair that is
still unconnected, so each pair that has a sketch in common and keeps the bounds below is either aligned or connected
already, whatever passages its documents share with others. After the first round a document stays under a sketch only
if another one there keeps the bounds with it, and a sketch only while its documents lie in two or more classes; so
neither a group of copies nor documents that merely share a passage go on, however many they are.

Two bounds keep pairs that merely share a passage from being aligned. Lengths may differ by the similarity at
most. And two texts of similarity s share s of the longer's words, so if the shorter has r times as many words, their
word sets' Jaccard similarity is at least s / (1 + r - s); BITS one-bit minima estimate it, and pairs that lie `far`
standard deviations below go, which at the very threshold is one in some thousands. `far=None` turns this bound off.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, even_labels, key_text

SHINGLE, ELL, SKETCHES, SIMILARITY = 5, 2, 64, 0.8
BITS, FAR = 512, 3.5
#: Sketch entries that one task holds at once; the number of buckets follows the number of documents.
BUCKET_ENTRIES, LIVE_ENTRIES = 300_000, 20_000
CHUNK, CHUNK_WORDS = 4096, 4_000_000
_rng = np.random.default_rng(20240229)
XOR = _rng.integers(0, 1 << 63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
MUL = _rng.integers(0, 1 << 63, SKETCHES, np.uint64) * np.uint64(2) + np.uint64(1)
BAG_XOR = _rng.integers(0, 1 << 32, BITS, np.uint32)
BAG_MUL = _rng.integers(0, 1 << 31, BITS, np.uint32) * np.uint32(2) + np.uint32(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if isinstance(text, str) else []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * STEP
    return h ^ (h >> np.uint64(29))


def labelled_grams(hashes: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the word grams in text order, repeated ones told apart by their occurrence number."""
    with np.errstate(over="ignore"):
        k = min(shingle, len(hashes))
        n = len(hashes) - k + 1
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = _mix(h * STEP + hashes[i : i + n])
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        if not new.all():
            first = np.flatnonzero(new)
            nth = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
            label = np.empty(n, np.uint64)
            label[order] = nth
            h = np.where(label > 0, _mix(h + label * STEP), h)
    return h


def order_minhash(grams: np.ndarray) -> np.ndarray:
    """One key a sketch: its ELL least grams, hashed in text order together with the sketch's number."""
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, min(SKETCHES, 2_000_000 // max(1, len(grams))))
    with np.errstate(over="ignore"):
        for at in range(0, SKETCHES, step):
            v = (grams[None, :] ^ XOR[at : at + step, None]) * MUL[at : at + step, None]
            rows = np.arange(len(v))
            places = []
            for _ in range(min(ELL, len(grams))):
                least = v.argmin(1)
                places.append(least)
                v[rows, least] = ~np.uint64(0)
            h = XOR[at : at + step].copy()
            for p in np.sort(np.stack(places), 0):
                h = _mix(h * STEP + grams[p])
            out[at : at + step] = h
    return out


def word_bits(words: np.ndarray) -> np.ndarray:
    """One bit of each of BITS minimum hashes over a document's labelled words, packed into 64-bit numbers."""
    bits = np.empty(BITS, np.uint8)
    w = (words >> np.uint64(32)).astype(np.uint32)
    step = max(1, min(BITS, 500_000 // max(1, len(w))))
    with np.errstate(over="ignore"):
        for at in range(0, BITS, step):
            least = ((w[None, :] ^ BAG_XOR[at : at + step, None]) * BAG_MUL[at : at + step, None]).min(1)
            bits[at : at + step] = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(31)
    return np.packbits(bits).view(np.uint64)


def most_apart(least: float, ratio=1.0, far: float | None = FAR):
    """Differing bits beyond which the word sets of two documents, the shorter `ratio` times the longer, are too unlike."""
    if far is None:
        return np.full(np.shape(ratio), BITS)
    differ = (1 - least / (1 + np.maximum(ratio, least) - least)) / 2
    return np.floor(BITS * differ + far * (BITS * differ * (1 - differ)) ** 0.5).astype(int)


def _stars(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, bits: np.ndarray, least: float, far: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by (key, doc): pairs of entries (smallest of the key, member) that the bounds allow; heads' places."""
    order = np.lexsort((docs, keys))
    keys, d, n = keys[order], docs[order], sizes[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    head = np.repeat(first, np.diff(np.append(first, len(keys))))
    at = np.flatnonzero((d[head] != d) & (np.minimum(n, n[head]) >= least * np.maximum(n, n[head])))
    a, b = order[head[at]], order[at]
    near = np.bitwise_count(bits[a] ^ bits[b]).sum(1) <= most_apart(least, np.minimum(sizes[a], sizes[b]) / np.maximum(sizes[a], sizes[b]), far)
    a, b = a[near], b[near]
    _, one = np.unique(np.stack((docs[a], docs[b]), 1), axis=0, return_index=True)
    return np.stack((a[one], b[one]), 1), order[first]


def _linked(pairs: np.ndarray, ids: list[int], words: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Of pairs of places, those that align, as ids; pairs that are connected by then are passed over."""
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in pairs.tolist():
        if find(a) != find(b) and edit_similarity(words[a].tolist(), words[b].tolist(), least) > 0:
            root[find(a)] = find(b)
            out.append((ids[a], ids[b]))
    return out


_SKETCHED = "kind string, bucket int, id long, copy1 long, copy2 long, n int, a binary, b binary, c binary, d binary"


def sketched(docs: DataFrame, labels: list[int], least: float, far: float | None) -> DataFrame:
    """One pass over the texts.

    Kind `doc`: a row a document, with its text's hash, number of words and bits (a). `links`: pairs aligned inside a
    chunk. `heads` and `members`, by bucket: sketches (a), their documents (b), these documents' sizes (c) and bits (d),
    bits once for each document; heads are the smallest of a sketch in the chunk.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = _SKETCHED.replace(",", "").split()[::2]
        seen: dict[tuple[int, int], int] = {}
        keys, ids, bags, split, rows, held = [], [], [], [], [], 0

        def flush() -> pd.DataFrame:
            out = [("doc", 0, doc, *copy, len(split[k]), bags[k].tobytes(), None, None, None) if copy else ("doc", 0, doc, *[None] * 7) for doc, copy, k in rows]
            if keys:
                place = np.repeat(np.arange(len(ids)), SKETCHES)
                k, d, n = np.concatenate(keys), np.array(ids, np.int64)[place], np.array([len(w) for w in split], np.int32)[place]
                bits = np.stack(bags)
                pairs, heads = _stars(k, d, n, bits[place], least, far)
                links = np.array(_linked(place[pairs], ids, split, least), np.int64).reshape(-1, 2)
                out.append(("links", 0, None, None, None, None, links[:, 0].tobytes(), links[:, 1].tobytes(), None, None))
                for kind, these in (("heads", heads), ("members", np.setdiff1d(np.arange(len(k)), heads))):
                    bucket = _bucket(k[these], len(labels))
                    order = np.argsort(bucket, kind="stable")
                    cuts = np.searchsorted(bucket[order], np.arange(len(labels) + 1))
                    for b in np.flatnonzero(np.diff(cuts)).tolist():
                        at = these[order[cuts[b] : cuts[b + 1]]]
                        _, of = np.unique(d[at], return_index=True)  # a document's bits travel once a bucket
                        out.append((kind, labels[b], None, None, None, None, k[at].tobytes(), d[at].tobytes(), n[at].tobytes(), bits[place[at[of]]].tobytes()))
            seen.clear(), keys.clear(), ids.clear(), bags.clear(), split.clear(), rows.clear()
            return pd.DataFrame(out, columns=names, dtype=object)

        for pdf in batches:
            for doc, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], strict=True):
                doc, words = int(doc), words_of(text)
                if not words:
                    rows.append((doc, None, 0))
                    continue
                digest = xxhash.xxh3_128_digest(text.encode("utf-8", "replace"))
                copy = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                rows.append((doc, copy, seen.setdefault(copy, len(ids))))
                if seen[copy] < len(ids):
                    continue
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
                keys.append(order_minhash(labelled_grams(hashes)))
                bags.append(word_bits(labelled_grams(hashes, 1)))
                ids.append(doc), split.append(hashes)
                held += len(words)
                if len(ids) >= CHUNK or held >= CHUNK_WORDS:
                    yield flush()
                    held = 0
        yield flush()

    return docs.select(key_text("id"), "text").mapInPandas(run, _SKETCHED)


def _unfold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            yield pd.DataFrame({"a": np.frombuffer(a, np.int64), "b": np.frombuffer(b, np.int64)})


def inside(sketches: DataFrame) -> DataFrame:
    """Links (a, b) that were found and aligned inside chunks."""
    return sketches.where(F.col("kind") == "links").select("a", "b").mapInPandas(_unfold, "a long, b long")


def _near(sizes: np.ndarray, bits: np.ndarray, a, b, least: float, far: float | None) -> np.ndarray:
    """Which pairs of places keep the bounds."""
    low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    fits = low >= least * high
    return fits & (np.bitwise_count(bits[a] ^ bits[b]).sum(-1) <= most_apart(least, low / high, far))


def partnered(keys: np.ndarray, docs: np.ndarray, sizes: np.ndarray, bits: np.ndarray, least: float, far: float | None) -> np.ndarray:
    """Places of the entries that have another document under their key with which they keep the bounds."""
    order = np.lexsort((docs, sizes, keys))
    keys, docs, sizes, bits = keys[order], docs[order], sizes[order], bits[order]
    hit = np.zeros(len(keys), bool)
    for shift in (1, 2, 3):  # most find one beside them
        a = np.flatnonzero((keys[shift:] == keys[: len(keys) - shift]) & (docs[shift:] != docs[: len(keys) - shift]))
        a = a[~(hit[a] & hit[a + shift])]
        a = a[_near(sizes, bits, a, a + shift, least, far)]
        hit[a] = hit[a + shift] = True
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    end = np.append(first[1:], len(keys))
    for i, j in zip(first[end - first > 4].tolist(), end[end - first > 4].tolist()):
        n = sizes[i:j]
        for at in (np.flatnonzero(~hit[i:j]) + i).tolist():
            if not hit[at]:
                low, high = i + np.searchsorted(n, sizes[at] * least - 1e-6), i + np.searchsorted(n, sizes[at] / least + 1e-6, "right")
                others = np.arange(low, high)
                others = others[(docs[low:high] != docs[at])]
                others = others[_near(sizes, bits, others, at, least, far)]
                if len(others):
                    hit[others] = hit[at] = True
    return np.sort(order[hit])


def met(sketches: DataFrame, buckets: int, least: float, far: float | None) -> DataFrame:
    """The first round across chunks: (pair, a, b).

    Rows with `pair` are pairs of documents in different chunks, one the smallest of a sketch that both have; the
    others are entries (sketch a, document b) that keep the bounds with another document of the sketch.
    """

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("kind", kind="stable")  # heads first
        keys, docs, sizes = (np.concatenate([np.frombuffer(x, kind) for x in pdf[c]]) for c, kind in (("a", np.uint64), ("b", np.int64), ("c", np.int32)))
        bits = []
        for b, d in zip(pdf["b"], pdf["d"], strict=True):
            _, of = np.unique(np.frombuffer(b, np.int64), return_inverse=True)
            bits.append(np.frombuffer(d, np.uint64).reshape(-1, BITS // 64)[of])
        bits = np.concatenate(bits)
        heads = sum(len(x) for x in pdf.loc[pdf["kind"] == "heads", "b"]) // 8
        pairs, _ = _stars(keys[:heads], docs[:heads], sizes[:heads], bits[:heads], least, far)
        _, of, times = np.unique(keys, return_inverse=True, return_counts=True)
        many = np.flatnonzero(times[of] > 1)
        live = many[partnered(keys[many], docs[many], sizes[many], bits[many], least, far)]
        a, b = np.concatenate((docs[pairs[:, 0]], keys[live].view(np.int64))), np.concatenate((docs[pairs[:, 1]], docs[live]))
        return pd.DataFrame({"pair": np.arange(len(a)) < len(pairs), "a": a, "b": b})

    entries = sketches.where(F.col("kind").isin("heads", "members")).select("kind", "bucket", "a", "b", "c", "d")
    return entries.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meet, "pair boolean, a long, b long")


def contested(live: DataFrame, labels: DataFrame, firsts: DataFrame) -> DataFrame:
    """Entries (key, doc, label) of sketches whose documents bear two or more labels.

    `live` has (key, doc). `labels` has (id, label) of the documents that are linked, `firsts` (id, first) of copies:
    the first of a text's copies stands for all of them, and a document without a label bears its own id.
    """
    named = labels.join(firsts, "id", "left").select(F.col("id").alias("doc"), "label", F.coalesce("first", "id").alias("first"))
    each = live.join(named.hint("merge"), "doc", "left").select("key", F.coalesce("first", "doc").alias("doc"), F.coalesce("label", "doc").alias("label"))
    mixed = each.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return each.join(mixed.hint("merge"), "key", "left_semi").distinct()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _owner(a: int, b: int, shared: np.ndarray) -> np.uint64:
    """Of the sketches that a pair shares, the one under which it is aligned: pairs of a group are spread over them."""
    return shared[((min(a, b) * 0x9E3779B97F4A7C15 ^ max(a, b) * 0xC2B2AE3D27D4EB4F) >> 20) % len(shared)]


def _late_links(buckets: int, least: float, far: float | None):
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        this, ids = int(pdf["bucket"].iloc[0]), pdf["doc"].to_numpy(np.int64)
        sketches = [np.frombuffer(k, np.uint64) for k in pdf["keys"]]
        words = [np.frombuffer(w, np.uint64) for w in pdf["words"]]
        bags = [np.sort(labelled_grams(w, 1)) for w in words]
        bits = np.stack([word_bits(g) for g in bags])
        sizes = np.array([len(w) for w in words], np.int64)
        _, label = np.unique(pdf["label"].to_numpy(np.int64), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), [len(k) for k in sketches])
        keys = np.concatenate(sketches)
        mine = _bucket(keys, buckets) == this
        keys, owner = keys[mine], owner[mine]
        order = np.lexsort((ids[owner], sizes[owner], keys))
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        found = []
        for i, j in zip(first.tolist(), np.append(first[1:], len(keys)).tolist()):
            at = owner[i:j]
            n = sizes[at]
            for h, stop in enumerate(np.searchsorted(n, n / least + 1e-6, "right").tolist()):  # n rises
                a, rest = at[h], at[h + 1 : stop]
                rest = rest[label[rest] != label[a]]
                rest = rest[_near(sizes, bits, rest, a, least, far)]
                for b in rest.tolist():
                    if label[a] == label[b] or _owner(int(ids[a]), int(ids[b]), np.intersect1d(sketches[a], sketches[b], True)) != keys[i]:
                        continue
                    longer = int(max(sizes[a], sizes[b]))
                    most = int((1 - least) * longer + 1e-9)
                    if longer - len(np.intersect1d(bags[a], bags[b], True)) <= most and banded_distance(words[a].tolist(), words[b].tolist(), most) <= most:
                        found.append((ids[a], ids[b]))
                        label[label == label[b]] = label[a]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return meet


def late_links(entries: DataFrame, docs: DataFrame, least: float, far: float | None) -> DataFrame:
    """Links (a, b) between stored entries (key, doc, label) of one sketch and different labels; `docs` has (id, text).

    Every such pair that keeps the bounds is aligned once, unless links found before it in its bucket connect it.
    """
    buckets = max(8, entries.count() // LIVE_ENTRIES)
    mine = entries.groupBy("doc").agg(F.min("label").alias("label"), F.sort_array(F.collect_list("key")).alias("keys"))
    held = docs.select(F.col("id").alias("doc"), "text").join(mine.hint("merge"), "doc").dropDuplicates(["doc"])

    def deal(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, label, keys in zip(pdf["doc"], pdf["text"], pdf["label"], pdf["keys"], strict=True):
                keys, words = np.asarray(keys, np.int64).view(np.uint64), words_of(text)
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).tobytes()
                rows += [(int(b), doc, label, hashes, keys.tobytes()) for b in np.unique(_bucket(keys, buckets))]
            yield pd.DataFrame(rows, columns=["bucket", "doc", "label", "words", "keys"])

    dealt = held.mapInPandas(deal, "bucket int, doc long, label long, words binary, keys binary")
    return dealt.groupBy("bucket").applyInPandas(_late_links(buckets, least, far), "a long, b long")


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences if at most `most`, else most + 1: bit vectors along a band of 2 most + 1 diagonals."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    start = 0
    while start < len(b) and a[start] == b[start]:
        start += 1
    end = 0
    while end < len(b) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not b:
        return len(a) if len(a) <= most else most + 1
    limit, k = most, min(most, len(a))
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (2 * k)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    vp, vn, distance, level = full ^ ((1 << k) - 1), 0, k, top >> 1
    for j, x in enumerate(b):
        p = places.get(x, 0)
        p = ((p >> (j - k)) if j >= k else (p << (k - j))) & full
        d0 = ((((p & vp) + vp) ^ vp) | p | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j < len(a) - k:
            distance += not d0 & top
        else:
            distance += bool(hp & level) - bool(hn & level)
            level >>= 1
        d0 >>= 1
        vp = (hn | ~(d0 | hp)) & full
        vn = d0 & hp
    return distance if distance <= limit else limit + 1


def edit_similarity(a: list, b: list, least: float) -> float:
    """1 - distance / longer length; 0 if below `least`."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if longer - sum((Counter(a) & Counter(b)).values()) > most:  # each word without a partner costs an edit
        return 0.0
    d = banded_distance(a, b, most)
    return 1 - d / longer if d <= most else 0.0


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose words align well enough."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sims = [edit_similarity(words_of(x), words_of(y), least) for x, y in zip(pdf["text_a"], pdf["text_b"], strict=True)]
            out = pdf[["a", "b"]].assign(similarity=np.array(sims, float))
            yield out[out["similarity"] > 0]

    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    both = right.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, similarity double")


def aligned(docs: DataFrame, pairs: DataFrame, least: float, scratch: Scratch, name: str) -> DataFrame:
    """verified() of stored pairs, with the texts of their documents stored under `name`."""
    needed = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = scratch.write(name, docs.join(needed.hint("merge"), "id", "left_semi").dropDuplicates(["id"]))
    return verified(pairs, texts, least)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, class_id) of every linked id: the smallest id of its component, by least labels and pointer jumping."""
    both = scratch.write("both", links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")))
    labels = scratch.write("labels0", both.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("l")))
    turn = 0
    while True:
        turn += 1
        heard = both.join(labels, "x").groupBy("y").agg(F.min("l").alias("m")).withColumnRenamed("y", "x")
        lower = labels.join(heard, "x", "left").select("x", F.least("l", F.coalesce("m", "l")).alias("l2"), "l")
        above = labels.select(F.col("x").alias("l2"), F.col("l").alias("l3"))
        new = lower.join(above, "l2", "left").select("x", F.least("l2", F.coalesce("l3", "l2")).alias("l"), F.col("l").alias("old"))
        now = scratch.write(f"labels{turn}", new)
        changed = now.where(F.col("l") != F.col("old")).limit(1).count()
        scratch.drop(f"labels{turn - 1}")
        labels = now.select("x", "l")
        if not changed:
            scratch.drop("both")
            return labels.toDF("id", "class_id")


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """`labels` (id, label: the least id of a class) after further links (a, b)."""
    between = links
    for end in ("a", "b"):
        between = between.join(labels.select(F.col("id").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    above = components(between.select("a", "b"), scratch).select(F.col("id").alias("label"), F.col("class_id").alias("higher"))
    lone = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))
    return labels.unionByName(lone).join(above, "label", "left").select("id", F.coalesce("higher", "label").alias("label"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", far: float | None = FAR) -> DataFrame:
    """(id, class_id): each document's class, which is the smallest id in it.

    Equal texts are one text: copies are linked to their smallest id, and never compared. Null texts and texts
    without words are alone, as are rows with a null id, whose class is null. Ids are integers (TypeError if not);
    rows with one id are one document, and come back as often as they stand. Texts may have any length. An empty
    table gives no rows.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} has to be an integer column")
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = rows.where(F.col("id").isNotNull())
    buckets = max(8, known.count() * SKETCHES // BUCKET_ENTRIES)
    sketches = scratch.write("sketches", sketched(known, even_labels(docs.sparkSession, buckets), similarity, far))
    each = sketches.where((F.col("kind") == "doc") & F.col("copy1").isNotNull())
    first = each.groupBy("copy1", "copy2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    copies = scratch.write("copies", each.select("id", "copy1", "copy2").join(first, ["copy1", "copy2"]).where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())
    round1 = scratch.write("met", met(sketches, buckets, similarity, far))
    found = round1.where("pair").select("a", "b").distinct()
    for end in ("a", "b"):  # a copy's pairs are those of its first
        found = found.join(copies.select(F.col("b").alias(end), F.col("a").alias("first")), end, "left").withColumn(end, F.coalesce("first", end)).drop("first")
    found = found.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = scratch.write("pairs", found)
    links = scratch.write("links", aligned(known, pairs, similarity, scratch, "texts"))
    scratch.drop("texts")
    joined = scratch.write("joined", links.select("a", "b").union(inside(sketches)).union(copies))
    labels = scratch.write("labels", components(joined, scratch).withColumnRenamed("class_id", "label"))
    firsts = copies.select(F.col("b").alias("id"), F.col("a").alias("first"))
    live = round1.where("not pair").select(F.col("a").alias("key"), F.col("b").alias("doc"))
    for turn in ("heads", "all"):
        entries = scratch.write(f"live_{turn}", contested(live, labels, firsts))
        live = entries.select("key", "doc")
        if turn == "heads":
            entries = scratch.write("few", entries.groupBy("key", "label").agg(F.min("doc").alias("doc")))
        more = scratch.write(f"more_{turn}", late_links(entries, known, similarity, far))
        if more.limit(1).count():
            labels = scratch.write(f"labels_{turn}", merged(labels, more, scratch))
    scratch.drop("pairs", "sketches", "met", "live_heads", "live_all", "few")
    out = rows.select("id").join(labels, "id", "left")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.coalesce("label", "id").alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class stays, the one with the smallest id; all columns stay.

    Rows with one id are one document, of which the row that compares least stays. A row with a null id goes by a
    hash of its text as its id. Null texts and texts without words are alone in their class. Columns may have any
    name; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    own = F.coalesce(docs[id_col].cast("long"), F.xxhash64(F.lit("no id"), docs[text_col]))
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), own.alias("id"), docs[text_col].alias("text"))
    judged = near_duplicates(keyed, similarity, "id", "text").where(F.col("id") == F.col("class_id"))
    stays = scratch.write("stays", judged.groupBy("id").agg(F.count(F.lit(1)).alias("times")))
    left = keyed.join(stays, "id")
    if stays.where("times > 1").limit(1).count():
        once = left.where("times > 1").groupBy("id").agg(F.min_by("row", F.struct(F.xxhash64("row"), "text")).alias("row"))
        left = left.where("times = 1").select("row").union(once.select("row"))
    return left.select("row.*")
