import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from folioscope.llm import align
from folioscope.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """By whole texts with the two libraries; groups and links by loops."""
    ta, tb, back = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), {c: b for b, c in byte_alphabet().items()}
    ta.encode_special_tokens = True
    docs, held = [], Counter()
    for doc_id, text in rows:
        a = ta.encode(" " + text, add_special_tokens=False).ids if text else []
        b = tb.encode(text) if text else []
        raw_a = [bytes(back[c] for c in ta.id_to_token(i)) for i in a]
        raw_b = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            a, b = [], []
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        start_i, start_j = 0, 0
        while i < len(a):
            if at_a <= at_b:
                at_a += len(raw_a[i])
                i += 1
            else:
                at_b += len(raw_b[j])
                j += 1
            while at_b < at_a:
                at_b += len(raw_b[j])
                j += 1
            if at_a == at_b:
                groups.append((a[start_i:i], b[start_j:j]))
                start_i, start_j = i, j
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(links.keys())
        text_of = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if a else ""))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return sorted(((d, na, nb, g, sum(ls.values()), sum(c for (x, y), c in ls.items() if held[x, y] == top[x]), sum(c * held[p] for p, c in ls.items()), sha) for d, na, nb, g, ls, sha in docs), key=repr)


def run(spark, rows, partitions=3):
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, part string, n long, pairs string").repartition(partitions)
    out = align.align(frame, A, B)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.columns == columns
    return sorted((tuple(r) for r in out.collect()), key=repr)


def texts():
    rnd = random.Random(3)
    odd = ["<|endoftext|>", "</s>", "<0x41>", "\t", "\r\n", "  ", "\n\n", " \t ", "\x1c", "\xa0", "　", "é", "漢字", "🙂", "don't", "1234567", "ﬁ", "a;\rb", "x y", "\x00", "...", "=" * 70, " ", "\n", "Straße"]
    out = ["Hello world, tokenizers differ.\nSecond line  here.", "", None, "a▁b", " ", "\n", "   lead and trail   ", "</s>[INST] ok", "\t\tindented", "x" * 5000, "the the the"]
    return out + ["".join(rnd.choice(odd + ["word", " some", " pseudonym", "ization "]) for _ in range(rnd.randint(1, 60))) for _ in range(150)]


def test_equals_whole_text_encodings_and_loops(spark, monkeypatch):
    monkeypatch.setattr(align, "PART", 700)  # many parts, some of one document
    rows = list(enumerate(texts()))
    rows += [(1000 + k, f"{t} ") for k, t in rows[:40] if t]  # a lone space behind a word
    rows += [rows[0], rows[0], (None, "no id at all"), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_copies_of_one_text_and_a_very_long_one(spark):
    rows = [(k, "copies of one text, by the hundred") for k in range(200)] + [(500, "long text about tokens " * 40_000), (501, "中文没有空格" * 20_000)]
    assert run(spark, rows) == brute(rows)


def test_wide_groups_are_counted_with_weights(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(texts()) if t]
    want = brute(rows)
    monkeypatch.setattr(align, "WIDE", 1)
    tokenizers, aligner = align.loaded(A, B)
    part = align.Part(0, tokenizers)
    for r in rows:
        part.add(*r)
    got = {r.id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for f in part.rows(aligner) for r in f.itertuples() if r.chunks is not None}
    assert got == {w[0]: (*w[1:5], w[7]) for w in want}


def test_no_rows_and_rows_without_tokens(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, ""), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
