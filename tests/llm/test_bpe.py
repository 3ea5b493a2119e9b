import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from folioscope.llm import bpe

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
POOL = "aAbBeErRsSΣσİı'tsSlLdD  \n\t\r\x0b\x1c\x1d\x1f\x85\xa0   ​éÉñ漢字1²½٣<|endoftext|>!.,;😀ﬁ한\x00~`"


@pytest.mark.parametrize("name", FILES)
def test_equals_library_on_random_texts(name):
    mine, library, rnd = bpe.Tokenizer(public_tokenizers.path(name)), Library.from_file(public_tokenizers.path(name)), random.Random(1)
    library.no_truncation(), library.no_padding()
    for _ in range(800):
        text = "".join(rnd.choice(POOL) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "<|endoftext|>x"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert mine.encode(text) == ids
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", FILES)
def test_smallest_buffer_gives_the_same_tokens(name):
    tok, library, rnd = bpe.Tokenizer(public_tokenizers.path(name)), Library.from_file(public_tokenizers.path(name)), random.Random(2)
    library.no_truncation(), library.no_padding()
    tok.machine.buffer = tok.machine.lookahead + 20
    for _ in range(60):
        text = "".join(rnd.choice(["the", "in", "er", "tion", "a", "s", "ing", "re", "th", "o"]) for _ in range(rnd.randint(30, 300)))
        assert tok.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_decoding_emits_text_when_bytes_are_complete():
    tok = bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids = tok.encode("naïve 😀 ok")
    parts = list(tok.decode_stream(ids))
    assert "".join(parts) == "naïve 😀 ok" and all("�" not in p for p in parts)


def test_operator_handles_nulls_ties_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, "Hi there", 9), (2, None, 9), (3, "", 9), (1, "Hi there", 9), (None, "x", 9)], "doc_id long, text string, ids int")
    got = bpe.bpe_encode_decode(rows, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["decoded"]) for r in got) == [(-1, 1, "x"), (1, 2, "Hi there"), (1, 2, "Hi there"), (2, 0, ""), (3, 0, "")]
    assert bpe.bpe_encode_decode(rows.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_very_long_texts(spark):
    """300,000 words, and one word of 60,000 letters, as the library has them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    library, rnd = Library.from_file(path), random.Random(5)
    library.no_truncation(), library.no_padding()
    texts = [" ".join(rnd.choice(["the", "river", "ran", "éa", "12"]) for _ in range(300_000)), "".join(rnd.choice("ther") for _ in range(60_000))]
    got = {r["doc_id"]: r for r in bpe.bpe_encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), path).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k]["decoded"] == library.decode(ids, skip_special_tokens=False)
