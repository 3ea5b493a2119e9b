import random
from collections import Counter

import corpus_pipeline
from folioscope.llm import neardup, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_act_on_their_input(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = before = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert before.columns == COLUMNS
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in kept.items()}
    assert ids["quality_rules"] == {r["doc_id"] for r in quality.judged(docs).where("kept").select("row.doc_id").collect()}
    assert ids["language_id"] <= ids["quality_rules"] and len(ids["language_id"]) > 0.98 * len(ids["quality_rules"])
    classes = neardup.near_duplicates(kept["language_id"]).collect()
    assert ids["near_duplicates"] == {r["doc_id"] for r in classes if r["doc_id"] == r["class_id"]}
    assert ids["repeated_strings"] == ids["near_duplicates"] == ids["best_fit_packing"]
    before_cut = {r["doc_id"]: r["text"].encode() for r in kept["near_duplicates"].collect()}
    length = corpus_pipeline.PASSAGE
    seen = Counter(t[k : k + length] for t in before_cut.values() for k in range(len(t) - length + 1))
    for r in kept["repeated_strings"].collect():
        t = before_cut[r["doc_id"]]
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        assert r["text"] == bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore"), r["doc_id"]
    assert all(r["n_chars"] == len(r["text"]) for r in kept["repeated_strings"].collect())


def test_null_columns(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, 0), (None, "few words", None, "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "")
        assert (got.columns == COLUMNS) == (name != "best_fit_packing")
        got.count()


def test_planted_passages_go_and_other_texts_stay(spark):
    """A passage of 55 words in three documents goes from all; shared lines of 20 words and the rest stay."""
    rnd = random.Random(4)
    prose = lambda n: " ".join("".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    passage, line = prose(55), prose(20)
    assert corpus_pipeline.PASSAGE < len(passage)
    texts = [prose(80) + " " + passage + " " + prose(60) for _ in range(3)] + [prose(70) + " " + line + " " + prose(70) for _ in range(3)] + [prose(150), None, ""]
    rows = [(k, t, "en", "s", len(t or ""), 1, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, raw int, row string")
    got = {r["doc_id"]: r for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    for k in range(3):
        assert passage[5:-5] not in got[k]["text"] and texts[k][:200] in got[k]["text"] and len(got[k]["text"]) >= len(texts[k]) - len(passage) - 8
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert [got[k]["text"] for k in range(3, 9)] == texts[3:]


def test_empty_and_repeated_rows_in_every_stage(spark):
    prose = " ".join(f"the river ran {k} over stones and nobody saw it" for k in range(30))
    rows = [(1, prose, "en", "s", 5), (1, prose, "en", "s", 5), (2, prose + " indeed", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    expected = {"quality_rules": (0, 3), "language_id": (0, 3), "near_duplicates": (1, 1), "repeated_strings": (3, 3)}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0
        if name in expected:
            low, high = expected[name]
            assert low <= stage(spark, docs, "").count() <= high, name
        else:
            assert {r["doc_id"] for r in stage(spark, docs, "").collect()} == {1, 2}
