"""Blocks of texts that are cut into pieces."""

from folioscope.operators import evidence


def test_blocks_over_pieces_are_slices(spark, monkeypatch):
    monkeypatch.setattr(evidence, "PIECE", 7)
    text = "".join(chr(97 + k % 26) + ("\n" if k % 5 == 0 else "😀" if k % 7 == 0 else "") for k in range(80))
    texts = spark.createDataFrame([("d", "c1", text, 30), ("d", "c2", "", 500), ("d", "c3", None, 600)], "document_id string, chapter_id string, text string, start_idx int")
    spots = [(30, 31), (30, 37), (36, 38), (37, 44), (33, 80), (30, 30 + len(text)), (50, 50), (30 + len(text) - 1, 30 + len(text))]
    rows = [(f"q{k}", "d", "c1", a, b, k) for k, (a, b) in enumerate(spots)] + [("q0", "d", "c2", 500, 510, 9), ("q0", "d", "c3", 600, 610, 8), ("q0", "d", "absent", 900, 901, 7)]
    chosen = spark.createDataFrame(rows, "query_id string, document_id string, chapter_id string, start_idx int, end_idx int, extra int")
    got = {(r["query_id"], r["chapter_id"]): r for r in evidence.cite(chosen, texts).collect()}
    assert len(got) == len(spots) + 2
    for k, (a, b) in enumerate(spots):
        r = got[f"q{k}", "c1"]
        assert (r["block_text"], r["citation_id"], r["extra"]) == (text[a - 30 : b - 30], "[E001]", k)
    assert got["q0", "c2"]["block_text"] == "" and got["q0", "c2"]["citation_id"] == "[E002]" and got["q0", "c3"]["block_text"] is None
