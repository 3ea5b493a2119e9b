"""Facts and small cases that the supplied tables do not hold."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import collection, evaluation, evidence, extraction, graph, index, intervals, locate, qa, questions, retrieval, segment
from folioscope.plans import ask
from folioscope.sources import files, reads, schemas, services, store
from folioscope.streaming import ingest


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def docs_of(spark, *texts):
    return spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "document_id string, text string")


def test_normalisation(spark):
    raw = "﻿a \t\r\nb\r========\n  更多精彩内容\nHTTPS://x\n\n\n\nc　"
    assert one(spark, tx.normalize_text(F.lit(raw))) == "a\nb\n\nc\n"
    assert one(spark, tx.normalize_text(F.lit(" \n　"))) == ""
    assert one(spark, tx.document_id(F.lit("x"))) == "doc_" + hashlib.sha256(b"x").hexdigest()[:12]


def test_real_headings_win_and_no_heading_is_one_chapter(spark):
    text = "书名: 示例\n\n【 第 1 部分 】\n\n第一章 开始\n正文一\n\n【 第 2 部分 】\n\n　第二章 继续\n正文二\n"
    got = segment.chapters(docs_of(spark, text, "无标题正文\n" + "内容" * 400)).orderBy("chapter_id").collect()
    assert [(r["chapter_title"], r["strategy"]) for r in got] == [("第一章 开始", "real_chapter_patterns"), ("第二章 继续", "real_chapter_patterns"), ("Whole Document", "whole_document_fallback")]
    assert got[0]["start_idx"] == text.index("第一章") and got[0]["end_idx"] == text.index("第二章") and got[1]["end_idx"] == len(text)
    assert (got[2]["chapter_id"], got[2]["start_idx"], got[2]["end_idx"]) == ("d1_ch0000", 0, 806)


def test_windows_equal_a_loop(spark):
    def loop(n, size, stride, least):
        out, at = [], 0
        while True:
            out.append([at, min(at + size, n)])
            if at + size >= n:
                break
            at += stride
        if len(out) > 1 and out[-1][1] - out[-1][0] < least:
            last = out.pop()
            out[-1][1] = last[1]
        return out

    rnd = random.Random(1)
    sizes = [rnd.randint(1, 4000) for _ in range(40)] + [1, 1000, 1001, 1799, 2480]
    docs = docs_of(spark, *("甲" * n for n in sizes))
    got = segment.windows(segment.chapters(docs), docs, "auto", 1000, 0.2, 300, 1400).collect()
    for k, n in enumerate(sizes):
        mine = sorted([r["window_start"], r["window_end"]] for r in got if r["document_id"] == f"d{k}")
        assert mine == loop(n, 1000, 800, 300)
    with pytest.raises(ValueError):
        segment.check_window_config(100, 1.0, 10, 200)


def test_search_tokens(spark):
    def model(text):
        import re

        out = []
        for m in re.finditer("[一-鿿]+|[A-Za-z0-9_]+", text):
            v = m[0]
            out += [v[i : i + n] for n in (1, 2, 3) for i in range(len(v) - n + 1)] if "一" <= v[0] <= "鿿" else [v.lower()]
        return out

    for text in ("塞西尔领的魔网", "Ab_1 魔网x第2章", "", "，。", "a"):
        assert one(spark, tx.tokens(F.lit(text))) == model(text)


def test_uuid5_and_embedding_equal_python(spark):
    import uuid

    assert one(spark, tx.uuid5_hex(F.lit("cluster::d::x::甲"))) == uuid.uuid5(uuid.NAMESPACE_URL, "cluster::d::x::甲").hex
    mine = one(spark, index.hash_embedding(F.lit("高文"), 40))
    assert max(abs(a - b) for a, b in zip(mine, services.HashEmbedder(40).embed(["高文"])[0])) < 1e-12


def window_row(spark, text, start=100, **more):
    return spark.createDataFrame([("r", "w", start, start + len(text), text, *more.values())], "row_id string, window_id string, window_start int, window_end int, text string" + "".join(f", {k} string" for k in more))


def test_location_tiers(spark):
    text = "他说：“魔法来自星空。”\n这句话后来被反复引用。"
    for quote, strategy in (("魔法来自星空", "exact"), ('他说:"魔法来自星空。"', "normalized"), ("这句话后来被反复引用了", "fuzzy")):
        r = locate.locate_quotes(window_row(spark, text, quote=quote)).first()
        assert r["status"] == "located" and r["best"]["strategy"] == strategy and r["best"]["confidence"] >= 0.86
    assert locate.locate_quotes(window_row(spark, text, quote="全然不同的一句话在别处")).first()["status"] == "failed"
    assert [c["start_idx"] for c in locate.locate_quotes(window_row(spark, "aaaa", 0, quote="aa")).first()["candidates"]] == [0, 1, 2]


def test_anchor_spans(spark):
    text = "夜里。XX森林你知道吗？那里有光，也有危险的雾。完"
    r = locate.locate_anchors(window_row(spark, text, start_anchor="XX森林你知道吗？", end_anchor="也有危险的雾")).first()
    assert text[r["best"]["start_idx"] - 100 : r["best"]["end_idx"] - 100] == "XX森林你知道吗？那里有光，也有危险的雾"
    assert locate.locate_anchors(window_row(spark, text, start_anchor="也有危险的雾", end_anchor="XX森林")).first()["failure_reason"] == "no ordered start/end anchor pair found"
    assert one(spark, locate.trim_anchor(F.lit(" abcdef "), "end", 4)) == "cdef"


def spans_frame(spark, rows):
    return spark.createDataFrame([("w", s, a, b, st) for s, a, b, st in rows], "window_id string, span_id string, span_start_idx int, span_end_idx int, locator_status string")


def test_gap_absorption_reads_original_bounds(spark):
    text = "开头闲笔。主角发现古门。中间过渡。古门发光并显出符文。结尾闲笔。"
    a, b = text.index("主角"), text.index("古门发光")
    spans = spans_frame(spark, [("s1", a, a + 7, "located"), ("s2", b, b + 10, "located")])
    got = {r["span_id"]: (r["span_start_idx"], r["span_end_idx"]) for r in intervals.absorb_gaps(window_row(spark, text, 0), spans).collect()}
    assert got == {"s1": (0, b), "s2": (b, len(text))}
    long = "头" * 130 + "主角发现古门。"
    got = intervals.absorb_gaps(window_row(spark, long, 0), spans_frame(spark, [("s1", 130, 137, "located")])).first()
    assert got["span_start_idx"] == 130


def test_interval_union_and_gaps_equal_a_loop(spark):
    rnd = random.Random(3)
    rows, windows = [], []
    for w in range(60):
        n = rnd.randint(1, 60)
        windows.append((f"w{w}", 10, 10 + n))
        rows += [(f"w{w}", f"s{k}", a := rnd.randint(0, 70), a + rnd.randint(0, 20), rnd.choice(["located", "failed"])) for k in range(rnd.randint(0, 5))]
    ws = spark.createDataFrame(windows, "window_id string, window_start int, window_end int")
    sp = spark.createDataFrame(rows, "window_id string, span_id string, span_start_idx int, span_end_idx int, locator_status string")
    merged = intervals.covered(ws, sp)
    gaps = sorted((r["window_id"], r["start_idx"], r["end_idx"]) for r in intervals.gaps(ws, merged).collect())
    want = []
    for name, s, e in windows:
        free = [True] * (e - s)
        for w, _, a, b, st in rows:
            if w == name and st == "located":
                for k in range(max(a, s), min(b, e)):
                    free[k - s] = False
        k = 0
        while k < len(free):
            if free[k]:
                j = k
                while j < len(free) and free[j]:
                    j += 1
                want.append((name, s + k, s + j))
                k = j
            k += 1
    assert gaps == sorted(want)


def test_budget_equals_the_greedy_loop(spark):
    rnd = random.Random(6)
    for _ in range(6):
        rows, chars, blocks = [], rnd.randint(50, 400), rnd.randint(1, 6)
        for k in range(rnd.randint(1, 12)):
            a = 1000 * k
            rows.append(("q", "d", f"c{rnd.randint(0, 4)}", "t", a, a + rnd.randint(1, 200), ["s"], ["bm25"], rnd.random(), rnd.random()))
        order, taken, seen, used = sorted(rows, key=lambda r: (-r[9], -r[8])), [], set(), 0
        for once in (True, False):
            for r in order:
                if len(taken) < blocks and used < chars and r[4] not in [t[0] for t in taken] and not (once and r[2] in seen):
                    size = min(r[5] - r[4], chars - used)
                    taken.append((r[4], r[4] + size))
                    seen.add(r[2])
                    used += size
        frame = spark.createDataFrame(rows, "query_id string, document_id string, chapter_id string, chapter_title string, start_idx int, end_idx int, source_span_ids array<string>, retrieval_sources array<string>, rerank_score double, priority_score double")
        assert sorted((r["start_idx"], r["end_idx"]) for r in evidence.choose(frame, chars, blocks).collect()) == sorted(taken)


def test_evidence_blocks(spark):
    results = spark.createDataFrame([("q", "d", "a", "c1", 100, 180, 0.92, ["graph", "vector"]), ("q", "d", "b", "c1", 240, 300, 0.84, ["bm25"]), ("q", "d", "c", "c2", 1120, 1180, 0.72, ["graph"]), ("q", "d", "x", "c1", 990, 1020, 0.9, ["bm25"])], "query_id string, document_id string, span_id string, chapter_id string, span_start_idx int, span_end_idx int, rerank_score double, sources array<string>")
    chapters = spark.createDataFrame([("d", "c1", "一", 0, 1000), ("d", "c2", "二", 1000, 2000)], "document_id string, chapter_id string, chapter_title string, start_idx int, end_idx int")
    wide = evidence.expand(evidence.seeds(results), chapters, 20, 50 - 20)
    assert {r["span_id"]: r["warning"] for r in wide.collect()}["x"] == "coordinates outside chapter"
    merged = evidence.merge(wide, 100)
    got = evidence.cite(evidence.choose(merged), chapters.withColumn("text", F.repeat(F.lit("0123456789"), F.lit(100)))).orderBy("start_idx").collect()
    assert [(r["citation_id"], r["start_idx"], r["end_idx"], r["source_span_ids"]) for r in got] == [("[E001]", 80, 330, ["a", "b"]), ("[E002]", 1100, 1210, ["c"])]
    assert got[0]["priority_score"] == pytest.approx(0.92 + 0.16) and got[0]["block_text"][:4] == "0123"


def test_citations(spark):
    errors = lambda a, ids: one(spark, qa.citation_errors(F.lit(a), F.array(*(F.lit(i) for i in ids)).cast("array<string>")))
    assert errors("见 [E099]", ["[E001]"]) == ["unknown citations: [E099]"]
    assert errors("无", ["[E001]"]) == ["answer contains no citations"]
    assert errors("无", []) == ["evidence pack contains no citation ids"]
    assert "[E001]" in one(spark, qa.mock_answer(F.array(F.lit("[E001]")))) and "证据不足" in one(spark, qa.mock_answer(F.array().cast("array<string>")))


def test_answer_repair(spark):
    packs = spark.createDataFrame([("q", "为什么", [("[E001]", "一", 0, 1, "文")])], "query_id string, question string, blocks array<struct<citation_id:string,chapter_title:string,start_idx:int,end_idx:int,text:string>>")
    got = qa.answer(packs, lambda: services.ScriptedChat(["[E099] 错", "[E001] 对"])).first()
    assert (got["answer"], got["attempts"]) == ("[E001] 对", 2)


def test_metrics(spark):
    q = spark.createDataFrame([("q", "broad", None, [])], "question_id string, profile string, query_type string, required_facets array<string>")
    gold = spark.createDataFrame([("q", "ch1", 1.0, 3.0, "f")], "question_id string, chapter_id string, weight double, relevance double, facet string")
    hits = spark.createDataFrame([("q", "ch3", 0.9, ["bm25"], "s3", 1), ("q", "ch1", 0.8, ["vector"], "s1", 2), ("q", "ch1", 0.7, ["graph"], "s1b", 3)], "question_id string, chapter_id string, score double, sources array<string>, span_id string, rank int")
    ranked = evaluation.chapter_ranking(hits)
    assert [(r["chapter_id"], r["hit_count"], r["sources"]) for r in ranked.orderBy("rank").collect()] == [("ch3", 1, ["bm25"]), ("ch1", 2, ["graph", "vector"])]
    bad = spark.createDataFrame([("q", "", 7)], "question_id string, chapter_id string, chapter_index int")
    r = evaluation.question_scores(q, gold, ranked.withColumn("chapter_index", F.when(F.col("chapter_id") == "ch3", 7).otherwise(1)), bad).first()
    assert (r["weighted_recall_at_1"], r["weighted_recall_at_3"], r["facet_coverage_at_3"], r["mrr"], r["noise_at_1"], r["noise_at_3"]) == (0, 1, 1, 0.5, 1, 0.5)
    assert r["ndcg_at_3"] == pytest.approx(1 / math.log2(3))
    means = {(m["grouping"], m["group"]): m["mrr"] for m in evaluation.metric_means(evaluation.question_scores(q, gold, ranked.withColumn("chapter_index", F.lit(0)), bad)).collect()}
    assert means == {("overall", "all"): 0.5, ("profile", "broad"): 0.5, ("query_type", "unknown"): 0.5}
    weights = spark.createDataFrame([("a", "x", 3.0, 0.0), ("a", "y", 1.0, 0.0), ("b", "x", 0.0, 0.0), ("b", "y", -1.0, 0.0)], "question_id string, chapter_id string, weight double, relevance double")
    assert sorted(w["weight"] for w in evaluation.normalize_gold(weights).collect()) == [0.25, 0.5, 0.5, 0.75]


def test_routes_and_types(spark):
    assert one(spark, retrieval.route(F.lit("塞西尔家族为什么衰落，和高文有什么关系？"))) == "character_relation"
    assert one(spark, retrieval.route(F.lit("hello"))) == "unknown"
    kind = lambda t, s, e: one(spark, graph.cluster_type(F.lit(t), F.lit(s), F.array(*map(F.lit, e)).cast("array<string>")))
    assert [kind("other", "城堡", []), kind("other", "家族", []), kind("interaction", "x", []), kind("reflection", "x", ["e"]), kind("reflection", "x", [])] == ["location", "faction", "character", "character", "history"]


def test_payloads_and_costs(spark):
    raw = 'Sure! {"spans": [{"summary": "s", "salience_score": 0.4, "start_anchor_quote": "a", "end_anchor_quote": "b"}]} bye'
    assert one(spark, extraction.parse_payload(F.lit(raw)))["spans"][0]["summary"] == "s"
    assert one(spark, extraction.parse_payload(F.lit("nothing"))) is None
    assert one(spark, extraction.usage_cost(F.lit(1500), F.lit(500), 0.002, 0.003)) == 0.0045
    windows = spark.createDataFrame([("w1", "d", "c", 1, 1), ("w2", "d", "c", 1, 2), ("w3", "d", "c", 1, 3)], "window_id string, document_id string, chapter_id string, chapter_index int, window_index int")
    assert sorted(r["window_id"] for r in extraction.select_windows(windows, ["w3, w1"], ["2-2"]).collect()) == ["w1", "w2", "w3"]
    assert [r["window_id"] for r in extraction.select_windows(windows, offset=1, limit=1).collect()] == ["w2"]
    with pytest.raises(ValueError):
        extraction.select_windows(windows, ranges=["3-1"])
    texts = spark.createDataFrame([("w1", "a t b")], "window_id string, text string")
    got = extraction.extract(texts, lambda: services.ScriptedChat(["no", raw]), lambda t: [{"role": "user", "content": t}]).first()
    assert (got["attempts"], got["error"]) == (2, None)


def test_batch_rounds_end(spark):
    windows = spark.createDataFrame([(f"w{k}", "t") for k in range(6)], "window_id string, text string")
    good = '{"spans": [{"summary": "s"}]}'
    answers = lambda w: w.select(F.col("window_id").alias("custom_id"), F.when(F.col("window_id") < "w3", good).otherwise("bad").alias("raw_output"), F.lit(None).cast("string").alias("error"), F.lit(12).alias("total_tokens"))
    live = lambda w: extraction.batch_apply(w, w.select(F.col("window_id").alias("custom_id"), F.lit(good).alias("raw_output"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("total_tokens")))
    done, deferred = extraction.batch_rounds(windows, answers, live)
    assert sum(d.count() for d in done) == 6 and deferred.count() == 0
    line = '{"custom_id": "w1", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "x"}}], "usage": {"total_tokens": 7}}}}'
    assert extraction.batch_outputs(spark.createDataFrame([(line,)], "value string")).first().asDict() == {"custom_id": "w1", "raw_output": "x", "error": None, "total_tokens": 7}


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k int, v string, created_at string")
    new = spark.createDataFrame([(2, "c", "t1"), (3, "d", "t1")], "k int, v string, created_at string")
    assert sorted(map(tuple, store.upsert(old, new, ["k"]).select("k", "v", "created_at").collect())) == [(1, "a", "t0"), (2, "c", "t0"), (3, "d", "t1")]
    assert store.update_column(old, new, ["k"], "v").where("k = 2").first()["v"] == "c"
    assert store.cascade({"x": old}, new, ["k"])["x"].count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("第一章 A\r\n内容".encode("gb18030"))
    (tmp_path / "b.txt").write_bytes("﻿hello".encode())
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert (got["a.txt"]["text"], got["a.txt"]["encoding"], got["b.txt"]["text"]) == ("第一章 A\r\n内容", "gb18030", "hello")
    assert files.ingest(spark, str(tmp_path)).count() == 2
    q = tmp_path / "q.jsonl"
    q.write_text('{"question_id": "q1", "question": "?", "expected_chapters": [{"chapter_id": "c1", "weight": 2}], "extra": 5}\n\n')
    r = files.read_questions(spark, str(q)).first()
    assert r["required_facets"] == ["general"] and r["expected_chapters"][0]["relevance"] == 2 and r["metadata"] == '{"extra":"5"}'
    q.write_text("not json\n")
    with pytest.raises(Exception, match="bad question line"):
        files.read_questions(spark, str(q)).collect()
    text = "第一章 A\n正文一\n第二章 B\n正文二\n"
    docs = docs_of(spark, text)
    assert files.corpus(docs, segment.chapters(docs), 1, 1).first()["text"] == "第一章 A\n正文一\n"


def test_services():
    config = {"providers": {"p": {"base_url": "http://x"}}, "profiles": {"f": {"model": "m", "temperature": 1}}, "services": {"qa": {"provider": "p", "profile": "f", "temperature": 0}}}
    got = services.resolve(config, "qa")
    assert (got.model, got.base_url, got.settings["temperature"]) == ("m", "http://x", 0)
    with pytest.raises(KeyError):
        services.resolve(config, "none")
    with pytest.raises(KeyError):
        services.resolve(config | {"profiles": {}}, "qa")
    with pytest.raises(KeyError):
        services.resolve(config | {"providers": {}}, "qa")
    with pytest.raises(ValueError):
        services.resolve({"services": {"qa": {"model": "m"}}}, "qa")
    assert services.usage({"prompt_tokens": 3, "completion_tokens": 4}) == {"input_tokens": 3, "output_tokens": 4, "total_tokens": 7}
    assert services.OverlapReranker().rerank("ab", ["zz", "xab"])[0][0] == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Chapter 1 x\n" + "word " * 400)
    ingest.write_windows(ingest.documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), size=400, least=100, most=500).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "windows")).count() == 1
    events = spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 02:00:00")], "user string, at string").withColumn("at", F.to_timestamp("at"))
    assert sorted(r["n"] for r in ingest.sessions(events, "user", "at").collect()) == [1, 2]


def test_retries_on_locator_reasons(spark):
    """An answer whose anchors are not in the window is asked for again; tokens add up, the last answer counts."""
    texts = spark.createDataFrame([("w1", "夜里有光，也有危险的雾。")], "window_id string, text string")
    payload = lambda a, b: '{"spans": [{"summary": "s", "salience_score": 0.4, "start_anchor_quote": "%s", "end_anchor_quote": "%s"}]}' % (a, b)
    for first, attempts in ((payload("从未出现的起点", "危险的雾"), 2), (payload("危险的雾", "夜里有光"), 2), (payload("夜里有光", "危险的雾"), 1)):
        got = extraction.extract(texts, lambda first=first: services.ScriptedChat([first, payload("夜里有光", "危险的雾")])).first()
        assert (got["attempts"], got["raw_output"], got["output_tokens"], got["error"]) == (attempts, payload("夜里有光", "危险的雾"), attempts, None)
    got = extraction.extract(texts, lambda: services.ScriptedChat(["no json"]), retries=1).first()
    assert got["attempts"] == 2 and got["error"]


def test_persisted_results(spark):
    windows = spark.createDataFrame([("w1", "d", "c", 0, 9), ("w2", "d", "c", 9, 20), ("w3", "d", "c", 20, 30)], "window_id string, document_id string, chapter_id string, window_start int, window_end int")
    spans = spark.createDataFrame([("s1", "d", "w1", "located", None), ("s2", "d", "w1", "failed", "start anchor not found")], "span_id string, document_id string, window_id string, locator_status string, failure_reason string")
    answers = spark.createDataFrame([("w1", "{}", 1, 5, 7, None), ("w2", "x", 3, 1, 1, "no json"), ("w3", "{}", 1, 1, 1, None)], "window_id string, raw_output string, attempts int, input_tokens int, output_tokens int, error string")
    lost = extraction.failed_windows(windows, answers, spans)
    assert {(r["span_id"], r["failure_reason"]) for r in lost.collect()} == {("span_w2_001", "no json"), ("span_w3_001", "window extraction produced no valid spans")}
    results = spans.withColumns({"parsed": F.lit(True), "attempts": F.lit(1), "raw_output": F.lit("{}")}).unionByName(lost.select("span_id", "document_id", "window_id", "locator_status", "failure_reason", "parsed", "attempts", "raw_output"))
    kept = extraction.persisted(results)
    assert {(r["span_id"], r["stage"]) for r in kept["extraction_failures"].collect()} == {("s2", "locator"), ("span_w2_001", "extraction"), ("span_w3_001", "extraction")}
    assert kept["spans"].columns == ["span_id", "document_id", "window_id", "locator_status"] and kept["spans"].count() == 4
    used = {r["span_id"]: (r["input_tokens"], r["cost"]) for r in extraction.with_usage(spans, answers, 0.002, 0.003).collect()}
    assert used == {"s1": (5, 0.000031), "s2": (0, 0.0)}
    report = extraction.extraction_report(kept["spans"], kept["extraction_failures"]).first()
    assert (report["total_spans"], report["located_spans"], report["failure_count"], report["failures_by_stage"]) == (4, 1, 3, {"extraction": 2, "locator": 1})
    old = spark.createDataFrame([("s1", 1), ("s9", 2)], "span_id string, start_idx int")
    new = spark.createDataFrame([("s1", 5)], "span_id string, start_idx int")
    assert sorted(map(tuple, extraction.replace_candidates(old, new).collect())) == [("s1", 5), ("s9", 2)]


def test_batch_polling_and_report():
    states, slept, now = iter(["in_progress", "in_progress", "completed"]), [], [0.0]
    got = extraction.poll_batch(lambda: {"status": next(states)}, interval=0.1, clock=lambda: now[0], sleep=slept.append)
    assert got["status"] == "completed" and slept == [1.0, 1.0]
    assert extraction.poll_batch(lambda: {"status": "in_progress"}, wait=False)["status"] == "in_progress"
    assert extraction.poll_batch(lambda: {"status": "in_progress"}, timeout=5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + 3))["status"] == "in_progress" and now[0] == 6
    report = extraction.batch_report("r", {"batch_id": "b", "status": "failed"}, 7)
    assert report["window_count"] == 7 and report["span_count"] == 0 and report["batch"]["status"] == "failed" and report["usage"]["total_tokens"] == 0


def test_weights_and_coverage(spark):
    assert sum(graph.normalized_weights({"vector": 2, "entity": 2}).values()) == pytest.approx(1)
    assert graph.normalized_weights(use_vectors=False)["vector"] == 0 and sum(graph.normalized_weights(use_vectors=False).values()) == pytest.approx(1)
    assert graph.normalized_weights(dict.fromkeys(("vector", "entity", "bm25", "chapter", "salience"), 0)) == {"vector": 0.4, "entity": 0.35, "bm25": 0.1, "chapter": 0.1, "salience": 0.05}
    with pytest.raises(ValueError):
        graph.normalized_weights({"other": 1})
    spans = spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "c")], "document_id string, span_id string")
    got = graph.vector_coverage(spans, spans.limit(1)).first()
    assert (got["requested"], got["loaded"], got["coverage"]) == (3, 1, 0.333333)
    assert graph.vector_coverage(spans, None).first()["source"] == "disabled"


def test_index_and_vectors_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([("d", "a", "red fox"), ("d", "b", "red red hen")], "document_id string, span_id string, text string")
    posted = index.postings(docs, "span_id", F.col("text"), ["document_id"])
    index.save_postings(posted, docs, str(tmp_path / "bm25"), ["document_id"], "span_id")
    held, weights = index.load_postings(spark, str(tmp_path / "bm25"), ["red"])
    assert sorted((r["span_id"], r["tf"], r["len"]) for r in held.collect()) == [("a", 1, 2), ("b", 2, 3)] and weights.count() == 3
    store_ = collection.VectorCollection(spark, str(tmp_path / "vectors"), 2)
    store_.recreate()
    form = "span_id string, document_id string, vector array<double>"
    store_.upsert(spark.createDataFrame([("a", "d", [1.0, 0.0]), ("b", "d", [0.0, 1.0]), ("c", "e", [1.0, 1.0])], form))
    store_.upsert(spark.createDataFrame([("a", "d", [0.0, 2.0])], form))
    assert store_.count() == 3
    assert {r["span_id"]: r["vector"] for r in store_.retrieve(spark.createDataFrame([("a",), ("z",)], "span_id string")).collect()} == {"a": [0.0, 2.0]}
    found = store_.search(spark.createDataFrame([("q", "d", [0.0, 1.0])], "query_id string, document_id string, vector array<double>"), 2)
    assert [(r["span_id"], r["score"]) for r in found.orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0)]
    with pytest.raises(Exception, match="vector size"):
        store_.upsert(spark.createDataFrame([("x", "d", [1.0])], form))
    with pytest.raises(ValueError):
        collection.VectorCollection(spark, "x", 2, "other")


def test_nearest_equals_all_pairs(spark):
    rnd = random.Random(8)
    rows = [(f"s{k % 3}", k, [rnd.gauss(0, 1) for _ in range(5)] if k % 11 else ([0.0] * 5 if k % 2 else [1.0, 2.0])) for k in range(90)]
    v = spark.createDataFrame(rows, "scope string, id int, vector array<double>")

    def similar(metric, a, b):
        if len(a) != len(b):
            return 0.0
        d = sum(x * y for x, y in zip(a, b))
        if metric == "cosine":
            n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            return d / n if n else 0.0
        return {"dot": d, "euclid": -math.dist(a, b), "manhattan": -sum(abs(x - y) for x, y in zip(a, b))}[metric]

    for metric in ("cosine", "dot", "euclid", "manhattan"):
        got = index.nearest(v.withColumnRenamed("id", "of"), v, ["scope"], "of", "id", 4, metric, block=7, others=True)
        best = {}
        for r in index.top_k(got, ["of"], 4, [F.desc("score"), F.asc("id")]).collect():
            best.setdefault(r["of"], {})[r["rank"]] = r["id"]
        for s, k, a in rows:
            order = sorted((-round(similar(metric, a, b), 9), j) for t, j, b in rows if t == s and j != k)[:4]
            assert [best[k][n] for n in (1, 2, 3, 4)] == [j for _, j in order], (metric, k)


def test_fuzzy_search_equals_trying_every_fragment():
    from difflib import SequenceMatcher

    rnd = random.Random(5)
    for _ in range(25):
        text = "".join(rnd.choice("abcdefg ，。") for _ in range(rnd.randint(20, 70)))
        at, n = rnd.randint(0, 10), rnd.randint(8, 16)
        quote = "".join(c if rnd.random() > 0.1 else "z" for c in text[at : at + n])
        form, source = locate.match_form(text)
        wanted, _ = locate.match_form(quote)
        best = {}
        for size in range(max(4, math.floor(len(wanted) * 0.75)), min(len(form), max(len(wanted) + 24, math.floor(len(wanted) * 1.25))) + 1):
            for k in range(len(form) - size + 1):
                ratio = SequenceMatcher(None, wanted, form[k : k + size], autojunk=False).ratio()
                if ratio >= 0.8 and (source[k] not in best or round(ratio, 4) > best[source[k]][2]):
                    best[source[k]] = (source[k], source[k + size - 1] + 1, round(ratio, 4), "fuzzy")
        expected = sorted(best.values(), key=lambda c: -c[2])[:10] if len(wanted) >= 8 else []
        assert locate.fuzzy_occurrences(text, quote, 0.8) == expected


def test_quotes_are_found_everywhere(spark, monkeypatch):
    monkeypatch.setattr(locate, "AUTOMATON_CHARS", 3)
    docs = spark.createDataFrame([(1, "aaa b aa"), (2, None), (3, ""), (3, "aa")], "document_id int, text string")
    quotes = spark.createDataFrame([("q", "aa"), ("r", "aa"), ("s", "b a"), ("t", ""), ("u", None)], "quote_id string, quote string")
    got = sorted(map(tuple, locate.quote_occurrences(docs, quotes).collect()))
    assert got == sorted([(1, q, a, a + 2) for q in "qr" for a in (0, 1, 6)] + [(1, "s", 4, 7)] + [(3, q, 0, 2) for q in "qr"])
    assert locate.quote_occurrences(docs, quotes.limit(0)).count() == 0


def test_reads_of_the_store(spark):
    raw = spark.createDataFrame([("s1", '["a","b"]', "2024-01-02 03:04:05"), ("s2", "broken", "never")], "span_id string, entities_json string, created_at string")
    got = {r["span_id"]: r for r in schemas.decoded(raw, "spans").collect()}
    assert got["s1"]["entities"] == ["a", "b"] and got["s2"]["entities"] == [] and got["s1"]["created_at"].hour == 3 and got["s2"]["created_at"] is None
    assert got["s1"]["locator_status"] == "failed" and schemas.stale(schemas.decoded(raw, "spans"), "spans") == [] and "summary" in schemas.stale(raw, "spans")
    assert all(schemas.empty(spark, name).count() == 0 for name in schemas.TABLES)
    status = spark.createDataFrame([("d", "w1", 1, "pending"), ("d", "w2", 2, "extracted"), ("d", "w3", 3, "pending")], "document_id string, window_id string, global_index int, status string")
    assert [(r["window_id"], r["total"]) for r in reads.windows_by_status(status, "pending", 1).collect()] == [("w1", 2)]
    with pytest.raises(ValueError):
        reads.windows_by_status(status, "other")
    spans = spark.createDataFrame([("b", "d", 5, "located"), ("a", "d", 5, "failed"), ("c", "d", 1, "located")], "span_id string, document_id string, window_start int, locator_status string")
    assert [r["span_id"] for r in reads.spans(spans).orderBy("ord").collect()] == ["c", "a", "b"] and reads.spans(spans, True).count() == 2
    clusters = spark.createDataFrame([("k2", "d", "b", "n"), ("k1", "d", "a", "n")], "cluster_id string, document_id string, cluster_type string, cluster_name string")
    assert [r["cluster_id"] for r in reads.clusters(clusters).collect()] == ["k1", "k2"] and reads.clusters(clusters, "k2").count() == 1
    detail = reads.span_detail(spans, spark.createDataFrame([("b", 1, 0, 1, 0.5, "exact"), ("b", 2, 0, 2, 0.9, "fuzzy")], "span_id string, id long, start_idx int, end_idx int, confidence double, strategy string"), spark.createDataFrame([("a", 1, "locator", "r")], "span_id string, id long, stage string, reason string"))
    by = {r["span_id"]: r for r in detail.collect()}
    assert [c["id"] for c in by["b"]["candidates"]] == [2, 1] and by["a"]["failures"][0]["reason"] == "r" and by["c"]["candidates"] == []


def test_prompts_name_blocks_and_clusters(spark):
    clusters = spark.createDataFrame([("d", "k1", "n1", "t1", "s1"), ("d", "k2", "n2", "t2", "s2")], "document_id string, cluster_id string, cluster_name string, cluster_type string, summary string")
    packs = spark.createDataFrame([("q", "d", "为什么", ["k2", "k9"], [("[E001]", "一", 0, 1, "文")]), ("r", "d", "谁", [], [])], "query_id string, document_id string, question string, cluster_ids array<string>, blocks array<struct<citation_id:string,chapter_title:string,start_idx:int,end_idx:int,text:string>>")
    got = {r["query_id"]: r["m"] for r in qa.cluster_summaries(packs, clusters).select("query_id", qa.answer_messages(F.col("question"), F.lit("unknown"), F.col("cluster_summaries"), F.col("blocks")).alias("m")).collect()}
    assert [m["role"] for m in got["q"]] == ["system", "user"] and "- k2 (t2): n2 - s2" in got["q"][1]["content"] and "[E001]" in got["q"][1]["content"] and "k1" not in got["q"][1]["content"]
    assert "clusters: none" in got["r"][1]["content"] and "evidence blocks: none" in got["r"][1]["content"]
    mended = packs.select(qa.repair_messages(F.col("question"), F.lit("bad"), F.array(F.lit("e1"), F.lit("e2")), F.col("blocks")).alias("m")).first()["m"]
    assert "errors: e1; e2" in mended[1]["content"] and mended[1]["content"].endswith("bad")


def test_generated_question_sets(spark, tmp_path):
    corpus = spark.createDataFrame([("d", "c1", 1, "一", 3, "正文一"), ("d", "c2", 2, "二", 3, "正文二")], "document_id string, chapter_id string, chapter_index int, chapter_title string, char_count int, text string")
    answer = 'Here: {"questions": [{"question_id": "q1", "question": "谁?", "expected_chapters": [{"chapter_id": "c1", "weight": 1}]}, {"question_id": "q2", "question": "何时?", "expected_chapters": [{"chapter_id": "c2", "weight": 1}]}]}'
    questions.generate(corpus, lambda: services.ScriptedChat([answer]), 2, " Broad ").select("line").write.text(str(tmp_path / "q"))
    assert sorted((r["question_id"], r["profile"]) for r in files.read_questions(spark, str(tmp_path / "q")).collect()) == [("q1", "broad"), ("q2", "broad")]
    text = questions.source_text(corpus).first()
    assert text["source"].index("正文一") < text["source"].index("[CHAPTER 2]") and '"chapter_id":"c2"' in text["catalog"]
    for bad in ('{"questions": []}', answer.replace("q2", "q1"), '{"questions": [{"question_id": "x"}]}'):
        with pytest.raises(ValueError):
            questions.questions_of(bad)
    with pytest.raises(ValueError):
        questions.normalize_profile("deep")


def test_the_graph_is_stored_by_document(spark, tmp_path):
    edges = spark.createDataFrame([("d", "e1", "k", "s", "CenterSpanCluster", "Span", "SUPPORTS", 1.0), ("d", "e2", "s", "entity::d::甲", "Span", "Entity", "MENTIONS_ENTITY", 1.0)], "document_id string, edge_id string, from_id string, to_id string, from_type string, to_type string, edge_type string, weight double")
    clusters = spark.createDataFrame([("d", "k", "n", "t", "x", 0.5)], "document_id string, cluster_id string, cluster_name string, cluster_type string, summary string, confidence double")
    spans = spark.createDataFrame([("d", "s", "sum", "c", "other", 0.5, 0, 1), ("d", "unused", "sum", "c", "other", 0.5, 0, 1)], "document_id string, span_id string, summary string, chapter_id string, span_type string, salience_score double, span_start_idx int, span_end_idx int")
    chapters = spark.createDataFrame([("d", "c", "一", 1)], "document_id string, chapter_id string, chapter_title string, chapter_index int")
    nodes = graph.nodes(clusters, spans, chapters, edges)
    assert sorted((r["node_type"], r["name"]) for r in nodes.collect()) == [("CenterSpanCluster", "n"), ("Chapter", "一"), ("Entity", "甲"), ("Span", "sum")]
    graph.write_graph(nodes, edges, str(tmp_path))
    graph.write_graph(nodes.withColumn("document_id", F.lit("e")), edges.withColumn("document_id", F.lit("e")), str(tmp_path))
    graph.write_graph(nodes.limit(1), edges.limit(1), str(tmp_path))
    assert {(r["document_id"], r["count"]) for r in spark.read.parquet(str(tmp_path / "nodes")).groupBy("document_id").count().collect()} == {("d", 1), ("e", 4)}


def test_the_whole_path(spark):
    body = "".join(f"第{'一二三四五六'[k]}章 标题\n" + "".join(f"高文在第{k}处走进古门{j}，看见魔法的光{'，' * (j % 3)}并记下符文{k * 7 + j}。" for j in range(12)) + "\n" for k in range(3))
    built = ask.build(docs_of(spark, body))
    questions = spark.createDataFrame([("q1", "d0", "高文看见了什么魔法？")], "query_id string, document_id string, question string")
    built = ask.with_graph(built)
    hits = ask.retrieve(built, questions)
    assert {s for r in hits.collect() for s in r["sources"]} == {"bm25", "graph", "vector"}
    r = ask.ask(built, questions).first()
    assert r["valid"] and r["block_count"] >= 1 and all(b["text"] == body[b["start_idx"] : b["end_idx"]] for b in r["blocks"])
