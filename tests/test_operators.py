"""Small cases of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from traceloom.functions import scalars as S
from traceloom.operators import evaluate as E
from traceloom.operators import labels as L
from traceloom.operators import policy as P
from traceloom.operators import retrieval as R
from traceloom.operators import traces as T
from traceloom.plans import config
from traceloom.sources import sinks, traces
from traceloom.sources.traces import labelled_lines
from traceloom.streaming import assembly


def test_compact_keeps_numbers_order_and_repeated_keys():
    assert S.compact('{ "b": 1.50, "a": [1E5, null], "b": "x\\u00e9" }') == '{"b":"xé","a":[1E5,null]}'
    assert S.compact("not json") == "not json"
    assert S.compact(None) is None


def test_message_text():
    assert S.value_text('{"response": {"result": "r"}}', S.OUTPUT_KEYS) == "r"
    assert S.value_text('{"content": {"parts": [{"text": "a"}, {"text": "b", "thought": true}]}}', S.QUESTION_KEYS) == "a"
    assert S.value_text('{"x": 1}', S.OUTPUT_KEYS) == '{"x": 1}'
    assert S.value_text("  ", S.OUTPUT_KEYS) == ""
    assert S.value_text('"q"', S.OUTPUT_KEYS) == "q"
    assert S.value_text('{"response": null, "text": "t"}', S.OUTPUT_KEYS) == '{"response": null, "text": "t"}'
    assert S.value_text('{"output": null, "text": "t"}', S.OUTPUT_KEYS) == ""
    assert S.value_text('{"response": "r", "result": 3}', S.ANSWER_KEYS) == "r"
    assert S.value_text('{"broken"', S.ANSWER_KEYS) == '{"broken"'
    assert S.value_text(" [1] ", S.ANSWER_KEYS) == " [1] "


def test_answer_tokens_beyond_ascii(spark):
    df = spark.createDataFrame([("The\u00a0cat, a\u2013b the end.",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(S.answer_tokens(df.t)).collect()] == [["cat", "\u2013b", "end"], [], []]


@pytest.mark.parametrize(("raw", "clean"), [("**Final Answer:** Seine.", "Seine"), ("the answer is: 'Paris'", "Paris"), ("U.S.", "U.S."), ("wait..", "wait.."), (None, ""), ("“x”", "x"), ("***answer: x", "***answer: x"), ("_The  final\tANSWER is:_ y", "y"), ("theanswer: x", "theanswer: x"), ("answer island", "answer island"), ("answer: is: z", "is: z"), ('""', ""), ("****", "**"), ("`*a*`.", "a"), ("answer", "answer")])
def test_clean_answer(raw, clean):
    assert S.clean_answer(raw) == clean


def test_byte_cut():
    assert S.byte_cut("é" * 100, 5) == "éé"


def test_slice(spark):
    df = spark.createDataFrame([("t", None, "q", [("search", '{"a": 1.50}', None), ("x", None, '"not_found"')], ["e" * 2000, "b", "c", "d"], "ans")], T.TRACE)
    state = T.build_state(T.rendered(df)).first()["state"]
    assert state == "USER QUESTION:\nq\n\nTOOL CALLS:\n1. search({\"a\":1.50}) -> ok\n2. x() -> not_found\n\nEVIDENCE:\n[1] " + "e" * 1500 + "\n[2] b\n[3] c\n\nFINAL ANSWER:\nans"


def test_keep_high_at_a_temperature(spark):
    df = spark.createDataFrame([("t", 0.93, 0.99), ("n", None, 0.001), ("m", None, 0.5)], "trace_id string, raw double, u double")
    out = {r["trace_id"]: r for r in P.decide(df.withColumn("p_keep", S.calibrate(df["raw"], 0.86))).collect()}
    assert (out["t"]["keep"], out["t"]["reason"], out["t"]["severity"]) == (True, "kev", "high")
    assert (out["n"]["keep"], out["n"]["reason"], out["n"]["severity"]) == (True, "fallback", "normal")
    assert (out["m"]["keep"], out["m"]["severity"]) == (False, "none")


def test_scorer_errors_fall_back_or_retry(spark):
    df = spark.createDataFrame([("t", None, "q", [], [], "a")], T.TRACE)
    models = spark.createDataFrame([("x", "m")], "agent string, model string")
    down = lambda: lambda model, state: {"error_kind": "unavailable"}
    out = P.run_engine(df, models, down, on_system_error="retry").first()
    assert out["retry"] and out["reason"] == "fallback" and out["p_keep"] is None


def test_label_rules(spark):
    df = spark.createDataFrame([("The cat sat.", "cat sat"), ("", "x"), ("yes", "no"), ("a b c d", "b c d e f")], "p string, g string")
    got = [r[0] for r in df.select(S.label_from_reference(df["p"], df["g"])).collect()]
    assert got == ["correct", "wrong", "wrong", "partial"]


def test_labelled_lines(spark):
    lines = [{"user_input": "q", "response": "a", "label": "Good", "tool_calls": [{"name": "s", "args": {"k": 1.50}}]}, {"question": "q"}, {"question": "q", "final_answer": "x", "ground_truth": "x"}, {"question": "q", "final_answer": "x"}]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)] + [(9, "{"), (10, " ")], "line_id long, value string")
    out = sorted((r["trace_id"], r["label"], r["reason"]) for r in traces.labelled_lines(df).collect())
    assert out == [("line-0", "correct", None), ("line-1", None, "missing final_answer"), ("line-2", "correct", None), ("line-3", None, "no readable label or reference"), ("line-9", None, "not JSON")]


def test_otlp_and_assembly(spark):
    attr = lambda **kw: [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in kw.items()]
    tid = "a" * 32
    spans = [
        {"traceId": tid, "spanId": "1" * 16, "name": "run", "startTimeUnixNano": "1", "attributes": attr(openinference__span__kind="AGENT", input__value='{"question": "who?"}', output__value="me")},
        {"traceId": tid, "spanId": "2" * 16, "parentSpanId": "1" * 16, "name": "search", "startTimeUnixNano": "2", "status": {"code": "STATUS_CODE_OK"}, "attributes": attr(openinference__span__kind="TOOL", input__value='{"q": 1}', output__value="p one\n\n p two \n\np one")},
        {"traceId": tid, "spanId": "0" * 16, "name": "bad"},
    ]
    line = json.dumps({"resourceSpans": [{"resource": {"attributes": attr(service__name="svc")}, "scopeSpans": [{"spans": spans}]}]})
    out = T.assemble(traces.otlp_spans(spark.createDataFrame([(0, line)], "line_id long, value string"))).first()
    assert (out["question"], out["final_answer"], out["agent"], out["reason"]) == ("who?", "me", "svc", None)
    assert out["evidence"] == ["p one", "p two"]
    assert [tuple(c) for c in out["tool_calls"]] == [("search", '{"q": 1}', '"ok"')]


def test_auroc_ties_and_classes(spark):
    df = spark.createDataFrame([("a", 0.1, False), ("a", 0.4, False), ("a", 0.4, True), ("a", 0.8, True), ("b", 0.5, True)], "g string, p double, y boolean")
    assert [(r["g"], r["auroc"]) for r in E.auroc(df, ["g"]).collect()] == [("a", 0.875)]


def test_bins_on_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.6, 0.7, 1.0)], "p double")
    assert [r[0] for r in df.select(E.bin_of(df["p"])).collect()] == [0, 2, 5, 6, 9]


def test_rebalanced_refuses_too_much(spark):
    df = spark.createDataFrame([(i, 0.5, i < 2) for i in range(20)], "k long, p double, y boolean")
    with pytest.raises(ValueError, match="positives"):
        E.rebalanced(df, [0.9], 1, "k")


def test_bm25_ignores_absent_terms(spark):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish"), (3, "nothing")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "blue fish"), (2, "absent")], "query_id long, text string")
    assert [(r["query_id"], r["doc_id"]) for r in R.bm25(docs, q).orderBy("query_id", "rank").collect()] == [(1, 2), (1, 1)]


def test_lookup_stages(spark):
    p = spark.createDataFrame([("Seine",), ("Rhine river",)], "title string")
    w = spark.createDataFrame([("Seine",), ("RHINE RIVER",), ("Sein",), ("zzz",)], "title string")
    assert sorted(map(tuple, R.lookup(p, w).collect())) == [("RHINE RIVER", "Rhine river", "case"), ("Sein", "Seine", "similar"), ("Seine", "Seine", "exact")]


def test_contradiction_and_its_fallback(spark):
    df = spark.createDataFrame([(1, "contradiction", "Paris", "Rome", [("T", "in paris it")], ["T"]), (2, "contradiction", "yes", "Rome", [("T", "x")], ["T"])], "qid long, condition string, answer string, decoy string, paragraphs array<struct<title:string,text:string>>, gold_titles array<string>")
    out = {r["qid"]: r for r in R.apply_condition(df).collect()}
    assert out[1]["applied"] == "contradiction" and ("T (archived revision)", "in Rome it") in [tuple(x) for x in out[1]["paragraphs"]]
    assert out[2]["applied"] == "missing_evidence" and out[2]["paragraphs"] == []


def test_fan_out_isolates_failures(spark):
    seen = []

    def bad(df):
        raise OSError("down")

    said = sinks.fan_out(spark.createDataFrame([(1, True), (2, False)], "id long, keep boolean"), {"a": lambda df: seen.append(df.count()), "b": bad})
    assert seen == [1] and said["a"] is None and "down" in said["b"]


def test_max_wait_cuts_a_steady_session(spark):
    df = spark.createDataFrame([(i, 7, i * 5) for i in range(10)], "event_id long, k long, s long").selectExpr("event_id", "k", "timestamp_seconds(s) AS ts")
    out = assembly.replayed_sessions(df, "k", "ts", 10, 20).orderBy("session").collect()
    assert [r["n"] for r in out] == [4, 4, 2]


def test_settle(spark):
    df = spark.createDataFrame([(1, None), (1, "unavailable"), (5, "unavailable"), (1, "invalid")], "deliveries int, error_kind string")
    assert [(r["outcome"], r["wait_s"]) for r in assembly.settle(df).collect()] == [("sent", None), ("retried", 5.0), ("dead", None), ("dead", None)]


def test_split_keeps_questions_whole(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(200)], "q long, i long")
    out = L.split(df, "q")
    assert L.leaks(out, "q").isEmpty()
    assert {r["portion"]: r["questions"] for r in L.split_report(out.withColumn("label", out["portion"]), "q").collect()} == {"train": 40, "calibration": 5, "test": 5}


def test_config():
    assert config.duration("1m30s") == 90
    assert config.load({"idle_timeout_s": "5s"}, {"TRACELOOM_RANDOM_FLOOR": "0.1"}).random_floor == 0.1
    with pytest.raises(ValueError, match="unknown key nope.*keep_threshold"):
        config.load({"nope": 1, "keep_threshold": 2}, {})
    assert config.headers("a=b%20c, d=e") == {"a": "b c", "d": "e"}
    assert config.manifest('{"model": "m", "questions": {"answer_wrong": {"b": 1, "a": 2}}}', "answer_wrong").questions == '{"answer_wrong":{"b":1,"a":2}}'


def test_sessions_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("t1", "a", 1), ("t1", "b", 2), ("t2", "c", 3)], "trace_id string, span string, seq long").write.json(str(src))
    stream = spark.readStream.schema("trace_id string, span string, seq long").json(str(src))
    q = assembly.assembled(stream, 500, 5000).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(30):
            q.awaitTermination(2)
            if spark.table("sessions").count() >= 2:
                break
        assert sorted((r["trace_id"], r["spans"]) for r in spark.table("sessions").collect()) == [("t1", ["a", "b"]), ("t2", ["c"])]
    finally:
        q.stop()


def test_labels_of_json_numbers(spark):
    rows = [(i, '{"question": "q", "final_answer": "a", "label": %s}' % x) for i, x in enumerate(["0.9", "1", "0.5", "0", "true", '"0.9"', '"Right "', "null", "[1]"])]
    got = {r["trace_id"]: r["label"] for r in labelled_lines(spark.createDataFrame(rows, "line_id long, value string")).collect()}
    assert [got[f"line-{i}"] for i in range(9)] == ["correct", "correct", "partial", "wrong", None, None, "correct", None, None]


def test_idle_sessions_of_any_table(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 100), ("b", 5)], "k string, s long").selectExpr("k", "timestamp_seconds(s) AS t")
    assert sorted((r["k"], r["session"]) for r in assembly.idle_sessions(df, "k", "t", 60).collect()) == [("a", 1), ("a", 1), ("a", 2), ("b", 1)]


def test_arrival_of_late_partitions_and_scopes(spark):
    scope = lambda *names: {"spans": [{"traceId": "t", "spanId": n, "name": n} for n in names]}
    line = json.dumps({"resourceSpans": [{"scopeSpans": [scope("a", "b"), scope("c")]}, {"scopeSpans": [scope("d")]}]})
    rows = spark.createDataFrame([((1 << 62) + 1, line), (0, line)], "line_id long, value string")
    found = traces.otlp_spans(rows).orderBy("arrival_seq").collect()
    assert [r.span_id for r in found] == list("abcd") * 2 and len({r.arrival_seq for r in found}) == 8


def test_pick_keys_is_the_head_of_the_order(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    order = [r.k for r in keys.orderBy(S.hash_order("s", F.col("k"))).collect()]
    for fraction in (0.0, 0.2, 0.333, 1.0):
        assert {r.k for r in L.pick_keys(keys, "k", fraction, "s").collect()} == set(order[: round(500 * fraction)])
    assert L.pick_keys(keys.limit(0), "k", 0.5, "s").collect() == []


def test_lookup_ignores_null_titles_and_finds_folded_lengths(spark):
    p = spark.createDataFrame([(None,), ("Gro\u00dfe Stra\u00dfe",), ("x",)], "title string")
    w = spark.createDataFrame([(None,), ("grosse strase",), ("zzzz",)], "title string")
    assert [tuple(r) for r in R.lookup(p, w).collect()] == [("grosse strase", "Gro\u00dfe Stra\u00dfe", "similar")]


def test_simple_upper_keeps_one_character_for_each(spark):
    import duckdb

    texts = ["Stra\u00dfe \u00e4\u00f6\u00fc", "\u0149 \ufb01x \u1f80", "", None, "a\nb\u00df\u00df"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r[0] for r in df.select(S.simple_upper(F.col("t"))).collect()]
    assert got[0] == "STRA\u1e9eE \u00c4\u00d6\u00dc"
    assert got == [duckdb.execute("SELECT upper(?::VARCHAR)", [x]).fetchone()[0] for x in texts]
