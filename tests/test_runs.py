"""Small cases of runs, replies, intake, made-up traces and sinks."""

import gzip
import json

from pyspark.sql import functions as F

from traceloom.operators import labels as L
from traceloom.operators import runs as R
from traceloom.operators import scoring as C
from traceloom.operators.policy import local_scorer
from traceloom.operators.traces import TRACE
from traceloom.sources import generate, intake, sinks


def test_text_call(spark):
    said = ['search {"q": 1}', '```json\nlookup: {"t": "x"}\n```', '<tool_call>search({"q": {"a": 1}})</tool_call>', 'search {"q": 1} {"q": 2}', 'I search {"q": 1}', "search [1]", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "i int, x string").withColumn("c", R.text_call(F.col("x")))
    got = [r["c"] and tuple(r["c"]) for r in df.orderBy("i").collect()]
    assert got == [("search", '{"q": 1}'), ("lookup", '{"t": "x"}'), ("search", '{"q": {"a": 1}}'), None, None, None, None, None]


def test_received(spark):
    good = b'{"question": "q", "final_answer": "a"}'
    sent = [(intake.API_PATH, None, good, 202), (intake.SYNC_PATH, "gzip", gzip.compress(good), 200), (intake.API_PATH, "gzip", b"junk", 400), (intake.API_PATH, "gzip", gzip.compress(b" " * (9 << 20)), 413), (intake.API_PATH, None, good + b" x", 400), (intake.API_PATH, None, b"\xff", 400), (intake.API_PATH, None, None, 400), (None, None, good, 404)]
    df = spark.createDataFrame([(i, p, "application/json", e, b) for i, (p, e, b, _) in enumerate(sent)], "request_id long, path string, content_type string, content_encoding string, body binary")
    got = intake.received(df)
    assert [r[0] for r in got.orderBy("request_id").select("http_status").collect()] == [x[3] for x in sent]
    assert intake.api_traces(got).where(F.size("problems") == 0).count() == 2
    answers = intake.score_now(got, spark.createDataFrame([("none", "m")], "agent string, model string")).collect()
    assert [(r["request_id"], r["decision"] in ("keep", "drop")) for r in answers] == [(1, True)]


def test_cache(spark):
    rows = spark.createDataFrame([("a", "m", "s1"), ("b", "m", "s2"), ("b", "m", "s2")], "key string, model string, state string")
    kind = "struct<raw:double,model:string,latency_ms:double,attempts:int,error_kind:string>"
    cache = spark.createDataFrame([("a", 1, (0.1, "m", 1.0, 1, None)), ("a", 2, (0.25, "m", 1.0, 1, None))], f"key string, seq int, score {kind}")
    got, new = C.score_with_cache(rows, cache, local_scorer)
    assert got.count() == 3 and got.where("key = 'a'").first()["score"]["raw"] == 0.25
    assert [r["key"] for r in new.collect()] == ["b"]


def test_made_up_traces_and_snapshot(spark, tmp_path):
    df = generate.labelled_traces(spark, 60)
    assert df.where("label = 'wrong' AND failure_type IS NULL OR label = 'correct' AND failure_type IS NOT NULL").count() == 0
    assert generate.row_digest(df, ["trace_id", "label"]).first()["n_questions"] == 40
    traces = spark.createDataFrame([("t", None, "q", [], [], "a")], TRACE)
    generate.write_golden(traces, f"{tmp_path}/golden")
    assert generate.differs(traces, f"{tmp_path}/golden").count() == 0
    assert generate.differs(traces.withColumn("final_answer", F.lit("b")), f"{tmp_path}/golden").count() == 1


def test_odd_traces(spark):
    rows = generate.odd_traces(spark, 4).select("question", "evidence").collect()
    assert len(rows) == 4 and all(0 < len(r["question"]) <= 40 for r in rows)


def test_run_log_and_comparison(spark, tmp_path):
    runs = spark.createDataFrame([("k1", "a", None), ("k2", None, "boom")], "run_key string, answer string, error string")
    for _ in range(2):
        sinks.append_runs(runs, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log/runs").count() == 1
    sinks.write_comparison(f"{tmp_path}/out", {"seed": 7}, {"summary": runs})
    assert json.loads(spark.read.text(f"{tmp_path}/out/comparison").first()[0])["summary"][0]["run_key"] == "k1"


def test_annotations_and_manifest(spark):
    schema = "name string, trace_id string, span_id string, label string, score double, created_at string, updated_at string, seq int"
    a = spark.createDataFrame([("n", "t", None, "wrong", None, None, None, 9)], schema)
    b = spark.createDataFrame([("n", "t", None, "correct", None, None, None, 1)], schema)
    assert L.latest_verdicts(L.all_annotations(a, b), "n").first()["verdict"] == "correct"
    report = spark.createDataFrame([("train", 5), ("test", 2)], "portion string, traces long")
    assert sorted(map(tuple, L.against_manifest(report, {"train": 5, "test": 3, "calibration": 1}).collect())) == [("calibration", 0, 1), ("test", 2, 3)]
