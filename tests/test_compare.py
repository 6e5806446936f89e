"""Comparison of models: portions, margins, logs, resamples of exactly n, corpora as JSON arrays."""

import json

import pytest
from pyspark.sql import functions as F

from traceloom.operators import compare as K
from traceloom.operators.evaluate import auroc
from traceloom.sources import traces


def test_rows_of_a_portion(spark):
    rows = spark.createDataFrame([("m", "test", "a", True, 0.1, 0.9), ("m", "train", "b", True, 0.2, 0.8), ("n", "test", "c", False, 0.3, 0.7)], "model string, portion string, trace_id string, y boolean, answer_wrong double, keep_or_drop double")
    assert [tuple(r) for r in K.of_portion(rows, "m", "test", "keep_or_drop").collect()] == [("a", True, 0.9)]


def test_margins(spark):
    rows = [("finetuned", "s", 0.1, 0.05, 0.7), ("finetuned", "s", 0.2, 0.05, 0.5), ("finetuned", "s", 0.1, 0.1, 0.0), ("heuristic", "r1", 0.1, 0.05, 0.4), ("heuristic", "r2", 0.1, 0.05, 0.4), ("heuristic", "logreg", 0.1, 0.05, 0.3), ("heuristic", "r1", 0.2, 0.05, 0.1), ("heuristic", "logreg", 0.2, 0.05, 0.45), ("finetuned", "s", 0.3, 0.05, None)]
    out = {r["base_rate"]: r for r in K.margins(spark.createDataFrame(rows, "model string, signal string, base_rate double, sample_rate double, norm_recall_mean double"), "finetuned", "s", ["logreg"], 0.05).collect()}
    assert (out[0.1]["best_rule"], out[0.1]["best"], out[0.1]["passed"]) == ("r1", "r1", True) and out[0.1]["margin"] == pytest.approx(0.3)
    assert (out[0.2]["best_rule"], out[0.2]["best"], out[0.2]["passed"]) == ("r1", "logreg", False)
    assert out[0.3]["best"] is None and out[0.3]["passed"] is False


def test_training_figures(spark):
    logs = spark.createDataFrame([("x\ndropped 3 of 60 records\ny", 99), ("nothing", 10), (None, 0)], "log string, n int")
    assert [(r["records"], r["dropped"], r["dropped_frac"]) for r in K.training_figures(logs, F.col("n")).collect()] == [(60, 3, 0.05), (10, 0, 0.0), (0, 0, None)]


def test_resamples_draw_exactly_n(spark):
    keys = spark.range(700).select(F.col("id").alias("k")).unionByName(spark.range(5).select(F.col("id").alias("k")))
    drawn = K.exact_resamples(keys, "k", 6)
    assert {r["resample"]: r["n"] for r in drawn.groupBy("resample").agg(F.sum("w").alias("n")).collect()} == dict.fromkeys(range(1, 7), 700)
    found = drawn.groupBy("resample").agg(F.count("*").alias("n")).collect()
    assert all(0.58 < r["n"] / 700 < 0.68 for r in found)  # 1 - 1/e of the keys
    again = sorted(map(tuple, K.exact_resamples(keys.repartition(5), "k", 6).collect()))
    assert sorted(map(tuple, drawn.collect())) == again
    assert K.exact_resamples(keys.limit(0), "k", 3).count() == 0


def test_interval_holds_the_value(spark):
    scores = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("g"), (F.col("id") % 5 == 0).alias("y"), (F.col("id") % 37 + F.when(F.col("id") % 5 == 0, 9).otherwise(0)).cast("double").alias("p"))
    out = {r["g"]: r for r in K.exact_bootstrap_auroc(scores, ["g"], "k", 40).collect()}
    plain = {r["g"]: r["auroc"] for r in auroc(scores, ["g"]).collect()}
    assert all(out[g]["auroc"] == plain[g] and out[g]["low"] < plain[g] < out[g]["high"] for g in plain) and len(out) == 2


def test_corpus_as_a_json_array(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"title": "a", "text": "x\ny"}, {"title": "b"}, {"text": "no title", "other": 1}], indent=1))
    assert sorted(map(tuple, traces.array_corpus(spark, str(tmp_path / "c.json")).collect())) == [("", "no title"), ("a", "x\ny"), ("b", "")]
