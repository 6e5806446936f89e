"""The finetuning run: splits, checks, stages that go on where they stopped, temperatures against a grid."""

import math
import random

import pytest
from pyspark.sql import functions as F

from traceloom.operators import evaluate as E
from traceloom.plans import finetune
from traceloom.plans.tables import Stages

RNG = random.Random(8)


def traces(spark, n=600, split=None):
    rows = [(f"t{i}", f"q{i % 120}", split(i) if split else None, "wrong" if RNG.random() < 0.3 else "correct", i % 9, RNG.random()) for i in range(n)]
    return spark.createDataFrame(rows, "trace_id string, question_key string, split string, label string, nine int, chance double")


def scorer(weight):
    def score(rows):
        known = (F.col("label") == "wrong").cast("double")
        return rows.withColumns({"answer_wrong": 0.1 + 0.7 * (weight * known + (1 - weight) * F.col("chance")), "keep_or_drop": F.col("chance"), "latency_ms": F.col("nine") * 2.0})

    return score


OPTIONS = finetune.Options(base_rates=(0.1, 0.2), resamples=3, heldout=0.5)


def run(spark, path, rows, train=lambda rows: scorer(0.6), options=OPTIONS, until="decisions"):
    return finetune.run(spark, path, rows, scorer(0.1), train, ["nine", "chance"], options, until)


def everything(out):
    return {(stage, name): sorted(map(str, df.collect())) for stage, tables in out.items() for name, df in tables.items()}


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    rows = traces(spark).cache()
    whole = everything(run(spark, f"file://{tmp_path}/whole", rows))

    def dies(train):
        raise RuntimeError("killed")

    path, calls = f"file://{tmp_path}/parts", []
    with pytest.raises(RuntimeError):
        run(spark, path, rows, dies)
    broken = spark.createDataFrame([], rows.schema)  # the second run must not read the source again

    def trainer(train):
        calls.append(train.count())
        return scorer(0.6)

    assert everything(run(spark, path, broken, trainer)) == whole and len(calls) == 1
    assert everything(run(spark, path, broken, dies)) == whole  # all is there
    decisions = {r["trace_id"]: r for r in run(spark, path, broken, dies)["decisions"]["decisions"].collect()}
    assert {r["keep"] for r in decisions.values()} == {True, False} and all(r["p_keep"] is not None for r in decisions.values())


def test_other_settings_are_other_stages(spark, tmp_path):
    made = lambda n: {"t": spark.range(n)}
    path = f"file://{tmp_path}/s"

    def go(settings, more):
        stages = Stages(spark, path, settings)
        a = stages.stage("a", lambda: made(3))["t"].count()
        b = stages.stage("b", lambda: made(a + 1), more=more)["t"].count()
        return stages.made, a, b

    assert go({"x": 1}, 1) == (["a", "b"], 3, 4)
    assert go({"x": 1}, 1) == ([], 3, 4)
    assert go({"x": 1}, 2) == (["b"], 3, 4)
    assert go({"x": 2}, 2) == (["a", "b"], 3, 4)
    assert Stages(spark, path).manifest("a")["stage"] == "a" and Stages(spark, path).manifest("c") is None


def test_a_table_without_a_manifest_is_made_again(spark, tmp_path):
    spark.range(99).write.parquet(f"file://{tmp_path}/s/a/t")  # what a killed stage left
    assert Stages(spark, f"file://{tmp_path}/s").stage("a", lambda: {"t": spark.range(2)})["t"].count() == 2


def test_portions_by_question_and_by_field(spark):
    by_question, method = finetune.portioned(traces(spark), OPTIONS)
    assert method == "by question" and by_question.groupBy("question_key").agg(F.count_distinct("portion").alias("n")).where("n > 1").count() == 0
    field = traces(spark, split=lambda i: "heldout" if i % 120 < 30 else "train")
    portions, method = finetune.portioned(field, OPTIONS)
    counts = {r["portion"]: r["n"] for r in portions.groupBy("portion").agg(F.count_distinct("question_key").alias("n")).collect()}
    assert method == "split field" and counts == {"train": 90, "calibration": 15, "test": 15}
    with pytest.raises(ValueError, match="unknown split values .*dev"):
        finetune.portioned(traces(spark, split=lambda i: "dev" if i == 5 else "train"), OPTIONS)
    with pytest.raises(ValueError, match="both sides"):
        finetune.portioned(traces(spark, split=lambda i: "heldout" if i == 5 else "train"), OPTIONS)
    some = finetune.portioned(traces(spark, split=lambda i: None if i == 5 else "dev"), OPTIONS)
    assert some[1] == "by question"


def test_remarks(spark):
    counts = spark.createDataFrame([("train", 100, 9, 5), ("calibration", 0, 0, 0), ("test", 10, 3, 4)], "portion string, traces long, questions long, wrong long")
    said = lambda c, o: sorted(tuple(r) for r in finetune.remarks(c, o, named=False).collect())
    notes = [("note", "no qid or split field: runs of the same question are grouped by their question text"), ("note", "only 100 training traces; expect a noisy result below 200")]
    assert said(counts, OPTIONS) == [*notes, ("problem", "the calibration portion needs both correct and wrong traces (0 traces, 0 wrong)")]
    fine = counts.withColumn("wrong", F.lit(4)).withColumn("traces", F.col("traces") + 10)
    assert said(fine, finetune.Options(base_rates=(0.05, 0.5), least_train=1)) == [notes[0], ("problem", "base rate 0.5 needs 16 positives; there are 4")]


def test_unfit_data_stops_the_run_with_its_report(spark, tmp_path):
    path = f"file://{tmp_path}/bad"
    with pytest.raises(ValueError, match="cannot be trained on"):
        run(spark, path, traces(spark).withColumn("label", F.lit("correct")))
    assert spark.read.parquet(f"{path}/data/report").count() == 3
    with pytest.raises(ValueError, match="cannot be trained on"):
        run(spark, f"file://{tmp_path}/none", traces(spark, 0) if False else spark.createDataFrame([], traces(spark, 5).schema))


def loss(rows, t):
    total = 0.0
    for p, y in rows:
        p = min(max(p, 1e-6), 1 - 1e-6)
        q = min(max(1 / (1 + math.exp(-math.log(p / (1 - p)) / t)), 1e-9), 1 - 1e-9)
        total -= math.log(q if y else 1 - q)
    return total


def test_temperatures_against_a_grid(spark):
    groups = {"sharp": 0.4, "flat": 3.0, None: 1.0, "right": None, "against": None}
    rows = []
    for g, t in groups.items():
        for _ in range(150):
            z = RNG.gauss(0, 2)
            y = z > 0 if g == "right" else z < 0 if g == "against" else RNG.random() < 1 / (1 + math.exp(-z / t))
            rows.append((g, 1 / (1 + math.exp(-z)), bool(y)))
    rows += [("flat", None, True), ("flat", 0.5, None), ("gone", None, None), ("one", 1.0, False)]
    got = {r["g"]: r for r in E.fit_temperature(spark.createDataFrame(rows, "g string, p double, y boolean"), ["g"]).collect()}
    assert set(got) == {*groups, "one"}
    for g in groups:
        own = [(p, y) for h, p, y in rows if h == g and p is not None and y is not None]
        low, high = 0.05, 20.0
        for _ in range(5):
            grid = [low * (high / low) ** (i / 40) for i in range(41)]
            best = min(range(41), key=lambda i: loss(own, grid[i]))  # noqa: B023
            low, high = grid[max(0, best - 1)], grid[min(40, best + 1)]
        t = got[g]["temperature"]
        assert loss(own, t) <= loss(own, grid[best]) + 1e-9
        if t < 19.9 and t > 0.06:
            assert abs(t - grid[best]) < 1e-4 * t
        assert got[g]["at_bound"] == (not 0.06 < t < 19.9)
    assert got["right"]["at_bound"] and got["against"]["temperature"] == pytest.approx(20)
    assert E.fit_temperature(spark.createDataFrame([], "p double, y boolean"), []).count() == 0


def test_events_without_a_type_have_no_label(spark, tmp_path):
    """The temperature and its errors of calibration as the SQL has them, where some held-out events have no type."""
    import duckdb

    from traceloom.plans import catalogue_finetune as C
    from traceloom.plans.catalogue import SQL

    con = duckdb.connect()
    con.sql("CREATE TABLE events AS SELECT * REPLACE (CASE WHEN event_id % 10 = 3 THEN NULL ELSE event_type END AS event_type) FROM '/root/testdata/sf0.01/events.parquet'")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in C.finetune_calibration(spark, str(tmp_path)).collect()]
    assert got == con.sql(SQL["finetune_calibration"]).fetchall()
