"""Selection by counts against ordering whole groups."""

import math
import random

from traceloom.functions import scalars as S
from traceloom.operators import evaluate as E
from traceloom.operators import labels as L
from traceloom.operators.select import last_hashes, lowest_hashes, top_positives

RNG = random.Random(6)


def test_top_positives_equals_ordering(spark):
    rows = []
    for g, n, kind in [("ties", 300, 3), ("fine", 300, 10**9), ("one", 1, 5), ("same", 50, 1), (None, 40, 7), ("odd", 60, 4)]:
        for i in range(n):
            s = RNG.randrange(kind) / kind
            if g == "odd":
                s = RNG.choice([None, math.nan, math.inf, -math.inf, 0.25, -3.0])
            rows.append((g, s, RNG.random() < 0.3, i * 7919 % 1009))
    rows.append((None, None, None, 2000))
    rates = [0.01, 0.1, 0.5, 1.0]
    got = {(r["g"], r["rate"]): (r["n"], r["k"], r["positives"], r["hits"]) for r in top_positives(spark.createDataFrame(rows, "g string, p double, y boolean, pos int"), ["g"], rates, "p", "y", "pos").collect()}
    rank = lambda s: -math.inf if s is None else s
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (not (r[1] is not None and math.isnan(r[1])), -rank(r[1]) if r[1] is None or not math.isnan(r[1]) else 0, r[3]))
        for rate in rates:
            k = max(1, math.ceil(rate * len(own)))
            want[g, rate] = (len(own), k, sum(bool(r[2]) for r in own), sum(bool(r[2]) for r in own[:k]))
    assert got == want
    assert top_positives(spark.createDataFrame([], "g string, p double, y boolean, pos int"), ["g"], rates, "p", "y", "pos").count() == 0


def test_lowest_hashes_equals_ordering(spark):
    rows = [(RNG.choice(["a", "b", None]), f"{RNG.randrange(5):04x}{RNG.randrange(3):04x}", i) for i in range(400)]
    quota = {"a": 17, "b": 0, None: 1000}
    df = spark.createDataFrame([(*r, quota[r[0]]) for r in rows], "g string, h string, i int, n int")
    got = sorted((str(r["g"]), r["i"]) for r in lowest_hashes(df, ["g"], "h", "n", "i").collect())
    want = sorted((str(g), r[2]) for g in quota for r in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2]))[: quota[g]])
    assert got == want


def test_stratified_pick_with_null_labels(spark):
    df = spark.createDataFrame([(g, i) for i, g in enumerate(["a"] * 50 + ["b"] * 50 + [None] * 50)], "g string, i int")
    counts = {r["g"]: r["count"] for r in L.stratified_pick(df, "g", "i", 10, "s").groupBy("g").count().collect()}
    assert counts == {"a": 4, "b": 3, None: 3}
    assert L.stratified_pick(df.limit(0), "g", "i", 10, "s").count() == 0


def test_rebalanced_sets(spark):
    df = spark.createDataFrame([(i, i % 4 == 0) for i in range(200)], "k int, y boolean")
    sets = E.rebalanced(df, [0.1, 0.2], 3, "k").groupBy("base_rate", "resample").count().collect()
    assert sorted((r["base_rate"], r["count"]) for r in sets) == [(0.1, 167)] * 3 + [(0.2, 188)] * 3


def test_last_hash_is_the_last_of_the_lowest(spark):
    rows = [(g, f"{RNG.randrange(1 << 20):05x}{'0' * 59}", q, i) for g, n, q in [("a", 200, 37), ("b", 5, 5), ("c", 5, 0), ("d", 3, 9)] for i in range(n)]
    df = spark.createDataFrame(rows, "g string, h string, q int, i int")
    expected = {g: max((r[1], r[3]) for r in lowest_hashes(df.where(f"g = '{g}'"), ["g"], "h", "q", "i").collect()) for g in "ab"}
    assert {r["g"]: (r["h"], r["i"]) for r in last_hashes(df, ["g"], "h", "q", "i").collect()} == expected


def test_evaluated_writes_no_row_for_score_and_set(spark, monkeypatch):
    wrote = {}

    def written(df, name, keep=E.written):
        out = keep(df, name)
        wrote[name] = out.count()
        return out

    monkeypatch.setattr(E, "written", written)
    rows = [(m, k, RNG.randrange(40) / 40, k % 4 == 0) for k in range(400) for m in ("m", "n")]
    scores = spark.createDataFrame(rows, "model string, k long, p double, y boolean")
    got = {(r["model"], r["base_rate"], r["sample_rate"]): r["recall_mean"] for r in E.evaluated(scores, ["model"], "k", [0.05, 0.2], [0.1, 0.5], 3).collect()}
    assert wrote == {"evaluated-truth": 400, "evaluated-sets": 6}
    sets = E.rebalanced(scores.select("k", "y").distinct(), [0.05, 0.2], 3, "k").drop("y")
    runs = E.sampler_metrics(scores.join(sets, "k"), ["model", "base_rate", "resample"], [0.1, 0.5]).collect()
    for (model, base, rate), value in got.items():
        each = [r["recall"] for r in runs if (r["model"], r["base_rate"], r["rate"]) == (model, base, rate)]
        assert len(each) == 3 and math.isclose(value, sum(each) / 3)


def test_weights_by_digits_are_those_by_numbers(spark):
    df = E.with_weights(spark.range(500).withColumnRenamed("id", "k"), "k", 3, "b")
    u = E.F.transform(E.F.sequence(E.F.lit(1), E.F.lit(3)), lambda r: S.uniform("b", E.F.concat_ws("|", r.cast("string"), E.F.col("k").cast("string"))))
    got = df.select("weights", u.alias("u")).collect()
    assert all(list(r["weights"]) == [sum(x >= s for s in E.POISSON_STEPS) for x in r["u"]] for r in got)
    assert {w for r in got for w in r["weights"]} >= {0, 1, 2, 3}
