"""Points by attribute set: of a table, of a batch query as it runs, of a stream."""

import json
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from traceloom.streaming import metrics as M

ROWS = [("a", None, 0.0005), ("a", None, 0.3), ("a", "timeout", 70.0), ("b", None, 0.005), ("b", "timeout", None), ("c", None, 1.0)]
SCHEMA = "agent string, kind string, seconds double"
SETS = M.attribute_sets(observer__agent=["a", "b"], observer__model=["m"], error__type=[None, "timeout"])


def told(df):
    return M.score_attributes(df["agent"], F.lit("m"), df["kind"]), df["seconds"]


def plain(rows):
    """Points by comparing every measurement with every bound."""
    out = {}
    for agent, kind, s in rows:
        found = json.dumps({**({"error.type": kind} if kind else {}), "observer.agent": agent, "observer.model": "m"}, separators=(",", ":"))
        for le in M._LE:
            n, total = out.get((found, le), (0, 0.0))
            out[found, le] = (n + (le == float("inf") or (s is not None and s <= le)), total + (s or 0.0))
    return out


def shown(points):
    return {(r[0], r[1]): (r[2], pytest.approx(r[3])) for r in points}


def test_error_type_on_failures_alone(spark):
    df = spark.createDataFrame([(200, None, True), (404, "timeout", False), (503, None, True)], "status int, kind string, keep boolean")
    http = [json.loads(r[0]) for r in df.select(M.http_attributes(F.lit("api"), F.lit("POST"), F.lit("/v1"), F.col("status"))).collect()]
    assert [x.get("error.type") for x in http] == [None, None, "503"] and http[0]["http.response.status_code"] == "200"
    rpc = [json.loads(r[0]) for r in df.select(M.rpc_attributes(F.lit("otlp"), F.lit("m"), F.col("status") - 200)).collect()]
    assert [x.get("error.type") for x in rpc] == [None, "204", "303"]
    send = [r[0] for r in df.select(M.send_attributes(F.lit("x"), F.col("kind"))).collect()]
    assert send == ['{"observer.exporter":"x"}', '{"error.type":"timeout","observer.exporter":"x"}', '{"observer.exporter":"x"}']
    decided = [json.loads(r[0])["observer.decision"] for r in df.select(M.decision_attributes(F.lit("a"), F.lit("m"), F.col("keep"), F.lit("kev"))).collect()]
    assert decided == ["keep", "drop", "keep"]


def test_points_of_a_table_and_of_a_running_query(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = plain(ROWS)
    assert shown(M.points(df, *told(df)).collect()) == want
    counted = M.points(df, M.fault_attributes(F.col("agent"), F.col("kind"))).where(F.col("le") == float("inf"))
    assert {json.loads(r["attributes"]).get("error.type"): r["n"] for r in counted.where("attributes LIKE '%\"b\"%'").collect()} == {None: 1, "timeout": 1}
    seen = Observation("o")
    assert M.observed(df, seen, SETS, *told(df)).count() == len(ROWS)
    got = M.observed_points(seen.get, SETS)
    known = {k: v for k, v in want.items() if '"c"' not in k[0]}
    assert {k: v for k, v in shown(got).items() if k[0] != M.OTHER} == known
    assert [(le, n) for a, le, n, _ in got if a == M.OTHER] == [(le, int(le >= 1.0)) for le in M._LE]
    assert M.points(df.limit(0), *told(df)).count() == 0 and df.columns == M.observed(df, "x", SETS, *told(df)).columns


def test_stream_agrees_with_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(dict(zip(("agent", "kind", "seconds"), r, strict=True))) + "\n" for r in ROWS[2 * k : 2 * k + 2]))
    path = str(tmp_path / "points")
    listener = M.PointListener("points", SETS, M.appended_points(spark, path))
    spark.streams.addListener(listener)
    try:
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = M.observed(df, "points", SETS, *told(df)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        end = time.time() + 60
        while time.time() < end and len(list((tmp_path / "points").glob("query=*/batch=*/_SUCCESS"))) < 3:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    batch = spark.createDataFrame(ROWS, SCHEMA)
    known = {k: v for k, v in shown(M.points(batch, *told(batch)).collect()).items() if '"c"' not in k[0]}
    got = shown(M.summed(spark.read.parquet(path)).select("attributes", "le", "n", "total").collect())
    assert {k: (v[0], v[1].expected) for k, v in got.items() if k[0] != M.OTHER} == {k: (v[0], v[1]) for k, v in known.items()}
