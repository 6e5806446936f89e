"""Assembled sessions over restarts: what is given out and what is held are together what came in."""

import time

import pytest
from pyspark.sql import functions as F

from traceloom.streaming import assembly as A

SCHEMA = "trace_id string, span string, seq long"


class Feed:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.seq = spark, folder, 0
        (folder / "in").mkdir()

    def add(self, traces):
        rows = []
        for t in traces:
            self.seq += 1
            rows.append((t, f"s{self.seq}", self.seq))
        name = self.folder / f"{self.seq}.json"
        name.write_text("".join(f'{{"trace_id":"{t}","span":"{s}","seq":{n}}}\n' for t, s, n in rows))
        name.rename(self.folder / "in" / name.name)

    def sent(self):
        return self.spark.read.schema(SCHEMA).json(f"{self.folder}/in")

    def turn(self, rows, idle=1500, rest=0.0):
        """Runs until so many rows are taken in (a query with timers never ends by itself), and then for a while, and is stopped."""
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{self.folder}/in")
        out = A.assembled(stream, idle, 60_000)
        query = out.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/marks").start()
        end = time.time() + 100
        while sum(p["numInputRows"] for p in query.recentProgress) < rows and time.time() < end:
            time.sleep(0.1)
            assert query.exception() is None
        time.sleep(rest)
        query.stop()  # between batches, or within one: its offsets are written, its commit perhaps not

    def given(self):
        return self.spark.read.schema(A.SESSION).parquet(f"{self.folder}/out")

    def held(self):
        return A.held_spans(self.spark, f"{self.folder}/marks")


@pytest.fixture
def feed(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield Feed(spark, tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_no_span_is_lost_or_repeated_over_restarts(feed):
    feed.add(["a", "a", "b"])
    feed.turn(3, idle=600_000)  # stopped with a and b in its state
    assert sorted((r["trace_id"], r["spans"]) for r in A.held_traces(feed.spark, f"{feed.folder}/marks").collect()) == [("a", 2), ("b", 1)]
    feed.add(["a", "c"])
    feed.add(["c", "d"])
    feed.turn(2, idle=600_000)  # stopped with a file left, or in its midst
    feed.add(["a", "b", "c", "d"])
    feed.turn(4, idle=1, rest=4)
    given = feed.given()
    assert A.recovery_audit(feed.sent(), given, feed.held()).count() == 0
    spans = [s for r in given.collect() for s in r["spans"]]
    assert len(spans) == len(set(spans)) >= 1
    assert all([int(s[1:]) for s in r["spans"]] == sorted(int(s[1:]) for s in r["spans"]) and r["last_seq"] == int(r["spans"][-1][1:]) for r in given.collect())


def test_audit_names_what_is_wrong(spark):
    sent = spark.createDataFrame([("a", "s1", 1), ("a", "s2", 2), ("b", "s3", 3)], SCHEMA)
    given = spark.createDataFrame([("a", ["s1", "s1"], 1)], A.SESSION)
    held = spark.createDataFrame([("c", "s9", 9), ("b", "s3", 3)], SCHEMA)
    found = {(r["trace_id"], r["span"], r["times"]) for r in A.recovery_audit(sent, given, held).collect()}
    assert found == {("a", "s1", 2), ("a", "s2", 0), ("c", "s9", 1)}
    assert A.recovery_audit(sent, given.limit(0), sent).where(F.lit(True)).count() == 0
