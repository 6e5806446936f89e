"""Streams: spans gathered into traces by quiet time and longest wait; deliveries with retries and dead letters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import backoff_for

IDLE_MS, WAIT_MS, AGE_MS = 10_000, 120_000, 3_600_000
SESSION = "trace_id string, spans array<string>, last_seq long"


class Sessions(StatefulProcessor):
    """Spans of a key until none came for idle_ms or the first is wait_ms old, in processing time. What comes later begins a new one."""

    def __init__(self, idle_ms: int = IDLE_MS, wait_ms: int = WAIT_MS, age_ms: int = AGE_MS):
        self.idle, self.wait, self.age = idle_ms, wait_ms, age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "span string, seq long", ttlDurationMs=self.age)
        self.first = handle.getValueState("first", "at long", ttlDurationMs=self.age)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for part in rows:
            self.spans.appendList(list(zip(part["span"].tolist(), part["seq"].tolist(), strict=True)))
        if not self.first.exists():
            self.first.update((now,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.handle.registerTimer(min(now + self.idle, self.first.get()[0] + self.wait))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted(self.spans.get(), key=lambda x: x[1])
        self.spans.clear()
        self.first.clear()
        if held:
            yield pd.DataFrame({"trace_id": [key[0]], "spans": [[x[0] for x in held]], "last_seq": [held[-1][1]]})

    def close(self) -> None:
        pass


def assembled(stream: DataFrame, idle_ms: int = IDLE_MS, wait_ms: int = WAIT_MS) -> DataFrame:
    """stream has trace_id, span (text), seq. Needs the RocksDB state store provider."""
    return stream.groupBy("trace_id").transformWithStateInPandas(statefulProcessor=Sessions(idle_ms, wait_ms), outputStructType=SESSION, outputMode="append", timeMode="processingTime")


def _state(spark: SparkSession, checkpoint: str, variable: str, column: str) -> DataFrame:
    """trace_id and the fields of a state variable, from a checkpoint; a variable that expires has them one level down."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()
    expires = "ttlExpirationMs" in rows.schema[column].dataType.names
    return rows.select("key.trace_id", f"{column}.value.*" if expires else f"{column}.*")


def held_spans(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(trace_id, span, seq): what a stopped query of assembled() holds in its state, by its checkpoint: neither lost nor given out yet."""
    return _state(spark, checkpoint, "spans", "list_element")


def held_traces(spark: SparkSession, checkpoint: str) -> DataFrame:
    """trace_id, spans, last_seq, first_at of the traces that a stopped query holds; first_at: when the first span came."""
    first = _state(spark, checkpoint, "first", "value").select("trace_id", F.timestamp_millis("at").alias("first_at"))
    counts = held_spans(spark, checkpoint).groupBy("trace_id").agg(F.count("*").alias("spans"), F.max("seq").alias("last_seq"))
    return counts.join(first, "trace_id", "left")


def recovery_audit(sent: DataFrame, given: DataFrame, held: DataFrame) -> DataFrame:
    """span, trace_id, seq, times: spans that aren't exactly once in what was given out and what is held together; none in a sound run.

    sent: trace_id, span, seq of what the query has taken in; given: rows of assembled(); held: of held_spans().
    """
    out = given.select("trace_id", F.explode("spans").alias("span")).unionByName(held.select("trace_id", "span"))
    counts = out.groupBy("trace_id", "span").agg(F.count("*").alias("times"))
    wanted = sent.groupBy("trace_id", "span").agg(F.count("*").alias("sent"), F.max("seq").alias("seq"))
    both = wanted.join(counts, ["trace_id", "span"], "full").fillna(0, ["sent", "times"])
    return both.where("sent <> times").select("span", "trace_id", "seq", "times")


def idle_sessions(df: DataFrame, key: str, at: str, idle_s: float, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with `session`, 1 and up within a key: a gap of idle_s seconds or more begins one. ties: columns that order equal times.

    A key's arrivals are ordered in one task, as each session's place depends on all before it.
    """
    order = Window.partitionBy(key).orderBy(at, *ties)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(order).cast("timestamp"))
    start = F.when(gap.isNull() | (gap >= int(idle_s * 1e6)), 1).otherwise(0)
    return df.withColumn("_s", start).withColumn("session", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def replayed_sessions(df: DataFrame, key: str, at: str, idle_s: float, wait_s: float) -> DataFrame:
    """key, session, n, first_us, last_us: the streaming rule over recorded arrivals, with the longest wait too.

    A greedy fold over a key's arrivals in order; only the arrival times travel, sorted within their partition, and a
    task holds one session at a time.
    """
    rows = df.select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).repartition("key").sortWithinPartitions("key", "us")
    idle, wait = int(idle_s * 1e6), int(wait_s * 1e6)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, n, first, last = None, 0, 0, 0, 0
        for part in parts:
            out = []
            for k, us in zip(part["key"].tolist(), part["us"].tolist(), strict=True):
                if n and (k != now or us - last >= idle or us - first >= wait):
                    out.append((now, number, n, first, last))
                    n = 0
                if k != now:
                    now, number = k, 0
                if not n:
                    number, first = number + 1, us
                n, last = n + 1, us
            yield pd.DataFrame(out, columns=["key", "session", "n", "first_us", "last_us"])
        if n:
            yield pd.DataFrame([(now, number, n, first, last)], columns=["key", "session", "n", "first_us", "last_us"])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(fold, f"key {kind}, session long, n long, first_us long, last_us long").withColumnRenamed("key", key)


#: Seconds before each further delivery; after the last one a message is a dead letter.
WAITS = (5.0, 30.0, 120.0, 300.0)


def settle(results: DataFrame, most: int = 5, waits: tuple[float, ...] = WAITS) -> DataFrame:
    """results (deliveries, error_kind) with outcome sent, retried or dead, and the wait in seconds. Invalid ones are dead at once."""
    bad = F.col("error_kind").isin("invalid", "rejected")
    outcome = F.when(F.col("error_kind").isNull(), "sent").when(bad | (F.col("deliveries") >= most), "dead").otherwise("retried")
    out = results.withColumn("outcome", outcome)
    return out.withColumn("wait_s", F.when(F.col("outcome") == "retried", backoff_for(F.col("deliveries"), waits)))


def deliver_batch(send, retry_path: str, dead_path: str):
    """A foreachBatch function: send(df) adds error_kind; what is to come again and what is dead are appended by batch id, so a replay overwrites itself."""

    def each(df: DataFrame, batch_id: int) -> None:
        done = settle(send(df)).persist()
        done.where("outcome = 'retried'").write.mode("overwrite").parquet(f"{retry_path}/batch={batch_id}")
        done.where("outcome = 'dead'").write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")
        done.unpersist()

    return each


#: Traces that may wait for a worker.
WAITING = 100_000


def publish(messages: DataFrame, held: DataFrame, bound: int = WAITING) -> DataFrame:
    """messages (trace_id, last_seq, at, ...) with message_id and outcome: queued, repeated or full.

    A message is known by trace and last span, so one that is sent again, in this batch or while `held` (message_id) has it,
    is repeated. Of the rest as many as there are places are queued, by `at`, then id; others are full and are to come again.
    `bound` limits what one task orders.
    """
    tagged = messages.withColumn("message_id", F.concat_ws(":", "trace_id", F.col("last_seq").cast("string")))
    first = tagged.groupBy("message_id").agg(F.min("at").alias("at")).join(held.select("message_id"), "message_id", "left_anti")
    places = max(0, bound - held.count())
    queued = first.orderBy("at", "message_id").limit(places).select("message_id", F.lit("queued").alias("_o"))
    left = first.select("message_id", F.lit(True).alias("_new"))
    order = Window.partitionBy("message_id").orderBy("at")
    out = tagged.join(left, "message_id", "left").join(F.broadcast(queued), "message_id", "left").withColumn("_n", F.row_number().over(order))
    outcome = F.when(F.col("_new").isNull() | ((F.col("_n") > 1) & F.col("_o").isNotNull()), "repeated").otherwise(F.coalesce("_o", F.lit("full")))
    return out.withColumn("outcome", outcome).drop("_new", "_o", "_n")


def depth(messages: DataFrame) -> DataFrame:
    """queue, depth: messages neither acknowledged nor dead, whether waiting or out with a worker."""
    return messages.where("state IN ('pending', 'delivered')").groupBy("queue").agg(F.count("*").alias("depth"))


def drained(query, seconds: float = 30.0) -> bool:
    """Waits until a streaming query has taken all that its source holds, then stops it; False if the time runs out.

    What was taken is in its checkpoint, so stopping counts no attempt against a message."""
    import time

    until = time.monotonic() + seconds
    while time.monotonic() < until and query.isActive:
        if not query.status["isDataAvailable"] and not query.status["isTriggerActive"] and query.lastProgress is not None:
            query.stop()
            return True
        time.sleep(0.2)
    return False
