"""Made-up traces for trying things out: labelled ones of four kinds of failure, and odd ones for the slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.traces import TOOL_CALLS

#: Ways in which a made-up trace fails.
FAILURES = ("wrong_fact", "no_search", "tool_error", "short_answer")


def labelled_traces(spark: SparkSession, n: int, questions: int | None = None, wrong_share: float = 0.3, seed: str = "made") -> DataFrame:
    """n traces over fewer questions (two thirds), each with label, failure_type and qid; the same for a seed on every cluster.

    A trace is wrong with probability wrong_share and then fails in one of FAILURES: another town's figure as the answer,
    no call at all, a failed call, or an answer of one word.
    """
    over = questions or max(1, n * 2 // 3)
    df = spark.range(n).withColumn("q", F.col("id") % over)
    df = df.withColumn("wrong", S.uniform(f"{seed}-wrong", F.col("id")) < wrong_share)
    at = F.floor(S.uniform(f"{seed}-how", F.col("id")) * len(FAILURES)).cast("int") + 1
    df = df.withColumn("failure_type", F.when(F.col("wrong"), F.element_at(F.array(*map(F.lit, FAILURES)), at)))
    figure = lambda q: F.concat((1000 + F.floor(S.uniform(f"{seed}-figure", q) * 9000)).cast("string"), F.lit(" people"))
    town = F.concat(F.lit("Town "), F.col("q").cast("string"))
    told = F.concat(town, F.lit(" has "), figure(F.col("q")), F.lit("."))
    failed, silent = F.col("failure_type") == "tool_error", F.col("failure_type") == "no_search"
    call = F.struct(F.lit("search").alias("name"), F.to_json(F.struct(town.alias("query"))).alias("args_json"), F.when(failed, '"error"').otherwise('"ok"').alias("status_json"))
    unsure = F.coalesce(failed | silent, F.lit(False))
    answer = F.when(F.col("failure_type") == "short_answer", "Unknown").when(F.col("wrong"), F.concat(town, F.lit(" has "), figure(F.col("id") + over + 1), F.lit("."))).otherwise(told)
    return df.select(
        F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))).alias("trace_id"), F.lit("made-up").alias("agent"), F.concat(F.lit("How many people live in "), town, F.lit("?")).alias("question"),
        F.when(F.coalesce(silent, F.lit(False)), F.array().cast(TOOL_CALLS)).otherwise(F.array(call).cast(TOOL_CALLS)).alias("tool_calls"),
        F.when(unsure, F.array().cast("array<string>")).otherwise(F.array(told)).alias("evidence"), answer.alias("final_answer"),
        F.when(F.col("wrong"), "wrong").otherwise("correct").alias("label"), "failure_type", F.concat(F.lit("q"), F.col("q").cast("string")).alias("qid"), (~F.coalesce(silent, F.lit(False))).alias("used_search"),
    )


def odd_traces(spark: SparkSession, n: int, seed: str = "odd") -> DataFrame:
    """n traces whose texts are drawn from all code points but surrogates, with none to five calls and pieces of evidence, some empty."""

    def text(name: str, most: int):
        places = F.sequence(F.lit(1), F.floor(S.uniform(f"{seed}-{name}-size", F.col("id")) * most).cast("int") + 1)
        def letter(i):
            k = F.floor(S.uniform(f"{seed}-{name}", F.concat_ws(":", F.col("id").cast("string"), i.cast("string"))) * (0x110000 - 0x801)).cast("int") + 1
            point = F.when(k >= 0xD800, k + 0x800).otherwise(k)
            return F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32")
        return F.array_join(F.transform(places, letter), "")

    some = lambda name, item: F.slice(F.array(*[item(i) for i in range(5)]), F.lit(1), F.floor(S.uniform(f"{seed}-{name}-n", F.col("id")) * 6).cast("int"))
    call = lambda i: F.struct(F.lit(f"tool{i}").alias("name"), F.to_json(F.struct(text(f"arg{i}", 12).alias("x"))).alias("args_json"), F.lit('"ok"').alias("status_json"))
    return spark.range(n).select(
        F.md5(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"))).alias("trace_id"), F.lit(None).cast("string").alias("agent"), text("question", 40).alias("question"),
        some("calls", call).cast(TOOL_CALLS).alias("tool_calls"), some("evidence", lambda i: text(f"evidence{i}", 30)).alias("evidence"), text("answer", 40).alias("final_answer"),
    )


def write_golden(traces: DataFrame, path: str) -> None:
    """Each trace's id, slice and its digest as Parquet: a snapshot to hold later versions against with differs()."""
    from ..operators.traces import build_state, rendered

    build_state(rendered(traces)).select("trace_id", "state", F.sha2("state", 256).alias("state_id")).write.parquet(path)


def differs(traces: DataFrame, path: str) -> DataFrame:
    """trace_id, was, now of traces whose slice isn't the snapshot's, on either side."""
    from ..operators.traces import build_state, rendered

    now = build_state(rendered(traces)).select("trace_id", F.col("state").alias("now"))
    was = traces.sparkSession.read.parquet(path).select("trace_id", F.col("state").alias("was"))
    return was.join(now, "trace_id", "full").where(~F.col("was").eqNullSafe(F.col("now"))).select("trace_id", "was", "now")


def row_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, n_questions (distinct qid) and a digest of the rows, whatever their order: 16 hex digits."""
    each = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("n"), F.count_distinct("qid").alias("n_questions"), F.substring(F.sha2(F.concat_ws("|", F.sum(each.cast("decimal(38,0)")).cast("string"), F.bit_xor(each).cast("string")), 256), 1, 16).alias("digest"))
