"""Calibrate, decide, fall back; scorer results and their errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import calibrate, uniform

KEEP_FROM, RANDOM_FLOOR, HIGH_FROM = 0.5, 0.02, 0.8
#: Kinds of error worth another try, and those that are the request's own fault.
RETRYABLE = ("unavailable", "timeout", "full")
REJECTED = ("invalid", "rejected")
SCORE = "raw double, model string, latency_ms double, attempts int, error_kind string"


def decide(df: DataFrame, p: str = "p_keep", u: str = "u", keep_from: float = KEEP_FROM, floor: float = RANDOM_FLOOR, high_from: float = HIGH_FROM) -> DataFrame:
    """Adds keep, reason, severity. A null p is a trace the model couldn't score: a random share is kept (fallback)."""
    scored, lucky = F.col(p).isNotNull(), F.col(u) < floor
    reached = scored & (F.col(p) >= keep_from)
    df = df.withColumn("keep", reached | lucky)
    reason = F.when(~scored, "fallback").when(reached, "kev").when(lucky, "random_floor").otherwise("below_threshold")
    severity = F.when(~F.col("keep"), "none").when(scored & (F.col(p) >= high_from), "high").otherwise("normal")
    return df.withColumns({"reason": reason, "severity": severity})


def error_kind(http_status: Column) -> Column:
    """What an HTTP status means for a request: null when it went well."""
    return F.when(http_status.between(200, 299), None).when(http_status.isin(400, 413, 422), "rejected").otherwise("unavailable")


def route(df: DataFrame, models: DataFrame, default: str, agent: str = "agent") -> DataFrame:
    """Adds model and agent_label (the agent if it is configured, `other`, or `none` without one). models is configuration: small."""
    known = models.select(F.col("agent").alias("_agent"), F.col("model").alias("_model"))
    df = df.join(F.broadcast(known), F.col(agent) == F.col("_agent"), "left")
    label = F.when(F.coalesce(F.col(agent), F.lit("")) == "", "none").when(F.col("_agent").isNull(), "other").otherwise(F.col(agent))
    return df.withColumns({"model": F.coalesce("_model", F.lit(default)), "agent_label": label}).drop("_agent", "_model")


def scored(df: DataFrame, make: Callable[[], Callable[[str, str], dict]], attempts: int = 3) -> DataFrame:
    """Adds score, a struct of SCORE, from make()(model, state); make() runs once a task and may hold a connection.

    The call gives {"raw": p, "model": name, "latency_ms": t} or {"error_kind": kind}; retryable kinds are tried again.
    """

    @F.pandas_udf(SCORE)
    def ask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = make()
        for models, states in parts:
            rows = []
            for model, state in zip(models, states, strict=True):
                for attempt in range(1, attempts + 1):
                    got = call(model, state)
                    if got.get("error_kind") not in RETRYABLE:
                        break
                raw = got.get("raw")
                if raw is not None and not 0 <= raw <= 1:
                    raw, got = None, {"error_kind": "invalid"}
                rows.append((raw, got.get("model") or model, got.get("latency_ms"), attempt, got.get("error_kind")))
            yield pd.DataFrame(rows, columns=["raw", "model", "latency_ms", "attempts", "error_kind"])

    return df.withColumn("score", ask.asNondeterministic()("model", "state"))


def local_scorer() -> Callable[[str, str], dict]:
    """A stand-in for a model: a hash of the state as a probability."""
    import hashlib

    return lambda model, state: {"raw": int(hashlib.sha256(state.encode()).hexdigest()[:13], 16) / (1 << 52), "model": model, "latency_ms": 0.0}


def run_engine(traces: DataFrame, models: DataFrame, make=local_scorer, default: str = "base", temperature: float = 1.0, on_system_error: str = "fallback", seed: str = "floor") -> DataFrame:
    """Traces to decisions: route, slice, score, calibrate, decide. With on_system_error='retry' rows the model couldn't
    take for a passing reason carry retry = true and no decision, for the queue to bring again."""
    from .traces import build_state, problems, rendered

    df = build_state(rendered(problems(traces)))
    df = scored(route(df, models, default), make)
    df = df.withColumn("p_keep", calibrate(F.col("score.raw"), temperature)).withColumn("u", uniform(seed, F.col("trace_id")))
    df = decide(df).withColumn("retry", F.col("score.error_kind").isin(*RETRYABLE) if on_system_error == "retry" else F.lit(False))
    return df.select("*", F.col("score.raw").alias("p_keep_raw"), F.col("score.latency_ms").alias("latency_ms")).drop("score", "u")


def api_result(decisions: DataFrame) -> DataFrame:
    """What a caller sees: probabilities are null when nothing was scored."""
    scored_ = F.col("reason") != "fallback"
    return decisions.select("trace_id", F.when(F.col("keep"), "keep").otherwise("drop").alias("decision"), "reason", "severity", F.when(scored_, F.col("p_keep")).alias("p_keep"), F.when(scored_, F.col("p_keep_raw")).alias("p_keep_raw"))
