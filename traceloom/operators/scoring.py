"""Replies of scorers: what they say, how long they took, what is kept of them for the next run, and what they cost."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .policy import scored

#: Names of the two questions.
WRONG, KEEP = "answer_wrong", "keep_or_drop"


def expected_answers(label: Column) -> Column:
    """What a model should answer for a label; null without one. Partial answers are wrong."""
    wrong = label != "correct"
    return F.when(label.isNotNull(), F.struct(wrong.alias(WRONG), F.when(wrong, "keep").otherwise("drop").alias(KEEP)))


def _number(reply: Column, path: str) -> Column:
    """A JSON number at a path; null for anything else, text of digits too."""
    kind = F.schema_of_variant(F.try_variant_get(reply, path, "variant"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(reply, path, "double"))


def read_reply(body: Column, asked: Column | str, measured_ms: Column) -> Column:
    """struct(answer_wrong, keep_or_drop, model, latency_ms, error_kind) of a scorer's JSON reply.

    answer_wrong is its noul, keep_or_drop the probability of keep. A reply that isn't JSON, or whose noul is missing or
    outside [0, 1], is invalid and has no answers. The model is the one that says it answered, else the one asked; the
    latency what the server reports, else what was measured.
    """
    reply = F.try_parse_json(body)
    noul, keep = _number(reply, f"$.answers.{WRONG}.noul"), _number(reply, f"$.answers.{KEEP}.probabilities.keep")
    fine = F.coalesce(noul.between(0, 1), F.lit(False)) & S.is_json_object(body)
    said = F.nullif(F.try_variant_get(reply, "$.model", "string"), F.lit(""))
    took = F.coalesce(_number(reply, "$.latency_ms"), _number(reply, "$.evaluation_time_ms"), measured_ms)
    return F.struct(
        F.when(fine, noul).alias(WRONG), F.when(fine & keep.between(0, 1), keep).alias(KEEP),
        F.coalesce(said, asked if isinstance(asked, Column) else F.lit(asked)).alias("model"), took.alias("latency_ms"), F.when(~fine, "invalid").alias("error_kind"),
    )


def cache_key(*parts: Column) -> Column:
    """One digest of what decides an answer (server, model, questions, state); null parts differ from empty ones."""
    return F.sha2(F.to_json(F.array(*[F.to_json(F.struct(p.alias("v"))) for p in parts])), 256)


def latest_answers(cache: DataFrame) -> DataFrame:
    """Of each key of an append-only cache (key, seq, answer columns) the row that was written last."""
    rest = [c for c in cache.columns if c not in ("key", "seq")]
    return cache.groupBy("key").agg(F.max_by(F.struct(*rest), "seq").alias("_a")).select("key", "_a.*")


def score_with_cache(rows: DataFrame, cache: DataFrame, make: Callable[[], Callable[[str, str], dict]]) -> tuple[DataFrame, DataFrame]:
    """rows (key, model, state) with score, and what is to be appended to the cache (key, score).

    Only states whose key the cache lacks are scored, each distinct key once. Failed calls aren't kept.
    """
    held = latest_answers(cache)
    missing = rows.join(held.select("key"), "key", "left_anti").dropDuplicates(["key"])
    new = scored(missing.select("key", "model", "state"), make).select("key", "score")
    both = held.select("key", "score").unionByName(new)
    return rows.join(both, "key", "left"), new.where("score.error_kind IS NULL")


def fits_window(df: DataFrame, most: int, state: str = "state") -> DataFrame:
    """Adds state_tokens, four characters to a token, rounded up, and fits: within the window of `most` tokens."""
    return df.withColumn("state_tokens", F.ceil(S.approx_tokens(F.col(state)))).withColumn("fits", F.col("state_tokens") <= most)


def training_window(df: DataFrame, tokens: Column, questions: list[int], state: int, branch: int, packed: int) -> DataFrame:
    """Adds state_tokens and which limits a training record breaks: its state alone, with its longest question, with all of
    them (questions: the tokens of each); fits: none of them. Records without tokens (null) fit nothing."""
    n = F.col("state_tokens")
    df = df.withColumn("state_tokens", tokens.cast("long"))
    over = {"over_state": n > state, "over_branch": n + max(questions, default=0) > branch, "over_packed": n + sum(questions) > packed}
    return df.withColumns({k: F.coalesce(v, F.lit(True)) for k, v in over.items()}).withColumn("fits", ~(F.col("over_state") | F.col("over_branch") | F.col("over_packed")))


def kept_in_window(df: DataFrame, most_dropped: float) -> DataFrame:
    """Records that fit; an error if a larger share than most_dropped doesn't. An empty table fits."""
    dropped = window_report(df).first()
    if (dropped["over_share"] or 0) > most_dropped:
        raise ValueError(f"{dropped['over']} of {dropped['n']} records exceed the training window (limit {most_dropped:.0%}); raise it")
    return df.where("fits")


def window_report(df: DataFrame) -> DataFrame:
    """One row: rows, those over the window, and their share; of fits_window()."""
    return df.agg(F.count("*").alias("n"), F.count_if(~F.col("fits")).alias("over"), F.avg((~F.col("fits")).cast("int")).alias("over_share"))


def costs(records: DataFrame, by: str = "model") -> DataFrame:
    """by, latency quantiles, mean tokens of the answers that tell them, traces scored, all tokens, and states cut short."""
    return records.groupBy(by).agg(
        F.percentile("latency_ms", F.lit(0.5)).alias("latency_p50_ms"), F.percentile("latency_ms", F.lit(0.95)).alias("latency_p95_ms"),
        F.avg("input_tokens").alias("input_tokens_per_trace"), F.count("*").alias("traces_scored"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens_total"), F.count_if("truncated").alias("truncated"),
    )


def signals(scores: DataFrame) -> DataFrame:
    """A long table (model, trace_id, y, signal, p) of both signals of each row; signals without a value are left out."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("p")) for s in (WRONG, KEEP)]))
    return scores.select("model", "trace_id", "y", each.alias("s")).select("model", "trace_id", "y", "s.*").where("p IS NOT NULL")
