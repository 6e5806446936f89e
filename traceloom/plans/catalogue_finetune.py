"""Queries of the finetuning run: what a check says, fitted temperatures, and the decisions at the end of all stages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import scoring as C
from . import finetune
from .catalogue import _u, query, r6, table
from .tables import shared_dir

#: Scores that know something of the truth: more for errors, more for large values.
_P1 = "(0.05::DOUBLE + 0.5::DOUBLE * (value / 500.0::DOUBLE) + CASE WHEN event_type = 'error' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"
_P2 = "(0.02::DOUBLE + 0.6::DOUBLE * (value / 500.0::DOUBLE) + CASE WHEN event_type = 'error' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END)"


def _score(base: float, slope: float, more: float):
    return F.lit(base) + F.lit(slope) * (F.col("value") / 500.0) + F.when(F.col("event_type") == "error", more).otherwise(0.0)


def _newton(of: str, by: str, rounds: int = 12) -> str:
    """SQL of the inverse temperature with the least loss of each group of (by, z, y), by Newton's step from 1."""
    text = f"n0 AS (SELECT DISTINCT {by}, 1.0::DOUBLE AS b FROM {of})"
    for k in range(rounds):
        text += f""",
n{k + 1} AS (SELECT {by}, least(greatest(b - avg(z * (1 / (1 + exp(-b * z)) - y)) / avg(z * z / (1 + exp(-b * z)) / (1 + exp(b * z))), 0.05::DOUBLE), 20.0::DOUBLE) AS b FROM {of} JOIN n{k} USING ({by}) GROUP BY {by}, b)"""
    return text + f", fitted AS (SELECT {by}, 1 / b AS t FROM n{rounds})"


@query(f"""WITH p AS (SELECT user_id % 4 AS b4, least(greatest({_P1} - (user_id % 4) * 0.04::DOUBLE, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p, (event_type = 'error')::INT::DOUBLE AS y FROM events),
c AS (SELECT b4, ln(p / (1 - p)) AS z, y FROM p), {_newton('c', 'b4')}
SELECT b4 AS bucket, round(t, 5) AS temperature, NOT (t > 0.06 AND t < 19.9) AS at_bound FROM fitted""")
def temperature_fit(spark, sf):
    bucket = F.col("user_id") % 4
    scores = table(spark, sf, "events").select(bucket.alias("bucket"), (_score(0.05, 0.5, 0.3) - bucket * F.lit(0.04)).alias("p"), (F.col("event_type") == "error").alias("y"))
    return E.fit_temperature(scores, ["bucket"]).select("bucket", F.round("temperature", 5).alias("temperature"), "at_bound")


_PORTIONS = """k AS (SELECT user_id FROM events GROUP BY user_id), h AS (SELECT user_id FROM k ORDER BY sha256('7-held|' || user_id), user_id LIMIT (SELECT round_even(count(*) * 0.4::DOUBLE, 0)::BIGINT FROM k)),
cal AS (SELECT user_id FROM h ORDER BY sha256('7-calib|' || user_id), user_id LIMIT (SELECT round_even(count(*) * 0.5::DOUBLE, 0)::BIGINT FROM h)),
po AS (SELECT *, CASE WHEN user_id IN (SELECT user_id FROM cal) THEN 'calibration' WHEN user_id IN (SELECT user_id FROM h) THEN 'test' ELSE 'train' END AS portion FROM events)"""
_OPTIONS = finetune.Options(heldout=0.4, base_rates=(0.05, 0.1), sample_rates=(0.1, 0.25), sample_rate=0.1, resamples=2, least_train=100_000, keep_from=0.45, floor=0.1, high_from=0.6)


def _labelled(spark, sf):
    """Events as labelled traces: a user is a question, an error is wrong; without a type there is no label."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").cast("string").alias("trace_id"), F.col("user_id").alias("qid"), F.col("user_id").alias("question_key"), F.lit(None).cast("string").alias("split"), F.when(F.col("event_type") == "error", "wrong").when(F.col("event_type").isNotNull(), "correct").alias("label"), "event_id", "event_type", "value", (F.col("event_id") % 7).cast("double").alias("seven"), (-F.col("value")).alias("less"))


def _served(model: str, base: float, slope: float, more: float) -> finetune.Scorer:
    """A scorer whose replies are JSON, as a server writes them, read as such."""

    def score(rows):
        answers = F.struct(F.struct(_score(base, slope, more).alias("noul")).alias(C.WRONG), F.struct(F.struct((F.col("value") / 1000).alias("keep")).alias("probabilities")).alias(C.KEEP))
        body = F.to_json(F.struct(answers.alias("answers"), F.lit(model).alias("model"), (F.col("event_id") % 50).alias("latency_ms")))
        return rows.withColumn("_r", C.read_reply(body, model, F.lit(0.0))).select("*", "_r.answer_wrong", "_r.keep_or_drop", "_r.latency_ms")

    return score


_RULES = ["seven", "less"]


def _run(spark, sf, until):
    path = f"{shared_dir(spark)}/finetune-{uuid.uuid4().hex}"
    return finetune.run(spark, path, _labelled(spark, sf), _served("released", 0.05, 0.5, 0.3), lambda train: _served("tuned", 0.02, 0.6, 0.35), _RULES, _OPTIONS, until)


@query(f"""WITH {_PORTIONS}, r AS (SELECT portion, count(*) AS traces, count(DISTINCT user_id) AS questions, count(*) FILTER (event_type = 'error') AS wrong FROM po GROUP BY portion)
SELECT portion, traces, questions, wrong, CASE WHEN portion = 'train' THEN 'only ' || traces || ' training traces; expect a noisy result below 100000' WHEN portion = 'test' AND round_even((traces - wrong) * 0.9::DOUBLE / (1 - 0.9::DOUBLE), 0) > wrong
  THEN 'base rate 0.9 needs ' || round_even((traces - wrong) * 0.9::DOUBLE / (1 - 0.9::DOUBLE), 0)::BIGINT || ' positives; there are ' || wrong END AS remark FROM r""")
def finetune_check(spark, sf):
    options = finetune.Options(heldout=0.4, base_rates=(0.05, 0.9), least_train=100_000)
    _, counts, said = finetune.check(_labelled(spark, sf), options)
    of = F.when(F.col("text").startswith("only"), "train").when(F.col("text").startswith("base rate"), "test")
    return counts.join(said.select(of.alias("portion"), F.col("text").alias("remark")), "portion", "left").select("portion", "traces", "questions", "wrong", "remark")


@query(f"""WITH {_PORTIONS}, c AS (SELECT 1 AS one, ln({_P2} / (1 - {_P2})) AS z, (event_type = 'error')::INT::DOUBLE AS y FROM po WHERE portion = 'calibration'), {_newton('c', 'one')},
d AS (SELECT event_id, 1 / (1 + exp(-ln({_P2} / (1 - {_P2})) / t)) AS p, {_u('7-floor', 'event_id')} AS u FROM po, fitted WHERE portion = 'test')
SELECT event_id::VARCHAR AS trace_id, round(p, 6) AS p_keep, p >= 0.45::DOUBLE OR u < 0.1::DOUBLE AS keep, CASE WHEN p >= 0.45::DOUBLE THEN 'kev' WHEN u < 0.1::DOUBLE THEN 'random_floor' ELSE 'below_threshold' END AS reason,
  CASE WHEN p >= 0.6::DOUBLE THEN 'high' WHEN p >= 0.45::DOUBLE OR u < 0.1::DOUBLE THEN 'normal' ELSE 'none' END AS severity FROM d""")
def finetune_decisions(spark, sf):
    """From the split to decisions, through every stage and its tables."""
    return _run(spark, sf, "decisions")["decisions"]["decisions"].select("trace_id", r6("p_keep").alias("p_keep"), "keep", "reason", "severity")


def _ece(p: str) -> str:
    bins = " + ".join(f"(q >= {e!r}::DOUBLE)::INT" for e in E.EDGES[1:])
    rows = f"SELECT {p} AS q, (event_type = 'error')::INT::DOUBLE AS y FROM po, fitted WHERE portion = 'test'"
    return f"(SELECT round(sum(abs(mp - my) * n) / sum(n), 6) FROM (SELECT count(*) AS n, avg(q) AS mp, avg(y) AS my FROM ({rows}) GROUP BY least(9, {bins})))"


@query(f"""WITH {_PORTIONS}, c AS (SELECT 1 AS one, ln({_P2} / (1 - {_P2})) AS z, (event_type = 'error')::INT::DOUBLE AS y FROM po WHERE portion = 'calibration'), {_newton('c', 'one')}
SELECT 'answer_wrong' AS signal, round(t, 5) AS temperature, NOT (t > 0.06 AND t < 19.9) AS at_bound, {_ece(_P2)} AS ece_before, {_ece(f'1 / (1 + exp(-ln({_P2} / (1 - {_P2})) / t))')} AS ece_after FROM fitted""")
def finetune_calibration(spark, sf):
    """The temperature of the deciding signal and what it does to the calibration of the test portion."""
    found = _run(spark, sf, "calibration")["calibration"]["temperatures"].where("signal = 'answer_wrong'")
    return found.select("signal", F.round("temperature", 5).alias("temperature"), "at_bound", r6("ece_before").alias("ece_before"), r6("ece_after").alias("ece_after"))

