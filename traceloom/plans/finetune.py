"""Labelled traces to an evaluated, calibrated model and its decisions, in stages that a later run can go on from.

data: traces by portion, with a report and remarks. released: the test portion as the released model scores it. trained:
the calibration and test portions as the trained one does. calibration: a temperature for each signal, with the error of
calibration before and after. results: recall at a budget of both models and of the rules that need none, on the same
rebalanced sets, and where the trained model does no better. decisions: the test portion as the policy decides it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import calibrate, uniform
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import policy as P
from ..operators.scoring import KEEP, WRONG
from .tables import Stages

PORTIONS = ("train", "calibration", "test")
SIGNALS = (WRONG, KEEP)
#: From traces to traces with a column for each signal (null: not scored) and latency_ms.
Scorer = Callable[[DataFrame], DataFrame]
#: From the training portion to a scorer.
Trainer = Callable[[DataFrame], Scorer]


@dataclass(frozen=True)
class Options:
    heldout: float = 0.2
    calibration: float = 0.5
    seed: str = "7"
    base_rates: tuple[float, ...] = (0.05, 0.1, 0.2)
    sample_rates: tuple[float, ...] = (0.05, 0.1, 0.2)
    sample_rate: float = 0.1
    resamples: int = 20
    least_train: int = 200
    signal: str = WRONG
    keep_from: float = P.KEEP_FROM
    floor: float = P.RANDOM_FLOOR
    high_from: float = P.HIGH_FROM


def portioned(traces: DataFrame, options: Options, key: str = "question_key") -> tuple[DataFrame, str]:
    """traces with portion, and how they were split: by their own split field if every row has one, else by question.

    The field says train or heldout, anything else is an error; what is held out is parted into calibration and test by
    question. A question on both sides of the split is an error. Rows of null key are kept out of no portion: they train.
    """
    known = F.col("split").isin("train", "heldout")
    seen = traces.agg(F.count_if(F.col("split").isNull()).alias("without"), F.array_sort(F.collect_set(F.when(~known, F.substring("split", 1, 40)))).alias("unknown")).first()
    if seen["without"] or not traces.head(1):
        return L.split(traces, key, options.heldout, options.calibration, options.seed), "by question"
    if seen["unknown"]:
        raise ValueError(f"unknown split values {seen['unknown'][:5]}; use train or heldout")
    both = L.leaks(traces.withColumn("portion", F.col("split")), key).limit(3).collect()
    if both:
        raise ValueError(f"questions on both sides of the split, e.g. {[r[0] for r in both]}")
    calibration = L.pick_keys(traces.where("split = 'heldout'"), key, options.calibration, f"{options.seed}-calib").withColumn("_calibrates", F.lit(True))
    out = traces.join(calibration, key, "left")
    return out.withColumn("portion", F.when(F.col("split") == "train", "train").when(F.col("_calibrates"), "calibration").otherwise("test")).drop("_calibrates"), "split field"


def report(portions: DataFrame, key: str = "question_key") -> DataFrame:
    """portion, traces, questions, wrong: a row for each of the three portions, zeros where it is empty."""
    every = portions.sparkSession.createDataFrame([(x,) for x in PORTIONS], "portion string")
    return every.join(L.split_report(portions, key), "portion", "left").fillna(0)


def remarks(counts: DataFrame, options: Options, method: str = "by question", named: bool = True) -> DataFrame:
    """kind (problem or note), text: what stops a run, and what speaks against trusting it, from report().

    A portion needs both classes; the test portion must have the positives that each base rate asks for, which is looked at
    only if no portion lacks a class; few traces to train on, and questions known by their text alone, are notes.
    """
    one_class = F.when((F.col("wrong") == 0) | (F.col("wrong") == F.col("traces")), F.format_string("the %s portion needs both correct and wrong traces (%d traces, %d wrong)", "portion", "traces", "wrong"))
    few = F.when((F.col("portion") == "train") & (F.col("traces") < options.least_train), F.format_string(f"only %d training traces; expect a noisy result below {options.least_train}", "traces"))
    rare = [F.when(F.bround((F.col("traces") - F.col("wrong")) * b / (1 - b)) > F.col("wrong"), F.format_string(f"base rate {b} needs %d positives; there are %d", F.bround((F.col("traces") - F.col("wrong")) * b / (1 - b)).cast("long"), F.col("wrong"))) for b in options.base_rates]
    lack = counts.agg(F.count_if(one_class.isNotNull()).alias("lack"))
    rows = counts.crossJoin(F.broadcast(lack))  # three rows and one
    rarities = F.when((F.col("lack") == 0) & (F.col("portion") == "test"), F.array(*rare)).otherwise(F.array().cast("array<string>"))
    problems = F.transform(F.array_compact(F.concat(F.array(one_class), rarities)), lambda t: F.struct(F.lit("problem").alias("kind"), t.alias("text")))
    notes = F.transform(F.array_compact(F.array(few)), lambda t: F.struct(F.lit("note").alias("kind"), t.alias("text")))
    out = rows.select(F.explode(F.concat(problems, notes)).alias("r")).select("r.*")
    if method == "by question" and not named:
        unnamed = counts.sparkSession.createDataFrame([("note", "no qid or split field: runs of the same question are grouped by their question text")], out.schema)
        out = out.unionByName(unnamed)
    return out


def check(traces: DataFrame, options: Options | None = None, key: str = "question_key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(portions, report, remarks) of labelled traces; trains and scores nothing."""
    options = options or Options()
    portions, method = portioned(traces, options, key)
    named = "qid" in traces.columns and bool(traces.where("qid IS NOT NULL").head(1))
    counts = report(portions, key)
    return portions, counts, remarks(counts, options, method, named)


def score_portion(portion: DataFrame, scorer: Scorer, model: str) -> DataFrame:
    """model, trace_id, y, latency_ms and both signals of a portion; y: the label isn't correct."""
    return scorer(portion).select(F.lit(model).alias("model"), "trace_id", (F.col("label") != "correct").alias("y"), *(F.col(s).cast("double").alias(s) for s in SIGNALS), F.col("latency_ms").cast("double").alias("latency_ms"))


def by_signal(scores: DataFrame) -> DataFrame:
    """A row for each signal of score_portion(), those without a value left out: model, trace_id, y, signal, p."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("p")) for s in SIGNALS]))
    return scores.select("model", "trace_id", "y", each.alias("_s")).select("model", "trace_id", "y", "_s.*").where("p IS NOT NULL")


def calibration(calibrating: DataFrame, test: DataFrame) -> DataFrame:
    """signal, temperature, at_bound, ece_before, ece_after: fitted on one portion, measured on the other."""
    fitted = E.fit_temperature(by_signal(calibrating), ["signal"])
    scores = by_signal(test).join(F.broadcast(fitted.select("signal", "temperature")), "signal")  # two signals
    before, after = E.ece(scores, ["signal"]), E.ece(scores.withColumn("p", calibrate(F.col("p"), F.col("temperature"))), ["signal"])
    return fitted.join(before.withColumnRenamed("ece", "ece_before"), "signal", "left").join(after.withColumnRenamed("ece", "ece_after"), "signal", "left")


def heuristic_scores(test: DataFrame, rules: list[str]) -> DataFrame:
    """Rules of L.heuristics() as scores of a model `heuristic`, a signal each."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("signal"), F.col(r).cast("double").alias("p")) for r in rules]))
    return test.select(F.lit("heuristic").alias("model"), "trace_id", (F.col("label") != "correct").alias("y"), each.alias("_s")).select("model", "trace_id", "y", "_s.*")


def decided(test: DataFrame, temperatures: DataFrame, options: Options) -> DataFrame:
    """trace_id, p_keep_raw, p_keep, keep, reason, severity of scored traces, by the options' signal at its temperature."""
    t = temperatures.where(F.col("signal") == options.signal).select("temperature")
    rows = test.select("trace_id", F.col(options.signal).alias("p_keep_raw")).join(F.broadcast(t), F.lit(True), "left")  # one row
    rows = rows.withColumn("p_keep", calibrate(F.col("p_keep_raw"), F.coalesce("temperature", F.lit(1.0)))).withColumn("u", uniform(f"{options.seed}-floor", F.col("trace_id")))
    return P.decide(rows, keep_from=options.keep_from, floor=options.floor, high_from=options.high_from).select("trace_id", "p_keep_raw", "p_keep", "keep", "reason", "severity")


def run(spark: SparkSession, path: str, traces: DataFrame, released: Scorer, train: Trainer, rules: list[str], options: Options | None = None, until: str = "decisions", key: str = "question_key") -> dict[str, dict[str, DataFrame]]:
    """Every stage's tables, by stage; those of an earlier run in `path` with the same options are read, not made again.

    traces has trace_id, label, split, the key, qid if there is one, the rules and what the scorers read. Data that can't be
    trained on ends the run in its first stage with an error that names the problems; its report is there to be read.
    Scorers and the trainer are code: a run that changes them needs another path.
    """
    options = options or Options()
    stages, out = Stages(spark, path, asdict(options) | {"rules": rules, "key": key}), {}

    def data() -> dict[str, DataFrame]:
        portions, counts, said = check(traces, options, key)
        return {"portions": portions, "report": counts, "remarks": said}

    def portion(name: str) -> DataFrame:
        return out["data"]["portions"].where(F.col("portion") == name)

    def trained() -> dict[str, DataFrame]:
        scorer = train(portion("train"))
        return {name: score_portion(portion(name), scorer, "finetuned") for name in ("calibration", "test")}

    def results() -> dict[str, DataFrame]:
        released_, tuned = out["released"]["test"], out["trained"]["test"]
        scores = by_signal(released_).unionByName(by_signal(tuned)).unionByName(heuristic_scores(portion("test"), rules))
        table = E.evaluated(scores, ["model", "signal"], "trace_id", list(options.base_rates), sorted({*options.sample_rates, options.sample_rate}), options.resamples)
        headline = table.where((F.col("sample_rate") == options.sample_rate) & ((F.col("model") == "heuristic") | (F.col("signal") == options.signal)))
        name = F.when(F.col("model") == "heuristic", F.col("signal")).otherwise(F.col("model"))
        best = headline.where("model = 'heuristic'").groupBy("signal").agg(F.avg("norm_recall_mean").alias("m")).orderBy(F.desc_nulls_last("m"), "signal").limit(1)
        kept = headline.where("model <> 'heuristic'").unionByName(headline.join(F.broadcast(best.select("signal")), "signal", "left_semi").where("model = 'heuristic'"))
        behind = E.not_better(kept.withColumn("model", name), "finetuned", ["zero_shot", *rules])
        latency = E.latency(released_.unionByName(tuned), ["model"])
        return {"results": table, "not_better": behind, "latency": latency}

    steps: list[tuple[str, Callable[[], dict[str, DataFrame]]]] = [
        ("data", data),
        ("released", lambda: {"test": score_portion(portion("test"), released, "zero_shot")}),
        ("trained", trained),
        ("calibration", lambda: {"temperatures": calibration(out["trained"]["calibration"], out["trained"]["test"])}),
        ("results", results),
        ("decisions", lambda: {"decisions": decided(out["trained"]["test"], out["calibration"]["temperatures"], options)}),
    ]
    for name, make in steps:
        out[name] = stages.stage(name, make)
        if name == "data":
            problems = [r["text"] for r in out["data"]["remarks"].where("kind = 'problem'").limit(20).collect()]
            if problems:
                raise ValueError("the data cannot be trained on:\n  " + "\n  ".join(problems))
        if name == until:
            break
    return out
