"""Rows and choices of a comparison of models: scores by portion, the headline rate, margins over the best rule, training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import auroc

MARGIN = 0.10
#: Fixed value: the line by which a trainer says how many records it left out.
DROPPED = r"dropped (\d+) of (\d+) records"


def of_portion(scores: DataFrame, model: str, portion: str, signal: str) -> DataFrame:
    """trace_id, y, p of a model's scores (model, portion, trace_id, y, signal columns) on a portion, by one signal."""
    rows = scores.where((F.col("model") == model) & (F.col("portion") == portion))
    return rows.select("trace_id", "y", F.col(signal).alias("p"))


def at_rate(results: DataFrame, sample_rate: float) -> DataFrame:
    """Result rows of one sample rate."""
    return results.where(F.abs(F.col("sample_rate") - sample_rate) < 1e-9)


def margins(results: DataFrame, model: str, signal: str, references: list[str], sample_rate: float, margin: float = MARGIN) -> DataFrame:
    """base_rate, value, best_rule, best_rule_value, best, best_value, margin, passed of a model against heuristics.

    results has model, signal, base_rate, sample_rate, norm_recall_mean; heuristics are rows of model `heuristic`, a signal
    each. The best single rule is the greatest of those that aren't references (a fitted combination of rules, say), of
    equals the first by name; the best is that or a reference, of equals a reference. A missing value passes nothing.
    """
    rows = at_rate(results, sample_rate).select("model", "signal", "base_rate", F.col("norm_recall_mean").alias("v"))
    rules, reference = rows.where("model = 'heuristic'"), F.col("signal").isin(references)
    first = lambda df, name: df.where("v IS NOT NULL").groupBy("base_rate").agg(F.min_by(F.struct("signal", "v"), F.struct(-F.col("v"), "signal")).alias(name))
    single, combined = first(rules.where(~reference), "s"), first(rules.where(reference), "c")
    own = rows.where((F.col("model") == model) & (F.col("signal") == signal)).select("base_rate", F.col("v").alias("value"))
    out = own.join(single, "base_rate", "left").join(combined, "base_rate", "left")
    best = F.when(F.col("c").isNotNull() & (F.col("s").isNull() | (F.col("c.v") >= F.col("s.v"))), F.col("c")).otherwise(F.col("s"))
    out = out.withColumn("b", best)
    gap = F.col("value") - F.col("b.v")
    return out.select("base_rate", "value", F.col("s.signal").alias("best_rule"), F.col("s.v").alias("best_rule_value"), F.col("b.signal").alias("best"), F.col("b.v").alias("best_value"), gap.alias("margin"), F.coalesce(gap >= margin, F.lit(False)).alias("passed"))


def training_figures(logs: DataFrame, records: Column, log: str = "log") -> DataFrame:
    """logs with records, dropped and dropped_frac, as the trainer's log says; a log that says nothing dropped none of `records`."""
    number = lambda k: F.nullif(F.regexp_extract(F.coalesce(F.col(log), F.lit("")), DROPPED, k), F.lit("")).cast("long")
    found = logs.withColumns({"records": F.coalesce(number(2), records.cast("long")), "dropped": F.coalesce(number(1), F.lit(0).cast("long"))})
    return found.withColumn("dropped_frac", F.try_divide("dropped", "records"))


def exact_resamples(keys: DataFrame, key: str, resamples: int, seed: str = "b") -> DataFrame:
    """(resample, key, w): in each resample exactly as many draws with replacement as there are keys; w, how often one was drawn.

    Keys are numbered in the order of a seeded hash, within the first four digits of it and those by counts, so no key is
    ordered among all. A draw is a number below their count, by a hash of the resample and the draw, and finds its key by
    an equi-join; rows are resamples x keys, as they must be.
    """
    from ..functions.scalars import hash_order, uniform

    rows = keys.select(key).distinct().withColumn("_h", hash_order(seed, F.col(key))).withColumn("_q", F.substring("_h", 1, 4))
    counts = rows.groupBy("_q").agg(F.count("*").alias("_n"))
    shard = F.substring("_q", 1, 2)
    heads = counts.groupBy(shard.alias("_s")).agg(F.sum("_n").alias("_m"))
    heads = heads.withColumn("_first", F.coalesce(F.sum("_m").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 256 rows
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(shard).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("_below", below).join(F.broadcast(heads), shard == F.col("_s")).select("_q", (F.col("_first") + F.col("_below")).alias("_from"))  # 65,536 rows at most
    place = F.col("_from") + F.row_number().over(Window.partitionBy("_q").orderBy("_h", key)) - 1
    numbered = rows.join(F.broadcast(offsets), "_q").select(key, place.alias("_i"))
    n = counts.agg(F.sum("_n").alias("_all"))
    draws = numbered.crossJoin(F.broadcast(n)).withColumn("resample", F.explode(F.sequence(F.lit(1), F.lit(resamples))))  # n is one row
    u = uniform(seed, F.concat_ws("|", F.col("resample").cast("string"), F.col("_i").cast("string")))
    drawn = draws.select("resample", F.floor(u * F.col("_all")).alias("_i")).groupBy("resample", "_i").agg(F.count("*").alias("w"))
    return drawn.join(numbered, "_i").select("resample", key, "w")


def exact_bootstrap_auroc(scores: DataFrame, by: list[str], key: str, resamples: int = 200, seed: str = "b") -> DataFrame:
    """by, auroc, low, high: a 95 % interval over resamples that draw exactly n keys with replacement, shared by all groups.

    A resample of one class has no AUROC and isn't among those of the interval.
    """
    drawn = scores.join(exact_resamples(scores.select(key), key, resamples, seed), key)
    values = auroc(drawn, [*by, "resample"], weight="w")
    spread = values.groupBy(*by).agg(F.percentile("auroc", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    spread = spread.select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    whole = auroc(scores, by)
    return whole.join(spread, by) if by else whole.crossJoin(F.broadcast(spread))
