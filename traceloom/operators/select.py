"""Rows at one end of an order within groups, without ordering whole groups: counts narrow to where the last row lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a group's scores, between its least and its greatest.
BINS = 4096


def _same(by: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in by:
        out &= F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def _named(by: list[str], prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in by]


def lowest_hashes(df: DataFrame, by: list[str], h: str, quota: str, tie: str) -> DataFrame:
    """Of each group of `by` the rows with the least `h`, a column of hex digits, as many as its column `quota` says; ties by `tie`.

    Rows are counted by the first four digits. What lies below the prefix in which a group's last row falls is taken as it
    is; only that prefix's rows, one in 65,536, are ordered.
    """
    rows = df.withColumn("_p", F.substring(h, 1, 4))
    counts = rows.groupBy(*_named(by, "_g_"), F.col("_p").alias("_q")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*[f"_g_{c}" for c in by]).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    rows = rows.join(counts, _same(by, "_g_") & F.col("_p").eqNullSafe(F.col("_q"))).where(F.col("_below") < F.col(quota))
    whole = rows.where(F.col("_below") + F.col("_n") <= F.col(quota))
    within = Window.partitionBy(*by, "_p").orderBy(h, tie)
    edge = rows.where(F.col("_below") + F.col("_n") > F.col(quota)).withColumn("_r", F.row_number().over(within)).where(F.col("_below") + F.col("_r") <= F.col(quota))
    return whole.unionByName(edge.drop("_r")).select(*df.columns)


def last_hashes(df: DataFrame, by: list[str], h: str, quota: str, tie: str) -> DataFrame:
    """by, h, tie of the last row that lowest_hashes takes of each group of `by`; no row where the quota is 0 or over the group's size.

    Nothing but counts by prefix and the rows of the last prefix are shuffled. Groups are few.
    """
    rows = df.withColumn("_p", F.substring(h, 1, 4))
    counts = rows.groupBy(*by, "_p").agg(F.count("*").alias("_n"), F.first(quota).alias("_quota"))
    order = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_n").over(order), F.lit(0))).where((F.col("_below") < F.col("_quota")) & (F.col("_quota") <= F.col("_below") + F.col("_n")))
    last = counts.select(*_named(by, "_g_"), F.col("_p").alias("_q"), "_below", "_quota")
    within = Window.partitionBy(*by).orderBy(h, tie)
    edge = rows.join(F.broadcast(last), _same(by, "_g_") & (F.col("_p") == F.col("_q"))).withColumn("_r", F.row_number().over(within))
    return edge.where(F.col("_below") + F.col("_r") == F.col("_quota")).select(*by, h, tie)


def top_positives(scores: DataFrame, by: list[str], rates: list[float], p: str, y: str, pos: str | Column, of: tuple[str, ...] = ()) -> DataFrame:
    """by, rate, n, k, positives, hits: of each group and rate how many rows it has, how many of them are the top
    k = max(1, ceil(rate * n)) by p, ties by pos, how many are positive, and how many of those are in the top.

    A group's scores are counted in BINS bins. The bin that holds the k-th row is counted by score, and of the rows with
    that very score alone the first by pos are looked for; pos may be an expression over `by` and the columns `of`, as fields
    of _of, made for these alone. Null scores come last, NaN first. scores are read three times, and not shuffled; groups are few.
    """
    finite = F.when(F.col(p).isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")), F.col(p))
    rows = scores.select(*by, F.coalesce(F.col(p).cast("double"), F.lit(float("-inf"))).alias("_s"), finite.cast("double").alias("_f"), F.coalesce(F.col(y), F.lit(False)).alias("_y"), F.col(pos).alias("_pos") if isinstance(pos, str) else F.struct(*of).alias("_of"))
    groups = rows.groupBy(*_named(by, "_g_")).agg(F.count("*").alias("n"), F.count_if("_y").alias("positives"), F.min("_f").alias("_low"), F.max("_f").alias("_high"))
    place = F.floor((F.col("_f") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BINS).cast("int")
    bin_ = F.when(F.isnan("_s") | (F.col("_s") == float("inf")), BINS).when(F.col("_f").isNull(), -1).when(F.col("_high") <= F.col("_low"), 0).otherwise(F.least(place, F.lit(BINS - 1)))
    rows = rows.join(F.broadcast(groups), _same(by, "_g_")).withColumn("_bin", bin_).drop(*[f"_g_{c}" for c in by])
    bins = rows.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.count_if("_y").alias("_m"), F.first("n").alias("n"), F.first("positives").alias("positives"))

    def edge(counts: DataFrame, at: str, groups_: list[str], before: tuple[str, str]) -> DataFrame:
        """The place that holds the k-th row of each group, and rows and positives above it (on top of those in `before`)."""
        above = Window.partitionBy(*groups_).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
        found = counts.withColumns({"_a": F.coalesce(F.sum("_n").over(above), F.lit(0)) + F.col(before[0]), "_b": F.coalesce(F.sum("_m").over(above), F.lit(0)) + F.col(before[1])})
        return found.where((F.col("_a") < F.col("k")) & (F.col("k") <= F.col("_a") + F.col("_n"))).drop(*before)

    k = F.greatest(F.lit(1), F.ceil(F.col("rate") * F.col("n")))
    bins = bins.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates]))).withColumns({"k": k, "_z": F.lit(0), "_w": F.lit(0)})
    in_bin = edge(bins, "_bin", [*by, "rate"], ("_z", "_w")).select(*_named(by, "_e_"), "rate", "k", "n", "positives", F.col("_bin").alias("_at"), "_a", "_b")
    inside = rows.drop("n", "positives", "_low", "_high").join(F.broadcast(in_bin), _same(by, "_e_") & (F.col("_bin") == F.col("_at"))).drop(*[f"_e_{c}" for c in by])
    kept = [*by, "rate", "k", "n", "positives"]
    values = inside.groupBy(*kept, "_a", "_b", "_s").agg(F.count("*").alias("_n"), F.count_if("_y").alias("_m")).withColumnsRenamed({"_a": "_a0", "_b": "_b0"})
    in_value = edge(values, "_s", [*by, "rate"], ("_a0", "_b0")).select(*_named(by, "_e_"), F.col("rate").alias("_rate"), F.col("_s").alias("_v"), F.col("_a").alias("_above"), F.col("_b").alias("_hits"))
    tied = inside.join(F.broadcast(in_value), _same(by, "_e_") & (F.col("rate") == F.col("_rate")) & F.col("_s").eqNullSafe(F.col("_v")))
    tied = tied.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "rate").orderBy("_pos" if isinstance(pos, str) else pos)))
    return tied.groupBy(*kept, "_hits").agg(F.count_if(F.col("_y") & (F.col("_above") + F.col("_r") <= F.col("k"))).alias("_more")).select(*kept, (F.col("_hits") + F.col("_more")).alias("hits"))
