"""Annotations, labelled traces, splits by question, reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .select import lowest_hashes


def latest_verdicts(annotations: DataFrame, name: str, spans: DataFrame | None = None) -> DataFrame:
    """trace_id, verdict of the latest readable annotation of that name, by (updated_at or created_at or ''), then seq.

    annotations: name, trace_id, span_id, label, score, created_at, updated_at, seq. Spans tell a span's trace.
    """
    found = annotations.where(F.col("name") == name)
    if spans is not None:
        where = spans.groupBy("span_id").agg(F.min("trace_id").alias("_of"))  # of a repeated span id the least trace
        found = found.join(where, "span_id", "left").withColumn("trace_id", F.coalesce("trace_id", "_of")).drop("_of")
    verdict = F.coalesce(S.normalize_label(F.col("label")), S.label_of_score(F.col("score")))
    at = F.coalesce(F.nullif("updated_at", F.lit("")), F.nullif("created_at", F.lit("")), F.lit(""))
    found = found.withColumns({"verdict": verdict, "at": at}).where("verdict IS NOT NULL AND trace_id IS NOT NULL")
    return found.groupBy("trace_id").agg(F.max_by("verdict", F.struct("at", "seq")).alias("verdict"))


def all_annotations(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """Annotations of spans, then those of traces, as one table; seq becomes (0 or 1, seq), so that order stands in ties."""
    ranked = lambda df, k: df.withColumn("seq", F.struct(F.lit(k).alias("rank"), F.col("seq").cast("long").alias("seq")))
    return ranked(spans, 0).unionByName(ranked(traces, 1), allowMissingColumns=True)


def unknown_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """column, n: values outside the allowed ones, null among them."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed)).groupBy(column).agg(F.count("*").alias("n"))


def against_manifest(report: DataFrame, expected: dict[str, int]) -> DataFrame:
    """portion, traces, expected of portions whose count differs from what the manifest says; 0 where one side lacks it."""
    wanted = report.sparkSession.createDataFrame(list(expected.items()), "portion string, expected long")
    both = report.select("portion", "traces").join(wanted, "portion", "full").fillna(0, ["traces", "expected"])
    return both.where("traces <> expected")


def labelled(traces: DataFrame, verdicts: DataFrame) -> DataFrame:
    return traces.join(verdicts.withColumnRenamed("verdict", "label"), "trace_id")


def join_counts(traces: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: traces, labelled, unlabelled, unscorable (reason set)."""
    bad = F.col("reason").isNotNull()
    return traces.join(verdicts, "trace_id", "left").agg(
        F.count("*").alias("traces"), F.count_if(~bad & F.col("verdict").isNotNull()).alias("labelled"),
        F.count_if(~bad & F.col("verdict").isNull()).alias("unlabelled"), F.count_if(bad).alias("unscorable"),
    )


def pick_keys(keys: DataFrame, key: str, fraction: float, seed: str, floor: bool = False) -> DataFrame:
    """round-half-even(n * fraction) (or its floor) of the distinct keys, in the order of a seeded hash.

    Keys are counted by the first four digits of their hashes, 65,536 rows at most. All keys below the prefix in which the
    last one falls are taken as they are; only that prefix's are ordered.
    """
    order = S.hash_order(seed, F.col(key))
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_h", order).withColumn("_p", F.substring("_h", 1, 4))
    counts = sorted(map(tuple, distinct.groupBy("_p").count().collect()))
    n = sum(c for _, c in counts) * fraction
    left = int(n) if floor else round(n)
    edge = ""
    for prefix, count in counts:
        edge = prefix
        if count >= left:
            break
        left -= count
    else:
        return distinct.select(key)
    last = distinct.where(F.col("_p") == edge).orderBy("_h", key).limit(left)
    return distinct.where(F.col("_p") < edge).unionByName(last).select(key)


def split(traces: DataFrame, key: str, heldout: float = 0.2, calibration: float = 0.5, seed: str = "7") -> DataFrame:
    """Adds portion: train, calibration or test, all traces of a question in one."""
    held = pick_keys(traces, key, heldout, f"{seed}-held")
    calib = pick_keys(held, key, calibration, f"{seed}-calib").withColumn("_portion", F.lit("calibration"))
    test = held.join(calib, key, "left_anti").withColumn("_portion", F.lit("test"))
    return traces.join(calib.unionByName(test), key, "left").withColumn("portion", F.coalesce("_portion", F.lit("train"))).drop("_portion")


def leaks(portions: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one portion."""
    return portions.groupBy(key).agg(F.count_distinct("portion").alias("portions")).where("portions > 1")


def split_report(portions: DataFrame, key: str) -> DataFrame:
    return portions.groupBy("portion").agg(F.count("*").alias("traces"), F.count_distinct(key).alias("questions"), F.count_if(F.col("label") != "correct").alias("wrong"))


def check_problems(report: DataFrame, least_train: int = 200) -> DataFrame:
    """portion, problem: a portion without both classes, or too little to train on."""
    both = F.when((F.col("wrong") == 0) | (F.col("wrong") == F.col("traces")), F.concat(F.col("portion"), F.lit(" has one class only")))
    few = F.when((F.col("portion") == "train") & (F.col("traces") < least_train), F.concat(F.lit("few traces to train on: "), F.col("traces").cast("string")))
    return report.select("portion", F.explode(F.array_compact(F.array(both, few))).alias("problem"))


def stratified_pick(df: DataFrame, by: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows spread evenly over the values of `by`, null the last of them; what doesn't divide goes to the first values in order.

    A value's rows are taken in the order of a seeded hash, see lowest_hashes.
    """
    values = [r[0] for r in df.select(by).distinct().orderBy(F.col(by).asc_nulls_last()).collect()]  # a label's domain
    share, more = divmod(n, max(1, len(values)))
    quota = F.coalesce(*[F.when(F.col(by).eqNullSafe(F.lit(v)), share + (i < more)) for i, v in enumerate(values)], F.lit(0))
    rows = df.withColumns({"_h": S.hash_order(seed, F.col(key)), "_quota": quota})
    return lowest_hashes(rows, [by], "_h", "_quota", key).select(*df.columns)


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, share: of each row's count, half-even to two decimals. One aggregate, then totals of it."""
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return counts.select(row, column, F.bround(F.col("n") / F.sum("n").over(Window.partitionBy(row)), 2).alias("share"))


def heuristics(df: DataFrame) -> DataFrame:
    """Adds the six rules that need no model, from final_answer, evidence, tool_calls, used_search, stop_reason."""
    answer = S.words(F.col("final_answer"))
    found = S.words(F.array_join(F.coalesce("evidence", F.array().cast("array<string>")), " "))
    calls = F.coalesce("tool_calls", F.array().cast("array<struct<name:string,args_json:string,status_json:string>>"))
    search = F.coalesce("used_search", F.exists(calls, lambda c: c["name"] == "search"))
    status = lambda c: F.coalesce(F.regexp_replace(c["status_json"], '^"|"$', ""), F.lit("ok"))
    overlap = F.size(F.filter(answer, lambda w: F.array_contains(found, w))) / F.size(answer)
    return df.withColumns({
        "short_answer": -F.size(answer), "few_evidence": -F.size(F.coalesce("evidence", F.array().cast("array<string>"))),
        "no_search": (~search).cast("double"), "tool_error": F.exists(calls, lambda c: status(c) != "ok").cast("double"),
        "bad_stop": (F.coalesce("stop_reason", F.lit("answered")) != "answered").cast("double"),
        "low_overlap": F.when(F.size(answer) > 0, 1.0 - overlap).otherwise(1.0),
    })


def logistic(train: DataFrame, test: DataFrame, rules: list[str], label: str) -> DataFrame:
    """test with p: a logistic regression over the standardised rules, penalised as sum loss + |w|^2 / 2."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stats = train.agg(F.count("*").alias("n"), *[f(F.col(r)).alias(f"{r}_{k}") for r in rules for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scale = lambda df: df.withColumns({f"_{r}": (F.col(r) - stats[f"{r}_m"]) / (stats[f"{r}_s"] or 1.0) for r in rules})
    into = VectorAssembler(inputCols=[f"_{r}" for r in rules], outputCol="_x")
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=1 / max(1, stats["n"]), standardization=False, probabilityCol="_p", predictionCol="_hat", rawPredictionCol="_raw")
    model = fit.fit(into.transform(scale(train)).withColumn("_y", F.col(label).cast("double")))
    return model.transform(into.transform(scale(test))).withColumn("p", vector_to_array("_p")[1]).drop("_x", "_p", "_hat", "_raw", *[f"_{r}" for r in rules])


def label_column(row_label: Column, answer: Column, reference: Column) -> Column:
    return F.coalesce(S.normalize_label(row_label), F.when(reference.isNotNull(), S.label_from_reference(answer, reference)))
