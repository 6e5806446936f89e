"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations.

Each source's documents are shuffled by a hash. A copy's virtual finish time is the source's words up to and including
it, over the source's target. All copies are sorted by that time and taken until the budget is full. Both running sums
are taken in two steps, totals of buckets first, so no source and no table has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hashes, written

#: Fixed values of the contract: weights of the sources in order, share of all words, most copies of a document.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
#: Rows that a bucket of a running sum has at about; buckets grow in number with the table.
BUCKET_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of other than space and \\t\\n\\v\\f\\r; null: 0."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of each source of (source, size), by water-filling: weight shares, none above epochs times its size.

    With the sources in order of size over weight, all before some place reach their limit, and the rest share what is
    left; that place is the first where the rest's level is within its own limit. Sources come by code point, null last.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    choices = F.array(*map(F.lit, weights))
    totals = totals.withColumn("weight", F.element_at(choices, ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    totals = totals.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    totals = totals.withColumn("level", level)
    reached = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything)
    return totals.select("source", "source_size", F.least("cap", F.coalesce(reached * F.col("weight"), "cap")).alias("target"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (taken), taken (words) of each row of docs.

    Null texts and texts without words have size 0 and are taken 0 times. A null source is a source of its own. Rows of
    equal doc_id stay apart and follow each other by source and size. The same table gives the same mix. An empty table
    gives no rows. Other columns are ignored, but for `carried` ones, which are returned too and decide ties.
    """
    light = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carried)
    light = written(light, "mix-sizes")  # the texts are read once
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")), 256)
    n = light.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    buckets = max(1, -(-n["rows"] // BUCKET_ROWS))
    budget = n["words"] * share
    targets = source_targets(light, weights, share, epochs)
    rows = light.withColumn("key", key).withColumn("part", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("int"))
    rows = rows.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    # the source's running sum of sizes in shuffled order: by leading digits of the key, then inside
    parts = rows.groupBy("src", "part").agg(F.sum("size").alias("part_size"))
    running = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("src", "part", F.coalesce(F.sum("part_size").over(running), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "part").orderBy("key", "doc_id", "size", *carried)
    rows = rows.withColumn("place", F.row_number().over(inside)).withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(parts, ["src", "part"])
    rows = rows.join(targets.withColumn("src", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source"), "src")
    # one line of all copies by virtual finish time: ranges of it first, then inside; rows without words stand aside
    copies = rows.withColumn("epoch", F.explode(F.when(F.col("size") > 0, F.sequence(F.lit(0), F.lit(epochs - 1))).otherwise(F.array(F.lit(0)))))
    until = F.col("before") + F.col("inside") + F.col("epoch") * F.col("source_size")
    copies = copies.withColumn("finish", F.when(F.col("size") > 0, until / F.col("target")))
    fine = max(64, 8 * buckets)
    copies = copies.withColumn("range", F.when(F.col("size") > 0, F.floor(F.col("finish") * fine)).otherwise(-1 - F.col("part")))
    ranges = copies.groupBy("range").agg(F.sum("size").alias("range_size"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_before"))
    line = Window.partitionBy("range").orderBy("finish", "key", "epoch", "src", "place").rowsBetween(Window.unboundedPreceding, 0)
    copies = copies.join(ranges, "range").withColumn("total", F.col("range_before") + F.sum("size").over(line))
    took = F.count_if((F.col("total") <= budget) & (F.col("size") > 0))
    out = copies.groupBy("src", "part", "place", "doc_id", "source", "size", "source_size", "target", *carried).agg(took.alias("copies"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *carried)


def mixed(docs: DataFrame, **fixed) -> DataFrame:
    """The rows of docs, all columns, each as often as mixture() takes that row; rows of null or shared doc_id too.

    A row is known by a hash of all its columns; rows equal in all of them stand for one another.
    """
    marked = docs.withColumns(dict(zip(("_row1", "_row2"), row_hashes(docs.columns), strict=True)))
    rows = mixture(marked, carried=("_row1", "_row2"), **fixed).groupBy("_row1", "_row2")
    taken = written(rows.agg(F.sum("copies").alias("_copies"), F.count("*").alias("_times")).where("_copies > 0"), "mix-rows")
    once = marked.join(taken.where("_times = 1"), ["_row1", "_row2"]).select(*docs.columns, "_copies")
    often = marked.join(taken.where("_times > 1"), ["_row1", "_row2"])
    often = often.groupBy("_row1", "_row2").agg(*(F.first(c).alias(c) for c in docs.columns), F.first("_copies").alias("_copies"))
    out = once.unionByName(often.select(*docs.columns, "_copies"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*docs.columns)
