"""How five text filters interact: what each removes, alone, in each of their 120 orders, and on average over the orders.

A document's failures are five bits. Bits A to D come from its own text by native expressions; E, a copy of an earlier
document, from the least doc_id of each distinct text. All that is asked follows from how many documents of a part have
each of the 32 combinations, so orders are enumerated over cells, never over documents.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
#: What parts words, and the marks that filter D looks for.
BLANKS = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for filters A to D; a null text counts as empty, which fails A alone."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    failed = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
        text.rlike(MARKS),
    )
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)), F.lit(0)).cast("int")


def failure_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): rows of docs with this doc_id and part, equal text, and these failures; n counts them.

    Texts are equal if their SHA-256 is. E (16) fails where a smaller doc_id has the same text anywhere in docs, whatever
    filters it fails itself; rows of the least doc_id pass, all of them if they are repeated. A null doc_id is neither
    smaller nor larger than another, so it passes E and fails nobody. A null part is the empty string. Copies of a text
    are never gathered: the least doc_id is a partial aggregate, and rows meet it by text and doc_id together.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_failures(F.col("text")).alias("own"))
    rows = written(rows.groupBy("doc_id", "part", "same", "own").agg(F.count("*").alias("n")), "filter-audit-rows")
    first = rows.where("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["same", "doc_id"], "left").select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask"), "n")


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): counts of documents, 32 rows a part at most; good and toxic by labels(doc_id, quality, toxic).

    A doc_id that labels names several times is good, or toxic, if one of its rows says so; a null doc_id has no label.
    """
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows of null doc_id, which find nothing, are spread by their part and mask instead of meeting in one place
    keyed = masks.withColumns({"known": F.col("doc_id").isNotNull(), "key": F.coalesce("doc_id", F.xxhash64("part", "mask"))})
    rows = keyed.join(said.withColumn("known", F.lit(True)), ["key", "known"], "left")
    counts = [F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(x, F.lit(0))).alias(x) for x in ("good", "toxic"))]
    return rows.groupBy("part", "mask").agg(*counts)


def audited(cells: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, from mask_cells(): what the step's filter does after those before it.

    kept, removed: documents left and removed by this step; redundant: those that fail its filter but were removed before;
    unique_fails: those that fail its filter alone; good_lost, toxic_lost: of the removed; shapley: the filter's removed,
    summed over all orders. No cells give no rows.
    """
    subsets = [(bit, prior) for bit in range(5) for prior in range(32) if not prior >> bit & 1]
    every = F.array(*(F.struct(F.lit(1 << bit).alias("bit"), F.lit(prior).alias("prior")) for bit, prior in subsets))
    mask, bit, prior = F.col("mask"), F.col("bit"), F.col("prior")
    fails, before = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(prior) != 0
    total = lambda which, of: F.sum(F.when(which, F.col(of)).otherwise(0)).cast("long")
    values = (total(~fails & ~before, "n"), total(fails & ~before, "n"), total(fails & before, "n"), total(mask == bit, "n"), total(fails & ~before, "good"), total(fails & ~before, "toxic"))
    steps = cells.select("*", F.explode(every).alias("_s")).select("part", "mask", "n", "good", "toxic", "_s.bit", "_s.prior").groupBy("part", "bit", "prior").agg(*(v.alias(name) for v, name in zip(values, _COUNTS, strict=True)))
    size = F.bit_count("prior")
    orders_with = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(4 - k)) for k in range(5))), size + 1)
    steps = steps.withColumn("shapley", F.sum(F.col("removed") * orders_with).over(Window.partitionBy("part", "bit")).cast("long"))
    plan = [("".join(FILTERS[k] for k in order), s + 1, 1 << order[s], sum(1 << k for k in order[:s])) for order in permutations(range(5)) for s in range(5)]
    orders = cells.sparkSession.createDataFrame(plan, "filter_order string, step int, bit int, prior int")  # 600 rows, always
    return steps.join(F.broadcast(orders), ["bit", "prior"]).select("part", "filter_order", "step", *_COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """audited() of docs(doc_id, text, part, ...); other columns are ignored. See failure_masks for nulls, ties and repeated rows."""
    return audited(mask_cells(failure_masks(docs, part), labels))
