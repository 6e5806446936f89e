"""Line dedup over overlapping windows of three consecutive lines.

Each window is named by 128 bits of hash. One aggregation with map-side combining finds the windows that occur more than
once and where each occurs first (least doc_id, then least hash of the text, then least place); later occurrences come
from a join with those windows alone. A window of very many occurrences is cut into pieces: few can be so frequent, so
their list has a size bound and is broadcast. Covered places are merged per document; only a document's own are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LINES = 3
#: A window with more than the greater of LEAST and 1/PIECES of all repeated occurrences is cut: at most PIECES windows.
LEAST, PIECES = 20_000, 65_536
#: A window without such a character in any line is not looked at.
SEEN = r"[^\x20\x09-\x0D]"


def _window_rows(docs: DataFrame, lines: int) -> DataFrame:
    """doc_id, t (hash of the text), at (place, from 0), a and b (hash) of each window with something to see in it."""
    split = docs.select("doc_id", "t", F.split("text", "\n", -1).alias("lines")).where(F.size("lines") >= lines)
    named = split.select(
        "doc_id",
        "t",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("lines", lambda x: F.xxhash64(F.lit(1), x)).alias("b"),
        F.transform("lines", lambda x: x.rlike(SEEN)).alias("seen"),
    )
    # consecutive elements side by side: each row of the explode holds one window
    shifted = [F.slice(c, k + 1, F.size(c)).alias(f"{c}{k}") for k in range(lines) for c in ("a", "b", "seen")]
    rows = named.select("doc_id", "t", F.posexplode(F.slice(F.arrays_zip(*shifted), F.lit(1), F.size("a") - (lines - 1))).alias("at", "w"))
    some = rows.where(_any([F.col(f"w.seen{k}") for k in range(lines)]))
    return some.select("doc_id", "t", "at", *(F.xxhash64(*[F.col(f"w.{c}{k}") for k in range(lines)]).alias(c) for c in ("a", "b")))


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for flag in flags[1:]:
        out = out | flag
    return out


def line_deduplicated(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans (maximal runs of removed lines), kept_text of each row of docs.

    A line goes if a window of `lines` consecutive lines that covers it occurred earlier: in a document of smaller doc_id,
    or further up in the same one. Lines end at "\\n" and are compared whole. A null text has no lines and a null
    kept_text; an empty one has one empty line; fewer lines than a window are kept. A null doc_id precedes all others.
    Rows that share a doc_id are ordered by a hash of their text; wholly equal ones are treated alike, as one occurrence.
    Windows of blank lines alone are not looked at. An empty table gives no rows; other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))
    windows = _window_rows(keyed, lines)
    place = F.struct("doc_id", "t", "at")
    counted = windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("times"))
    repeated = written(counted.where("times > 1"), "line-windows")
    piece = max(LEAST, (repeated.agg(F.sum("times")).first()[0] or 0) // PIECES)
    pieces = F.ceil(F.col("times") / piece)
    frequent = F.broadcast(repeated.where(pieces > 1).select("a", "b", pieces.alias("pieces")))
    cut = windows.join(frequent, ["a", "b"], "left").withColumn("piece", F.coalesce(F.pmod(F.col("t"), "pieces"), F.lit(0)))
    known = repeated.select("a", "b", "first", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    later = cut.join(known, ["a", "b", "piece"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("doc_id", "t").agg(F.collect_set("at").alias("starts")).withColumnsRenamed({"doc_id": "of", "t": "u"})
    joined = keyed.join(covered, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("t") == F.col("u")), "left")
    split = joined.select("doc_id", F.split("text", "\n", -1).alias("lines"), F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + lines - 1))))
    merged = split.select("doc_id", "lines", F.coalesce(F.size("lines"), F.lit(0)).alias("n"), gone.alias("gone"))
    left = F.when(F.col("n") > 0, F.array_except(F.sequence(F.lit(0), F.col("n") - 1), "gone"))
    kept = merged.select("doc_id", "lines", F.greatest("n", F.lit(0)).alias("n"), "gone", left.alias("left"))
    return kept.select(
        "doc_id",
        F.col("n").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.size(F.array_except("gone", F.transform("gone", lambda p: p + 1))).cast("long").alias("n_spans"),
        F.when(F.size("gone") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform("left", lambda p: F.col("lines")[p]), "\n")).alias("kept_text"),
    )
