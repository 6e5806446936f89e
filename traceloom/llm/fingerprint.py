"""Document fingerprints: one-permutation MinHash in built-in functions alone.

A text's shingles (five words) are hashed once each; the top bits of a hash choose one of BINS bins, and a bin keeps its
least hash. Empty bins are filled by optimal densification: each goes through the bins in an order of its own, the same
for all texts, and takes the value of the first that isn't empty. Of each bin the low 8 bits are stored, and likeness is
corrected for the chance of their being equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
#: Bits of a bin that are stored: two hex digits.
KEPT_BITS = 8
#: Bins that an empty one tries by hash before all that are left are ranked.
PROBES = 16
#: Cells of doc_id that rows are counted by before they are dealt into buckets, and a bucket's characters.
CELLS = 1 << 14
BUCKET_CHARS = 4 << 20


def words(text: Column) -> Column:
    """Lower-case runs of other than space and \\t\\n\\v\\f\\r; null: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bin(h: Column) -> Column:
    """Hashes are signed and sorted as such, so bins are their top bits with the sign flipped: ascending too."""
    return (F.shiftright(h, 64 - BIN_BITS) + BINS // 2).cast("int")


def _bins() -> Column:
    return F.sequence(F.lit(0), F.lit(BINS - 1))


def with_bins(df: DataFrame, text: str, into: str, size: int = SHINGLE) -> DataFrame:
    """Adds `into`: for each bin its low bits (array<int>), or an empty array for a text without words.

    A text of fewer words than a shingle has them all as one. Each column below is a step of its own, so that Catalyst
    computes it once.
    """
    h, first, held, dense = (f"_{into}_{x}" for x in ("h", "first", "held", "dense"))
    df = df.withColumn(h, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    run = lambda i: F.xxhash64(*(F.get(F.col(h), i + k) for k in range(size)))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - size, F.lit(0))), run)
    df = df.withColumn(h, F.when(F.size(h) > 0, F.sort_array(runs)).otherwise(F.array().cast("array<bigint>")))
    # of sorted hashes the first of each bin is its least
    df = df.withColumn(first, F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(h), i - 1))))).drop(h)
    df = df.withColumn(held, F.transform(first, _bin))
    df = df.withColumn(dense, F.transform(_bins(), lambda i: F.get(F.col(first), (F.array_position(F.col(held), i) - 1).cast("int"))))
    # bin i's own order of the bins: PROBES of them by hashes of (i, k), then the rest by the least hash of (i, j), its place
    # in the low bits
    mask = ~(BINS - 1)
    nearest = lambda i: F.array_min(F.transform(held, lambda j, k: F.xxhash64(i, j).bitwiseAND(F.lit(mask)).bitwiseOR(k))).bitwiseAND(F.lit(BINS - 1))
    probe = lambda i, k: F.get(F.col(dense), F.xxhash64(i, F.lit(k)).bitwiseAND(F.lit(BINS - 1)).cast("int"))
    fill = lambda i: F.coalesce(F.get(F.col(dense), i), *(probe(i, k) for k in range(PROBES)), F.get(F.col(first), nearest(i).cast("int")))
    filled = F.when(F.size(first) == BINS, F.col(first)).otherwise(F.transform(_bins(), fill))
    low = F.transform(filled, lambda v: v.bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("int"))
    return df.withColumn(into, F.when(F.size(first) > 0, low).otherwise(F.array().cast("array<int>"))).drop(first, held, dense)


def packed(bins: Column) -> Column:
    """The stored form: two hex digits a bin; an empty text has the empty string."""
    return F.array_join(F.transform(bins, lambda v: F.substring(F.hex(v.bitwiseOR(F.lit(1 << KEPT_BITS))), 2, 2)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: share of equal bins, less what chance makes equal. Two empty texts: 1; one: 0."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(BINS))
    chance = 0.5**KEPT_BITS
    estimate = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (equal - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def _constants(values: list, kind: str) -> Column:
    """An array that the optimizer folds to one constant; a literal of each value would take a call each."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def in_rings(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with bucket and ghost: stretches of descending doc_id, each closed by the first row of the next.

    Buckets hold about BUCKET_CHARS characters; they are found from counts by cell of doc_id, CELLS at most, which are cut at
    approximate quantiles, so that outlying ids leave the others apart. The last bucket's ghost is the first row of all. Null doc_ids come last.
    """
    shares = _constants([k / CELLS for k in range(CELLS)], "double")
    marks = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 4 * CELLS)).first()[0] or [0]))
    parallel = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _constants(marks, "bigint")
    steps = [1 << k for k in reversed(range(len(marks).bit_length()))]
    # binary search: how many marks aren't above doc_id
    below = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    cell = F.when(F.col("doc_id").isNull(), -1).otherwise(below).cast("int")
    counts = docs.groupBy(cell.alias("cell")).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), F.max("doc_id").alias("top"))
    everything = Window.partitionBy(F.lit(0))
    falling = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    most = F.least(F.lit(BUCKET_CHARS), F.greatest(F.lit(1), F.floor(F.sum("chars").over(everything) / parallel)))
    counts = counts.withColumn("raw", F.floor(F.coalesce(F.sum("chars").over(falling), F.lit(0)) / most))
    counts = counts.withColumn("bucket", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("raw")) - 1)
    counts = counts.withColumn("n", F.max("bucket").over(everything) + 1).withColumn("head", F.max("top").over(Window.partitionBy("bucket")))
    cells = counts.select("cell", "bucket", "head", F.pmod(F.col("bucket") - 1, F.col("n")).alias("closes"))
    dealt = docs.withColumn("cell", cell).join(F.broadcast(cells), "cell")
    own, ghost = F.struct(F.col("bucket"), F.lit(False).alias("ghost")), F.struct(F.col("closes").alias("bucket"), F.lit(True).alias("ghost"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, ghost)).otherwise(F.array(own))
    return dealt.withColumn("_place", F.explode(places)).withColumns({"bucket": F.col("_place.bucket"), "ghost": F.col("_place.ghost")}).drop("_place", "cell", "head", "closes")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    A text (null: empty) is edited by replacing its last third of code points by the first as many of the next text, by
    descending doc_id; the last takes from the first. Rows of equal doc_id follow each other by text; a single row is its
    own next. An empty table gives no rows. Other columns are ignored. One shuffle of the texts.
    """
    rows = in_rings(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = with_bins(rows, "text", "bins")
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_bins", F.lead("bins").over(order)).where(~F.col("ghost"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = with_bins(rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited), "edited", "edited_bins")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
