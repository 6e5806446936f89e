"""MinHash near-duplicates by tensored banding, each link confirmed on the full shingle sets.

A document has two small collections of SLOTS band hashes, each of ROWS minhashes. A table key is a pair of one from
either collection, so SLOTS**2 tables cost 2 * SLOTS * ROWS minhashes. Documents of equal sets are one class from the
start. Within a bucket classes are not paired off: all are compared with one centre, the components so far are found, and
only buckets that still hold several components are looked at again, between the components: small ones pair by pair,
large ones, merged where they share their largest component, in blocks whose intersections are matrix products and which return only links that join components. No candidate pair that could join two components goes unexamined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, joined_bytes, mix64, only_result, slices, span_hashes, word_spans, written

SLOTS, ROWS = 16, 4
#: Rounds of centres before what is left is compared between components.
ROUNDS = 1
#: Links of one centre that one task confirms.
GROUP = 512
#: Buckets of more members are compared in blocks of about BLOCK members rather than pair by pair, COLUMNS shingles at a time.
SMALL, BLOCK, COLUMNS = 16, 256, 4096
IS_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_STEP = np.uint64(0xD6E8FEB86659FD93)
FACTORS = mix64(np.arange(7_001, 7_001 + 2 * SLOTS * ROWS, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words (A-Z as lower case); fewer words are one run."""
    raw = [(x or "").encode("utf-8", "surrogatepass").lower() for x in texts]
    data, starts = joined_bytes(raw, b"\n")
    begin, end = word_spans(data, IS_WORD)
    cuts = np.searchsorted(begin, starts)
    if not len(begin):
        return [np.zeros(0, np.uint64) for _ in texts]
    hashes = span_hashes(data, begin, end)
    runs = hashes.copy()
    for k in range(1, size):
        runs[: len(runs) - k] = mix64(runs[: len(runs) - k] * _STEP + hashes[k:])
    out = []
    for i in range(len(texts)):
        a, b = int(cuts[i]), int(cuts[i + 1])
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = hashes[a : a + 1].copy()
            for k in range(a + 1, b):
                whole = mix64(whole * _STEP + hashes[k])
            out.append(mix64(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2 * SLOTS) band hashes of sets that aren't empty."""
    sizes = np.array([len(x) for x in sets])
    values, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    out = np.zeros((len(sets), 2 * SLOTS), np.uint64)
    for slot in range(2 * SLOTS):
        for r in range(ROWS):
            least = np.minimum.reduceat(values * FACTORS[slot * ROWS + r], starts)
            out[:, slot] = mix64(out[:, slot] * _STEP + least)
    return out


def class_of(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return tuple(int(np.add.reduce(mix64(values ^ salt)).astype(np.int64)) for salt in (np.uint64(0), _STEP))


def _signatures(docs: DataFrame, size: int, mark: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n, c1, c2, bands and, if named, the long column `mark` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            sets = shingle_sets(part.column(1).to_pylist(), size)
            full = [i for i, x in enumerate(sets) if len(x)]
            bands: list = [None] * len(sets)
            for i, row in zip(full, band_hashes([sets[i] for i in full]).astype(np.int64).tolist() if full else [], strict=True):
                bands[i] = row
            names = [class_of(x) for x in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array(bands, pa.list_(pa.int64())), *part.columns[2:]], ["doc_id", "n", "c1", "c2", "bands", *mark])

    kept = "".join(f", {name} long" for name in mark)
    return docs.select(F.col("doc_id").cast("long"), "text", *mark).transform(in_arrow, run, "doc_id long, n long, c1 long, c2 long, bands array<long>" + kept)


def _sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """c and the set (binary) of these classes (rep, c, c1, c2), from the text of each one's representative."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(classes.select("rep", "c1", "c2", "c"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch)):
            sets = shingle_sets(part.column(1).to_pylist(), size)
            names = list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
            right = [i for i, x in enumerate(sets) if class_of(x) == names[i]]  # rows that share a doc_id may differ
            yield pa.RecordBatch.from_arrays([part.column(4).take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())], ["c", "members"])

    return texts.transform(in_arrow, run, "c long, members binary").dropDuplicates(["c"])


def _numbered(classes: DataFrame) -> DataFrame:
    """Adds c, a class's 64-bit name: c1, or where classes share one, a hash of all 128 bits and the size."""
    shared = classes.groupBy("c1").agg(F.count("*").alias("times")).where("times > 1").select("c1", F.lit(True).alias("_shared"))
    if shared.isEmpty():
        return classes.withColumn("c", F.col("c1"))
    apart = F.when(F.col("_shared"), F.xxhash64("c1", "c2", "n")).otherwise(F.col("c1"))
    return written(classes.join(shared, "c1", "left").withColumn("c", apart).drop("_shared"), "nd-numbered")


def _buckets(keys: DataFrame) -> DataFrame:
    """Of keys (c, n, key) the buckets of several members, with their size, one key for each distinct set of members.

    A group of near copies shares many keys; one of them shows all that the others would.
    """
    h = F.xxhash64("c")
    sums = keys.groupBy("key").agg(F.count("*").alias("size"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y"))
    chosen = sums.where("size > 1").groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    return keys.join(chosen.select("key", "size"), "key")


def block_links(sets: list[np.ndarray], labels: list[int], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (places) between members of left and of right, no more than are needed to join the labels that they join.

    Intersections come from a product of 0/1 matrices over the shingles that several members have.
    """
    sizes = np.array([len(x) for x in sets])
    values, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, member = values[order], member[order]
    column = np.cumsum(np.append(0, values[1:] != values[:-1]))
    often = np.bincount(column)[column] > 1
    column, member = np.unique(column[often], return_inverse=True)[1], member[often]
    both = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (low, low + COLUMNS))
        some = np.zeros((len(sets), COLUMNS), np.float32)
        some[member[a:b], column[a:b] - low] = 1
        both += some[left] @ some[right].T
    total = sizes[left][:, None] + sizes[right][None, :] - both
    number = np.unique(labels, return_inverse=True)[1]
    hits = np.argwhere((100 * both >= percent * total) & (number[left][:, None] != number[right][None, :]))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    out = []
    for i, j in hits.tolist():
        x, y = root(int(number[left[i]])), root(int(number[right[j]]))
        if x != y:
            parent[x] = y
            out.append((int(left[i]), int(right[j])))
    return out


def _rows_of_mixed(held: DataFrame, mixed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (key, c, label, size, most, main) of the small and of the large ones of these mixed buckets (key, size, most, main).

    Large buckets of one largest component are made one where that compares less. Members of a group share many buckets,
    in each of which the same unlinked ones would be held against the same others. A merged bucket has all classes of its
    largest component, by labels (c, label), and the others of its buckets, so it holds a superset of their pairs and no
    candidate goes unexamined; and of its buckets only the others' rows are looked up.
    """
    many, rest = F.col("most"), F.col("size") - F.col("most")
    large = mixed.where(F.col("size") > SMALL)
    apart = large.groupBy("main").agg(F.sum((rest * (rest + many)).cast("double")).alias("apart"))
    beside = held.select("key", "c", "label").join(large.select("key", "main"), "key").where(F.col("label") != F.col("main"))
    beside = written(beside.select("main", "c", "label").distinct(), "nd-beside")
    mains = labels.groupBy(F.col("label").alias("main")).agg(F.count("*").alias("most"))
    sizes = beside.groupBy("main").agg(F.count("*").alias("others")).join(mains, "main").withColumn("size", F.col("others") + F.col("most"))
    better = written(sizes.join(apart, "main").where((F.col("others") * F.col("size")).cast("double") <= F.col("apart")).select("main", "size", "most"), "nd-merged")
    members = beside.unionByName(labels.select(F.col("label").alias("main"), "c", "label"))
    one = members.join(better, "main").select(F.xxhash64(F.lit("merged"), "main").alias("key"), "c", "label", "size", "most", "main")
    alone = large.join(better.select("main"), "main", "left_anti").select(*mixed.columns).unionByName(mixed.where(F.col("size") <= SMALL))
    rows = written(held.select("key", "c", "n", "label").join(alone, "key"), "nd-mixed")
    return rows.where(F.col("size") <= SMALL), rows.where(F.col("size") > SMALL).select(*one.columns).unionByName(one)


def _linked_in_blocks(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across the labels of each large bucket. A member goes to each pair of blocks that has its own.

    Members of a bucket's largest component fill blocks of their own, which aren't compared with each other.
    """
    minor, major = F.ceil((F.col("size") - F.col("most")) / BLOCK), F.ceil(F.col("most") / BLOCK)
    spread = F.xxhash64(F.lit(7), "c")
    mine = F.when(F.col("label") == F.col("main"), minor + F.pmod(spread, major)).otherwise(F.pmod(spread, minor))
    last = F.when(F.col("label") == F.col("main"), minor - 1).otherwise(minor + major - 1)
    both = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    rows = held.select("key", "c", "label", mine.alias("mine"), F.explode(both).alias("at")).select("key", "at.i", "at.j", "mine", "c", "label").join(sets, "c")
    rows = rows.select("key", "i", "j", "mine", "c", "label", "members").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_ = None, []

        def done() -> pa.RecordBatch:
            side = np.array([x[0] for x in held_])
            left, right = (np.flatnonzero(side == now[1]), np.flatnonzero(side == now[2]))
            found = block_links([x[3] for x in held_], [x[2] for x in held_], left, right, percent) if len(left) and len(right) else []
            return pa.RecordBatch.from_arrays([pa.array([held_[k[e]][1] for k in found], pa.int64()) for e in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for key, i, j, side, c, label, members in zip(*columns, batch.column(6), strict=True):
                if now != (key, i, j) and held_:
                    yield done()
                    held_ = []
                now = (key, i, j)
                held_.append((side, c, label, np.frombuffer(members.as_buffer(), np.uint64).copy()))
        if held_:
            yield done()

    return rows.transform(in_arrow, run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those whose sets have a similarity of percent / 100 at least.

    Pairs go to the task of a, in groups of at most about GROUP; a's set is sent to each of its groups.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    salted = pairs.join(groups, "a").withColumn("salt", F.pmod(F.xxhash64("b"), "groups"))
    members = salted.join(sets.withColumnRenamed("c", "b"), "b").select("a", "salt", "b", "members")
    centres = groups.join(sets.withColumnRenamed("c", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "members")
    rows = centres.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            found = []
            a, salt, b, sets_ = (batch.column(i) for i in range(4))
            for x, s, y, z in zip(a.to_pylist(), salt.to_pylist(), b.to_pylist(), sets_, strict=True):
                values = np.frombuffer(z.as_buffer(), np.uint64)
                if y is None:
                    at, centre = (x, s), values
                elif at == (x, s):
                    both = len(np.intersect1d(centre, values, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(values) - both):
                        found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], ["a", "b"])

    return rows.transform(in_arrow, run, "a long, b long")


def _flat(to: DataFrame) -> DataFrame:
    """c and the end of its chain, of pointers (c, to) none of which lead up; ends point to themselves."""
    while True:
        beyond = to.select(F.col("c").alias("to"), F.col("to").alias("beyond"))
        step = written(to.join(beyond, "to").select("c", F.col("beyond").alias("to"), (F.col("to") != F.col("beyond")).alias("moved")), "cc")
        to = step.select("c", "to")
        if step.where("moved").isEmpty():
            return to


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """c and label, its component's least vertex, of each vertex of the links (a, b) and of `known`, labels of earlier links.

    Each vertex points to its least neighbour, chains of these are followed to their ends, and links go on between the ends
    alone, which leaves few after a round or two.
    """

    def moved(links: DataFrame, to: DataFrame) -> DataFrame:
        for end in "ab":
            links = links.join(to.select(F.col("c").alias(end), F.col("to").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def followed(label: DataFrame, to: DataFrame) -> DataFrame:
        return written(label.join(to.withColumnRenamed("c", "label"), "label", "left").select("c", F.coalesce("to", "label").alias("label")), "cc-labels")

    ends = links.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    if known is None:
        label = ends.withColumn("label", F.col("c"))
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    else:
        label = known.unionByName(ends.join(known, "c", "left_anti").withColumn("label", F.col("c")))
        links = moved(links, known.select("c", F.col("label").alias("to")))
    label, links = written(label, "cc-labels"), written(links, "cc-links")
    while not links.isEmpty():
        near = links.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("to"))  # a is less: only upper ends move
        to = _flat(written(near.unionByName(links.select(F.col("a").alias("c")).distinct().join(near, "c", "left_anti").withColumn("to", F.col("c"))), "cc"))
        label, links = followed(label, to), written(moved(links, to), "cc-links")
    return label


def _close(percent: int, n: str = "n", m: str = "m"):
    """Sizes that allow the similarity."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links), kept (doc_id = component_id) of each row of docs.

    Null and empty texts have no shingles and link with nothing; so do rows of null doc_id, which are kept. Rows of equal
    doc_id are documents of their own that share the id. An empty table gives no rows. Other columns are ignored.
    """
    return only_result(docs.sparkSession, "near-dup", lambda: _near_duplicates(docs, size, percent))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps one: of least doc_id, then by hash of the text, then by all columns.

    Rows count each for itself, also those that share a doc_id; wholly repeated ones are one component. Rows without
    shingles and of null doc_id stay, all of them. Of (doc_id, text) rows that are kept once, only repeated ones are shuffled
    with their text.
    """
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    at = ["doc_id", "_mark"]

    def decided() -> DataFrame:
        signed, named = _components(marked, size, percent, ("_mark",))
        rows = signed.where("n > 0 AND doc_id IS NOT NULL").join(named, ["c1", "c2", "n"]).select("doc_id", "_mark", "label")
        first = rows.groupBy("label").agg(F.min(F.struct(*at)).alias("x")).select("x.*", F.lit(True).alias("first"))
        each = rows.groupBy(*at).agg(F.count("*").alias("times"))
        return each.join(first, at, "left").where("first IS NULL OR times > 1").select(*at, F.col("first").isNotNull().alias("again"))

    decisions = only_result(docs.sparkSession, "near-dup", decided)
    again = decisions.where("again").select(*at)
    repeated = marked.join(again, at, "left_semi").groupBy(*at).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return marked.join(decisions, at, "left_anti").select(*docs.columns).unionByName(repeated.select("_row.*"))


def _near_duplicates(docs: DataFrame, size: int, percent: int) -> DataFrame:
    signed, named = _components(docs, size, percent)
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "label").select("c1", "c2", "n", "component_id")
    alone = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = some.select("doc_id", "n", "c1", "c2").join(named, ["c1", "c2", "n"]).select("doc_id", "n", "component_id").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _components(docs: DataFrame, size: int, percent: int, mark: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The signatures of the rows of docs, and the classes (c1, c2, n, rep) of those with shingles and doc_id, with their component's label."""
    signed = written(_signatures(docs, size, mark), "nd-signatures")
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = _numbered(written(some.groupBy("c1", "c2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "nd-classes"))
    # a class whose band hashes nobody shares has no partner; only shared ones make keys
    bands = classes.select("c", "n", F.posexplode("bands").alias("slot", "h"))
    shared = bands.groupBy("slot", "h").agg(F.count("*").alias("times")).where("times > 1")
    live = bands.join(shared, ["slot", "h"]).groupBy("c", "n").agg(F.collect_list(F.struct("slot", "h")).alias("held"))  # 2 * SLOTS at most
    pair = F.transform(F.filter("held", lambda x: x["slot"] < SLOTS), lambda x: F.transform(F.filter("held", lambda y: y["slot"] >= SLOTS), lambda y: F.xxhash64(x["slot"], x["h"], y["slot"], y["h"])))
    keys = live.select("c", "n", F.explode(F.flatten(pair)).alias("key"))
    buckets = written(_buckets(keys), "nd-buckets")
    candidates = classes.join(buckets.select("c").distinct(), "c", "left_semi")
    sets = written(_sets(docs, candidates, size), "nd-sets", "none")
    tried = label = None
    for turn in range(ROUNDS + 1):
        held = buckets
        if label is not None:  # only buckets of several components
            labels = written(buckets.select("c").distinct().join(label, "c", "left").withColumn("label", F.coalesce("label", "c")), "nd-labels")
            held = held.join(labels, "c")
            parts = held.groupBy("key", "label").agg(F.count("*").alias("most"))
            mixed = parts.groupBy("key").agg(F.sum("most").alias("size"), F.max(F.struct("most", "label")).alias("x"), F.count("*").alias("parts")).where("parts > 1")
            mixed = written(mixed.select("key", "size", "x.most", F.col("x.label").alias("main")), "nd-several")
            if mixed.isEmpty():
                break
        else:
            held = held.withColumn("label", F.col("c"))
        if turn < ROUNDS:
            if label is not None:
                held = held.join(mixed.select("key"), "key", "left_semi")
            centre = F.min(F.struct(F.xxhash64(F.lit(turn), "c").alias("o"), F.col("c"), F.col("n"), F.col("label")))
            centres = held.groupBy("key").agg(centre.alias("x")).select("key", F.col("x.c").alias("a"), F.col("x.n").alias("m"), F.col("x.label").alias("other"))
            pairs = held.join(centres, "key").where(F.col("label") != F.col("other"))
        else:
            few, large = _rows_of_mixed(held, mixed, labels)
            other = few.select("key", F.col("c").alias("a"), F.col("n").alias("m"), F.col("label").alias("other"))
            pairs = few.join(other, "key").where(F.col("label") < F.col("other"))
        pairs = pairs.where(_close(percent)).select("a", F.col("c").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
        pairs = written(pairs, "nd-pairs")
        found = _confirmed(pairs, sets, percent)
        if turn == ROUNDS:
            found = found.unionByName(_linked_in_blocks(large, sets, percent))
        found = written(found, "nd-links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        label = components(found, label)
    return signed, classes.join(label, "c", "left").withColumn("label", F.coalesce("label", "c"))
