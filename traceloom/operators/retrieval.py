"""BM25 search, title lookup, and planning of seeded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import folded, hash_order, run_key, similarity, uniform
from ..plans.tables import written

K1, B = 1.5, 0.75


def terms(text):
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), 1)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 3, doc: str = "doc_id", query: str = "query_id", text: str = "text") -> DataFrame:
    """query, doc, score, rank of each query's best k documents with a score above 0; ties by doc.

    Postings are restricted to terms that queries have before anything is joined; statistics cover all documents.
    """
    tokens = docs.select(F.col(doc).alias("d"), terms(F.col(text)).alias("ts"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("mean"))
    wanted = queries.select(F.col(query).alias("q"), F.explode(terms(F.col(text))).alias("t")).groupBy("q", "t").agg(F.count("*").alias("times"))
    postings = tokens.select("d", F.size("ts").alias("len"), F.explode("ts").alias("t")).join(wanted.select("t").distinct(), "t", "left_semi").groupBy("d", "len", "t").agg(F.count("*").alias("tf"))
    df = postings.groupBy("t").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = K1 * (1 - B + B * F.col("len") / F.coalesce(F.nullif("mean", F.lit(0.0)), F.lit(1.0)))
    weighed = postings.join(df, "t").crossJoin(F.broadcast(stats)).withColumn("part", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))  # stats is one row
    scores = weighed.join(wanted, "t").groupBy("q", "d").agg(F.sum(F.col("part") * F.col("times")).alias("score")).where("score > 0")
    order = Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "d")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query), F.col("d").alias(doc), "score", "rank")


def _grams(text: Column, size: int) -> Column:
    """A text's q-grams, the n-th of a kind told apart from the others: as sets they overlap as multisets do."""
    plain = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1)), lambda i: F.substring(text, i, size)), lambda g: F.length(g) == size)
    return F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, 1, i + 1), lambda x: x == g)).cast("string")))


def _bound(total: Column, least: float, size: int) -> Column:
    """How many q-grams two texts of so many characters in all share at least, if they are as similar as `least`.

    Matching blocks hold M = least * total / 2 characters or more, so many single ones are shared. There is an unmatched
    character between two blocks, so blocks are at most total - 2 M + 1, and each holds one pair less than characters.
    """
    return F.ceil(total * least / 2 - 1e-6) if size == 1 else F.ceil(total * (1.5 * least - 1) - 1 - 1e-6)


def similar_candidates(wanted: DataFrame, titles: DataFrame, least: float, size: int) -> DataFrame:
    """(wanted, title): all pairs that can be as similar as `least`, by an inverted index of q-grams of 1 or 2 characters.

    A pair must have lengths that allow it, share a gram of both prefixes (the rarest grams, as many as a pair that shares
    none of them couldn't do without), and share enough grams in all. Pairs too short for the bound to ask for a gram of
    two characters are left out with size 2.
    """
    low = lambda n: F.ceil(n * least / (2 - least) - 1e-6)
    sides = wanted.select(F.col("wanted").alias("t"), F.lit(True).alias("w")).unionByName(titles.select(F.col("title").alias("t"), F.lit(False).alias("w"))).where("t IS NOT NULL")
    sides = sides.withColumn("c", folded("t")).withColumns({"n": F.length("c"), "g": _grams(F.col("c"), size)}).where("n > 0")
    each = sides.select("t", "w", "n", F.explode("g").alias("k"))
    rare = each.join(each.groupBy("k").agg(F.count("*").alias("df")), "k")
    kept = F.size("g") - F.greatest(F.lit(1), _bound(F.col("n") + low(F.col("n")), least, size)) + 1
    indexed = rare.groupBy("t", "w", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "k"))), lambda x: x["k"]).alias("g"))
    indexed = indexed.withColumn("h", F.transform("g", lambda x: F.xxhash64(x))).withColumn("p", F.explode(F.slice("h", F.lit(1), F.greatest(F.lit(0), kept).cast("int"))))
    left = indexed.where("w").select("p", F.col("t").alias("wanted"), F.col("n").alias("a"), F.col("h").alias("ga"))
    right = indexed.where("NOT w").select("p", F.col("t").alias("title"), F.col("n").alias("b"), F.col("h").alias("gb"))
    total = F.col("a") + F.col("b")
    enough = _bound(total, least, size)
    pairs = left.join(right, "p").where((F.least("a", "b") >= F.ceil(total * least / 2 - 1e-6)) & (enough >= (1 if size == 2 else 0)))
    return pairs.where(F.size(F.array_intersect("ga", "gb")) >= enough).select("wanted", "title").distinct()


def most_similar(wanted: DataFrame, titles: DataFrame, least: float, sure: float = 0.8) -> DataFrame:
    """(wanted, found): the most similar title of at least `least`; of equals the last by name.

    Pairs of at least `sure`, where the bound on pairs of characters is sharp, are looked for first; what has none, or may
    have one that is too short for that bound, is looked for by single characters.
    """

    def best(pairs: DataFrame, at_least: float) -> DataFrame:
        near = pairs.withColumn("s", similarity("wanted", "title")).where(F.col("s") >= at_least)
        return near.groupBy("wanted").agg(F.max_by("title", F.struct("s", "title")).alias("found"))

    if sure <= least:
        return best(similar_candidates(wanted, titles, least, 1), least)
    # from 10 characters in all on, pairs as similar as `sure` share two characters; a partner is no shorter than its part
    shortest = 2 / (1.5 * sure - 1) / (1 + sure / (2 - sure))
    long = wanted.where(F.length(folded(F.col("wanted"))) >= shortest)
    first = written(best(similar_candidates(long, titles, sure, 2), sure), "similar-titles")
    rest = wanted.join(first, "wanted", "left_anti")
    return first.unionByName(best(similar_candidates(rest, titles, least, 1), least))


def lookup(paragraphs: DataFrame, wanted: DataFrame, least: float = 0.6) -> DataFrame:
    """wanted title, found title, how: exact, else ignoring case, else the most similar of at least `least`.

    The first two are equi-joins, the last most_similar(). Null titles are found by none.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    titles = paragraphs.select("title").distinct()
    w = wanted.select(F.col("title").alias("wanted")).distinct()
    exact = w.join(titles, w["wanted"] == titles["title"]).select("wanted", F.col("title").alias("found"), F.lit("exact").alias("how"))
    rest = w.join(exact, "wanted", "left_anti")
    by_case = titles.groupBy(F.lower("title").alias("key")).agg(F.min("title").alias("found"))
    case = rest.withColumn("key", F.lower("wanted")).join(by_case, "key").select("wanted", "found", F.lit("case").alias("how"))
    rest = rest.join(case, "wanted", "left_anti").where("wanted IS NOT NULL")
    best = most_similar(rest, titles, least).withColumn("how", F.lit("similar"))
    return exact.unionByName(case).unionByName(best)


#: Shares of the seeded conditions, and of questions that get one.
MIX = {"missing_evidence": 0.4, "contradiction": 0.3, "early_stop": 0.2, "weak_model": 0.1}
SEEDED = 0.5


def plan_runs(questions: DataFrame, seed: str = "plan") -> DataFrame:
    """qid, condition, run_key: each question as it is, and some with a condition chosen by weight."""
    u, v = uniform(seed, F.col("qid")), uniform(f"{seed}-mix", F.col("qid"))
    total, choice = 0.0, F.lit(None).cast("string")
    for name, w in MIX.items():
        choice = F.coalesce(choice, F.when(v < total + w, F.lit(name)))
        total += w
    conditions = F.array_compact(F.array(F.lit("natural"), F.when(u < SEEDED, F.coalesce(choice, F.lit(list(MIX)[-1])))))
    return questions.select("qid", F.explode(conditions).alias("condition")).withColumn("run_key", run_key(F.col("qid").cast("string"), F.col("condition")))


def resume(planned: DataFrame, finished: DataFrame, key: str = "run_key") -> DataFrame:
    return planned.join(finished, key, "left_anti")


def decoys(questions: DataFrame, pool: DataFrame, seed: str = "decoy") -> DataFrame:
    """qid, decoy: another question's answer that differs, ignoring case, and isn't yes or no.

    Answers are ranked once by a hash; a question takes the answer that follows its own place on that ring, or the next
    but one, so nothing is crossed.
    """
    usable = pool.where(~F.lower("answer").isin("yes", "no")).select(F.lower("answer").alias("low"), "answer").groupBy("low").agg(F.min("answer").alias("answer"))
    ring = usable.withColumn("h", hash_order(seed, F.col("low")))
    shard = F.substring("h", 1, 2)
    inside = Window.partitionBy(shard).orderBy("h")
    heads = ring.groupBy(shard.alias("s")).agg(F.min_by("answer", "h").alias("head")).withColumn("next_head", F.coalesce(F.lead("head").over(Window.orderBy("s")), F.first("head").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    linked = ring.withColumn("s", shard).withColumn("after", F.lead("answer").over(inside)).join(F.broadcast(heads), "s")  # 256 shards
    follow = linked.select("low", F.coalesce("after", "next_head").alias("decoy"))
    first = F.first("head").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    any_ = heads.select(first.alias("any")).limit(1)
    out = questions.select("qid", F.lower("answer").alias("low")).join(follow, "low", "left").crossJoin(F.broadcast(any_))
    decoy = F.coalesce("decoy", "any")
    return out.select("qid", F.when(F.lower(decoy) != F.col("low"), decoy).alias("decoy"))


def apply_condition(questions: DataFrame) -> DataFrame:
    """paragraphs, max_tool_calls and model of a planned run (qid, condition, answer, decoy, paragraphs, gold_titles), and the condition that applied."""
    gold = F.filter("paragraphs", lambda p: F.array_contains("gold_titles", p["title"]) & F.contains(F.lower(p["text"]), F.lower("answer")))
    can = (F.size(gold) > 0) & F.col("decoy").isNotNull() & ~F.lower("answer").isin("yes", "no")
    applied = F.when((F.col("condition") == "contradiction") & ~can, "missing_evidence").otherwise(F.col("condition"))
    u = uniform("place", F.col("qid"))
    drop = F.get("gold_titles", F.floor(u * F.size("gold_titles")).cast("int"))
    place = F.floor(u * (F.size("paragraphs") + 1)).cast("int")
    quoted = F.concat(F.lit(r"(?i)\Q"), F.col("answer"), F.lit(r"\E"))
    fake = F.struct(F.concat(gold[0]["title"], F.lit(" (archived revision)")).alias("title"), F.regexp_replace(gold[0]["text"], quoted, F.regexp_replace(F.col("decoy"), r"([\\$])", r"\\$1")).alias("text"))
    inserted = F.concat(F.slice("paragraphs", F.lit(1), place), F.array(fake), F.slice("paragraphs", place + 1, F.size("paragraphs")))
    out = questions.withColumn("applied", applied)
    paragraphs = F.when(F.col("applied") == "contradiction", inserted).when(F.col("applied") == "missing_evidence", F.filter("paragraphs", lambda p: p["title"] != drop)).otherwise(F.col("paragraphs"))
    return out.withColumns({"paragraphs": paragraphs, "max_tool_calls": F.when(F.col("applied") == "early_stop", 1), "weak_model": F.col("applied") == "weak_model"})
