"""Similar titles against all pairs, and how many pairs are looked at."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from traceloom.operators import retrieval as R

RNG = random.Random(16)
SF = "/root/testdata/sf0.001"


def ratio(a, b):
    return SequenceMatcher(None, a.casefold(), b.casefold()).ratio()


def changed(text):
    chars = list(text)
    for _ in range(RNG.randrange(1, 7)):
        chars[RNG.randrange(len(chars))] = RNG.choice(["", "x", "e", " ", "zz"])
    return "".join(chars)


@pytest.fixture(scope="module")
def parts(spark):
    return sorted({r["p_name"] for r in spark.read.parquet(f"{SF}/part.parquet").collect()})


def frames(spark, wanted, titles):
    return spark.createDataFrame([(x,) for x in wanted], "wanted string"), spark.createDataFrame([(x,) for x in titles], "title string")


def test_equals_all_pairs(spark, parts):
    wanted = sorted({changed(x) for x in parts} | {"", "a", "qqqqqq", "ab", "SS", "éé", parts[0][:6]} | {"".join(RNG.choice("abcdef ") for _ in range(RNG.randrange(1, 14))) for _ in range(60)})
    titles = [*parts, "A", "b", "ß", "Éé", "abc", "cab fed", "", None]
    for least in (0.6, 0.85):
        got = {r["wanted"]: r["found"] for r in R.most_similar(*frames(spark, [*wanted, None], titles), least).collect()}
        want = {}
        for w in wanted:
            best = max(((ratio(w, t), t) for t in titles if t), default=(0, ""))
            if w and best[0] >= least:
                want[w] = best[1]
        assert got == want


def test_no_pair_is_lost_and_few_are_looked_at(spark, parts):
    wanted = [changed(x) for x in parts]
    w, t = frames(spark, wanted, parts)
    found = {(r["wanted"], r["title"]) for r in R.similar_candidates(w, t, 0.8, 2).collect()}
    assert {(a, b) for a in wanted for b in parts if ratio(a, b) >= 0.8 and len(a) + len(b) >= 10} <= found
    alike = sum(min(len(a), len(b)) >= 0.4 * (len(a) + len(b)) for a in wanted for b in parts)
    assert len(found) < alike / 5
    single = R.similar_candidates(w, t, 0.6, 1)
    assert {(a, b) for a in wanted[:40] for b in parts if ratio(a, b) >= 0.6} <= {(r["wanted"], r["title"]) for r in single.where(F.col("wanted").isin(wanted[:40])).collect()}


def test_lookup_in_its_three_ways(spark):
    titles = spark.createDataFrame([("Paris",), ("paris",), ("Berlin Wall",), (None,)], "title string")
    wanted = spark.createDataFrame([("Paris",), ("PARIS",), ("Berlin Wal",), ("zzz",), (None,)], "title string")
    assert {(r["wanted"], r["found"], r["how"]) for r in R.lookup(titles, wanted).collect()} == {("Paris", "Paris", "exact"), ("PARIS", "Paris", "case"), ("Berlin Wal", "Berlin Wall", "similar")}
