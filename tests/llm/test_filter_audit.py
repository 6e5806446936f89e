"""The filter audit against orders applied one by one."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb

from tests.llm.conftest import ODD
from traceloom.llm import filter_audit
from traceloom.llm.queries import OP12_SQL

RNG = random.Random(12)


def made(n):
    """Rows (doc_id, text, lang) of all kinds: short, repetitive, in capitals, with marks, copies, repeated ids, nulls."""
    rows = [(i, t, RNG.choice(["en", "de", None, ""])) for i, t in ODD]
    for i in range(n):
        words = [f"w{RNG.randrange(RNG.choice([20, 4000]))}" for _ in range(RNG.choice([5, 199, 200, 230]))]
        t = RNG.choice([" ", "\n", " \t", "\x0b"]).join(words)
        t = t.upper() if RNG.random() < 0.2 else t
        t = t + " $5" if RNG.random() < 0.2 else t
        rows.append((RNG.choice([None, 20 + i, 20 + i, 20 + RNG.randrange(n)]), RNG.choice([t, t, rows[-1][1], rows[0][1], ""]), RNG.choice(["en", "en", "fr", None])))
    return rows


def brute(rows, labels):
    """All orders, applied to the documents themselves."""

    def fails(i, t):
        words, t = re.findall(r"[^\x20\x09-\x0D]+", t or ""), t or ""
        same = [j for j, u, _ in rows if (u or "") == t and j is not None and i is not None and j < i]
        bits = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), bool(same))
        return {x for x, b in zip("ABCDE", bits, strict=True) if b}

    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    failed = [(p or "", i, fails(i, t)) for i, t, p in rows]
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in failed}:
        own = [(i, f) for p, i, f in failed if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                lost = lambda of: sum(i in of for i, _ in gone if i is not None)  # noqa: B023, E731
                redundant = sum(name in f for _, f in own) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f == {name} for _, f in own), lost(good), lost(toxic), name]
                shapley[part, name] += len(gone)
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "m", 1) for r in rows], "doc_id long, text string, lang string, mask string, n int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


LABELS = [(i, RNG.choice([0, 1, None]), RNG.choice([0, 1])) for i in range(0, 150, 2)] + [(22, 1, 1), (24, 0, 0), (None, 1, 1)]


def test_equals_orders_one_by_one(spark):
    rows = made(90)
    out = filter_audit.filter_audit(*frames(spark, rows, LABELS)).collect()
    want = brute(rows, LABELS)
    assert len(out) == len(want) == 600 * len({p or "" for _, _, p in rows})
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in out} == want


def test_sql_gives_the_same_rows(spark):
    rows = [r for r in made(60) if r[0] is not None]
    docs, labels = frames(spark, rows, LABELS)
    out = {tuple(r) for r in filter_audit.filter_audit(docs, labels).collect()}
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        db.register("labels", labels.toArrow())
        names = ["part", "filter_order", "step", *filter_audit._COUNTS, "shapley"]
        assert {tuple(r) for r in db.sql(f"SELECT {', '.join(names)} FROM ({OP12_SQL})").fetchall()} == out


def test_no_documents(spark):
    assert filter_audit.filter_audit(*frames(spark, [], [])).count() == 0
    assert filter_audit.filter_audit(*frames(spark, [(1, None, None)], [])).count() == 600
