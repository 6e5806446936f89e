"""The operators on small fixtures: brute force, exact round trips, held-out accuracy, odd rows, empty tables."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from traceloom.llm import classify, common, decontaminate, fingerprint, induced, langid, mixing, near_dup, quality, queries, suffix_dedup, token_output, toxicity
from traceloom.llm.queries import tokenizer_path

RNG = random.Random(5)
VOCAB = [f"{a}{b}" for a in "the an or in re th er".split() for b in "ly ing ed st nd ha wh".split()]


def text(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(t, n, rng=RNG):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB) + "z"
    return " ".join(w)


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n = int(rng.integers(0, 2000))
        bits = rng.integers(0, 65, n) if trial % 2 else np.full(n, int(rng.integers(0, 20)))
        values = np.array([(int(rng.integers(0, 1 << 63)) * 2) >> (64 - int(b)) if b else 0 for b in bits], np.uint64)
        words, escapes, _ = token_output.pack(values)
        assert (token_output.unpack(words, escapes) == values).all()
        block = token_output.to_block([values[: n // 2], values[n // 2 :]])
        assert (np.concatenate(token_output.from_block(block)) == values).all()
        a, b = sorted(rng.integers(0, n + 1, 2))
        assert (token_output.ids_between(block, a, b) == values[a:b]).all()


def test_memoised_encoder_equals_the_tokenizer():
    encoder = token_output.WordEncoder(tokenizer_path(), most=50)
    for t in [x or "" for _, x in ODD] + ["I'LL don't, İ ß\x0b\x0cx \x1c", " ".join(text(30) for _ in range(5)), "a.b, c! (d) e|f"]:
        assert list(encoder.encode(t)) == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_new_pieces_go_to_the_tokenizer_some_at_a_time():
    encoder, sizes = token_output.WordEncoder(tokenizer_path()), []
    given = encoder.tokenizer
    words = [f"pé{a}{b}{m}" for a in "abcdefghij" for b in "klmnopqrst" for m in ("", ",", "|", "~", "|~", "'s")] + [f"p{a}{b}x" for a in "abcdefghij" for b in "klmnopqrst"]

    class Seen:
        def encode_batch_fast(self, texts, **more):
            sizes.extend(len(x.split()) for x in texts)
            return given.encode_batch_fast(texts, **more)

    encoder.tokenizer = Seen()
    assert list(encoder.encode(" ".join(words))) == given.encode(" ".join(words), add_special_tokens=False).ids
    assert max(sizes) <= 2 * token_output.TOGETHER


def test_every_letter_equals_the_tokenizer():
    """Each letter alone, before closing marks, after others and with an apostrophe; those that normalise to marks too."""
    encoder = token_output.WordEncoder(tokenizer_path())
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha() and not (0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0x20000 <= c)]
    rows = ["VERGİSİ. VERGİSİ \u0958. \u0958 \ufb1d. İ! J\u030c word. word", *(f"a{c}. {c}b) a{c}'s {c}" for c in letters)]
    true = [np.array(x.ids) for x in encoder.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
    assert [x for x, a, b in zip(rows, encoder.encode_all(rows), true, strict=True) if not np.array_equal(a, b)] == []


def test_span_keys_tell_bytes_apart():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(0, 3, rng.integers(0, 30), np.uint8)) for _ in range(3000)] + [b"\0", b"\0\0", b"", b"x" * 5000, b"x" * 5001]
    data, at = common.joined_bytes(parts, b"")
    keys = common.span_keys(data, at[:-1], at[1:])
    named = {}
    for part, key in zip(parts, zip(*keys.tolist(), strict=True), strict=True):
        assert named.setdefault(key, part) == part
    assert len(named) == len(set(parts))


def test_token_output(docs):
    rows = sorted(token_output.token_output(docs(ODD), tokenizer_path(), 2).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    assert token_output.token_output(docs([]), tokenizer_path(), 2).count() == 0


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_quality_held_out(docs):
    good = [(text(60), 1) for _ in range(300)]
    bad = [(" ".join(f"{w}###" for w in text(40).split()), 0) for _ in range(60)] + [(" ".join([RNG.choice(VOCAB)] * 50), 0) for _ in range(60)]
    rows = good + bad
    RNG.shuffle(rows)
    model = quality.fit([t for t, _ in rows[:300]], [y for _, y in rows[:300]])
    score = quality.scorer(model)([t for t, _ in rows[300:]])["score"]
    assert auc(score, np.array([y for _, y in rows[300:]])) > 0.98
    assert ((0 <= quality.scorer(model)([None, "", "x"])["score"]) & (quality.scorer(model)([None, "", "x"])["score"] <= 1)).all()


def test_toxicity_held_out(docs):
    rows = [(text(50), 0) for _ in range(400)] + [(text(25) + " you idiot " + text(25), 1) for _ in range(60)] + [(text(25) + " blorgfoo " + text(25), 1) for _ in range(60)]
    RNG.shuffle(rows)
    model = toxicity.fit([t for t, _ in rows[:400]], [y for _, y in rows[:400]])
    score = toxicity.scorer(model)([t for t, _ in rows[400:]])["score"]
    assert auc(score, np.array([y for _, y in rows[400:]])) > 0.97


def test_language_held_out():
    words = {"aa": "kal mer tosi", "bb": "zug pfen licht", "cc": "que por dado"}
    rows = [(" ".join(RNG.choice(words[k].split()) for _ in range(30)), k) for k in words for _ in range(60)]
    RNG.shuffle(rows)
    model = langid.fit([t for t, _ in rows[:120]], [k for _, k in rows[:120]])
    got = langid.scorer(model)([t for t, _ in rows[120:]])["best_lang"]
    assert np.mean([a == k for a, (_, k) in zip(got, rows[120:], strict=True)]) > 0.95
    assert langid.scorer(model)([None, "", "12 !?", "½ ² ①", "_ٱ"])["best_lang"][:4] == ["und"] * 4


def test_isotonic_is_monotone():
    x, p = classify.isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all()


def test_scores_of_odd_rows(docs, spark):
    training = spark.createDataFrame([(i, text(20), i % 2) for i in range(40)], "doc_id long, text string, y int")
    for made in (quality.quality_scores(docs(ODD), training, "y"), toxicity.toxicity_scores(docs(ODD), training, "y")):
        assert len(made.collect()) == len(ODD)
    assert quality.quality_scores(docs([]), training.limit(0), "y").count() == 0
    out = langid.languages(docs(ODD), training.withColumnRenamed("y", "l").limit(0), "l").collect()
    assert len(out) == len(ODD)


def test_fingerprints(docs):
    rows = [(i, text(RNG.randrange(1, 300))) for i in range(60)] + [(100 + i, t) for i, (_, t) in enumerate(ODD)]
    out = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs(rows)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    sets = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())([x for x in re.split(r"[\x20\x09-\x0d]+", t.lower()) if x])
    errors = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        third = len(t) // 3
        e = t[: len(t) - third] + nxt[:third]
        assert out[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and out[i]["n_chars"] == len(t)
        a, b = sets(t), sets(e)
        errors.append(out[i]["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.sqrt(np.mean(np.square(errors))) < 0.08
    assert fingerprint.edited_fingerprints(docs([])).count() == 0
    single = fingerprint.edited_fingerprints(docs([(1, "a b c d e f")])).first()
    assert single["near_next"] == 1.0


def test_mixing_targets(docs):
    rows = [(i, text(20), f"s{i % 3}" if i % 7 else None) for i in range(400)] + [(1000, None, "s0"), (1001, "", "s1"), (1001, "", "s1")]
    out = mixing.mixture(docs(rows)).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        s = by.setdefault(r["source"], [r["target"], 0, r["source_size"]])
        s[1] += r["taken"]
    assert sum(t for t, _, _ in by.values()) == pytest.approx(1.5 * total)
    assert all(abs(got - target) <= 40 and target <= 2 * size for target, got, size in by.values())
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mixture(docs(rows)).collect()), key=str)
    assert mixing.mixture(docs([])).count() == 0


def test_decontamination_by_brute_force(docs, spark):
    items = [("a", text(30)), ("b", text(12)), ("c", "only three words"), ("d", None), ("e", ""), ("f", text(10))]
    rows = [(i, text(40) + " " + (items[i % 6][1] or "")[: RNG.randrange(10, 200)] + " ONLY three, words! " * (i % 4 == 0) + text(30)) for i in range(60)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(ODD)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (8 << 20, 200):  # one block, several
        out = {r["doc_id"]: r for r in decontaminate.decontaminated(docs(rows), bench, block_bytes=block).collect()}
        for i, t in rows:
            w, hit, names = decontaminate.words_of(t), set(), set()
            for name, item in items:
                x = decontaminate.words_of(item)
                n = min(10, len(x))
                for k in range(len(x) - n + 1) if n else ():
                    for p in range(len(w) - n + 1):
                        if w[p : p + n] == x[k : k + n]:
                            hit.update(range(p, p + n))
                            names.add(name)
            r = out[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(names), bool(hit)), i
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    clean = {r["doc_id"] for r in decontaminate.remove_contaminated(docs(rows), bench).collect()}
    assert clean == {i for i in out if not out[i]["contaminated"]}
    assert decontaminate.decontaminated(docs([]), bench.limit(0)).count() == 0


def test_induced_order():
    rng = np.random.default_rng(1)
    for t in range(150):
        x = np.append(rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 60))), 0).astype(np.uint16)
        assert induced.suffix_order(x, budget=64 if t % 2 else 1 << 20).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_suffix_dedup_by_brute_force(docs):
    base = [text(120) for _ in range(6)]
    rows = [(i, edited(base[i % 6], RNG.randrange(0, 6)) + ("\0" * 70 if i % 9 == 0 else "")) for i in range(40)] + [(50 + i, t) for i, (_, t) in enumerate(ODD)]
    out = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs(rows)).collect()}
    seen = set()
    for i, t in sorted(rows):
        b = (t or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        mask = np.zeros(len(b), bool)
        for k, w in enumerate(own):
            if w in seen:
                mask[k : k + 50] = True
        seen.update(own)
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        assert (out[i]["n_bytes"], out[i]["n_removed"], bytes(out[i]["kept"])) == (len(b), int(mask.sum()), kept), i
        assert out[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert suffix_dedup.deduplicated(docs([])).count() == 0
    assert suffix_dedup.deduplicated(docs(ODD)).count() == len(ODD)


def test_suffix_dedup_splits_a_hot_hash(docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 2000, raising=False)
    dealt, made = [], suffix_dedup._pieces_to_sort
    monkeypatch.setattr(suffix_dedup, "_pieces_to_sort", lambda *a: dealt.append(made(*a)) or dealt[-1])
    rng = random.Random(13)
    passage = text(14, rng)
    rows = [(i if i % 9 else None, text(12, rng) + passage + text(12, rng)) for i in range(90)] + [(200 + i, "x" * (5000 + i)) for i in range(3)] + [(7, text(3, rng) + passage)]
    out = suffix_dedup.deduplicated(docs(rows)).collect()
    shards = dealt[0].groupBy("shard").agg(F.sum(F.octet_length("data")).alias("n"), F.max(F.octet_length("data")).alias("largest")).collect()
    assert max(r["n"] or 0 for r in shards) < 4000
    seen, want, n = {}, [], 1 << 63
    for i, t in rows:
        for k in range(len(t) - 49):
            seen[t[k : k + 50]] = min(seen.get(t[k : k + 50], n), n if i is None else i)
    for i, t in rows:
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if seen[t[k : k + 50]] < (n if i is None else i):
                mask[k : k + 50] = True
        want.append((i, int(mask.sum()), "".join(x for x, m in zip(t, mask, strict=True) if not m)))
    assert sorted(((r["doc_id"], r["n_removed"], bytes(r["kept"]).decode()) for r in out), key=str) == sorted(want, key=str)


def test_strings_of_a_hot_hash_come_back_as_stretches(docs, monkeypatch):
    """A passage of a hot hash in documents of many slices: one row for each stretch, none for each string."""
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 200)
    found, made = [], suffix_dedup._hot_out
    monkeypatch.setattr(suffix_dedup, "_hot_out", lambda *a: found.append(made(*a)) or found[-1])
    rng = random.Random(17)
    passage = text(14, rng)
    rows = [(i, text(12, rng) + passage + text(12, rng)) for i in range(60)]
    out = {r["doc_id"]: r for r in suffix_dedup.deduplicated(docs(rows)).collect()}
    assert out[0]["n_removed"] == 0 and all(r["n_removed"] >= len(passage) for i, r in out.items() if i)
    spans = found[0].collect()
    assert spans and max(r["n"] for r in spans) > 8
    assert len(spans) < sum(r["n"] for r in spans) / 3


def test_shared_hashes_return_in_rows_of_slices_not_of_documents(docs, monkeypatch):
    """Whatever the number of ranges: a range makes no row for each document, and in the end each document has one, with just its hashes."""
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 2000)
    rng = random.Random(19)
    passages = [text(14, rng) for _ in range(4)]
    rows = [(i, text(6, rng) + passages[i % 4 if i % 3 else 0] + text(6, rng)) for i in range(120)] + [(200, text(30, rng))]
    own, weight, holders = {}, {}, {}
    for i, t in rows:
        key, _, count, _ = suffix_dedup.pieces(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 50)
        own[i] = set(key.tolist())
        for k in own[i]:
            holders[k] = holders.get(k, 0) + 1
            size = max(128, int((count[key == k] + 49).sum()))
            weight[k] = weight.get(k, 0) + 2 ** (size - 1).bit_length()
    base = docs(rows).coalesce(2).selectExpr("doc_id AS mark", "text")
    hashes = suffix_dedup._hashes(base, 64, 50)
    blocks = suffix_dedup._shared(hashes)
    assert blocks.count() <= hashes.count() <= 2 * 64
    lists = suffix_dedup._lists(blocks).collect()
    assert len(lists) == len({r["mark"] for r in lists}) <= len(rows)
    got = {r["mark"]: tuple(set(suffix_dedup._wide(bytes(r[c] or b"")).tolist()) for c in ("keys", "hot")) for r in lists}
    for i, keys in own.items():
        several = {k for k in keys if holders[k] > 1}
        large = {k for k in several if weight[k] > 2000}
        assert got.get(i, (set(), set())) == (several - large, large)
    assert any(hot for _, hot in got.values()) and any(keys for keys, _ in got.values())


@pytest.mark.parametrize("length", [24, 50, 51])
def test_a_run_shared_amid_differing_text_proves_single(length, monkeypatch):
    """Texts that share a run of GRAM bytes alone have no hash in common; a string has one hash wherever it stands."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rng = random.Random(23)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    run, passage = letters(suffix_dedup.GRAM), letters(400)

    def hashes(texts):
        data, starts = suffix_dedup._joined(texts)
        key, at, count, owner = suffix_dedup.pieces(data, starts, length)
        assert count.sum() == sum(max(0, len(t) - length + 1) for t in texts) and (at + count + length - 1 <= starts[owner + 1]).all()
        return key, np.repeat(key, count), [bytes(data[a + i : a + i + length]) for a, n in zip(at.tolist(), count.tolist(), strict=True) for i in range(n)], owner

    key, _, _, owner = hashes([letters(60) + run + letters(60) for _ in range(50)])
    assert len(np.unique(key)) == len(np.unique(np.stack([key, owner.astype(np.uint64)]), axis=1).T)
    periodic = [(letters(p) * 60)[:n] for p, n in ((1, 900), (2, 400), (17, 300), (18, 300), (35, 300), (60, 300))]
    _, each, strings, _ = hashes([letters(7 * i) + t + letters(5) for i, t in enumerate([passage, *periodic] * 3)] + [passage[100:300]])
    assert len(set(zip(each.tolist(), strings, strict=True))) == len(set(strings))
    assert len(hashes(["a" * 5000])[0]) <= 2


def test_near_dup_leaves_the_largest_component_of_mixed_buckets(docs, monkeypatch):
    """Of buckets of several components only the others' rows are looked up, and the result is that of the pairs."""
    monkeypatch.setattr(near_dup, "SMALL", 2)
    counts, rows_of = {}, near_dup.written

    def counted(df, name, *more):
        made = rows_of(df, name, *more)
        if name in ("nd-mixed", "nd-several"):
            counts[name] = made.count() if name == "nd-mixed" else made.agg(F.sum("size")).first()[0]
        return made

    monkeypatch.setattr(near_dup, "written", counted)
    rng = random.Random(23)
    base = text(80, rng).split()
    rows = [(i, " ".join(base[:k] + [f"q{i}"] + base[k + 1 :])) for i in range(60) for k in [rng.randrange(80)]]
    rows += [(100 + i, " ".join(base[: 60 - i] + [f"r{i}{k}" for k in range(20)])) for i in range(4)]
    out = near_dup.near_duplicates(docs(rows), size=1).collect()
    sets = {i: set(t.split()) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r["doc_id"]: r["component_id"] for r in out} == comp
    assert counts["nd-mixed"] < counts["nd-several"] / 2


@pytest.mark.parametrize("small", [16, 2])
def test_near_dup_by_brute_force(docs, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    base = [text(80) for _ in range(4)]
    rows = [(i, edited(base[i % 4], RNG.randrange(0, 9))) for i in range(60)] + [(200 + i, t) for i, (_, t) in enumerate(ODD)]
    out = {r["doc_id"]: r for r in near_dup.near_duplicates(docs(rows), size=2).collect()}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(low)) if x]
        return {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and comp[a] < comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[b] = comp[a]
                    changed = True
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in out.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert near_dup.near_duplicates(docs([])).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    start = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(C.STAGES)
    docs_ = stages["toxicity"](spark, start, sf)
    assert docs_.columns == start.columns and 0 < docs_.count() <= start.count()
    kept = stages["near-dup"](spark, docs_, sf)
    groups = near_dup.near_duplicates(docs_)
    assert kept.count() == groups.where("kept").count()
    clean = stages["decontamination"](spark, kept, sf)
    mixed = stages["mixing"](spark, clean, sf)
    assert mixed.columns == start.columns
    assert mixed.count() == mixing.mixture(clean).agg({"copies": "sum"}).first()[0]
    out = stages["tokens"](spark, mixed, sf)
    assert out.count() == mixed.count()


def test_mixing_stage_takes_rows_not_ids(spark, docs):
    import corpus_pipeline as C

    rng = random.Random(11)
    rows = [(i if i % 5 else None, text(10 + i % 7, rng), f"s{i % 3}" if i % 4 else None) for i in range(60)]
    rows += [(700, text(5, rng), "s0"), (700, text(40, rng), "s1"), (700, None, "s2"), (700, "", None)] + [(701, text(9, rng), "s1")] * 3
    given = docs(rows)
    sizes = lambda rows_: {k: sum(len((t or "").split()) for _, t, s in rows_ if s == k) for k in {s for _, _, s in rows}}
    got = [(r["doc_id"], r["text"], r["source"]) for r in C.mixing(spark, given, "").collect()]
    plan = mixing.mixture(given).collect()
    want, had = {}, {}
    for r in plan:
        key = (r["doc_id"], r["source"], r["size"])
        want[key] = want.get(key, 0) + r["copies"]
    for i, t, s in got:
        key = (i, s, len((t or "").split()))
        had[key] = had.get(key, 0) + 1
    assert had == {k: n for k, n in want.items() if n}
    assert sum(i is None for i, _, _ in got) > 0 and all(got.count(r) <= 2 * rows.count(r) for r in got)
    words = sizes(got)
    assert all(abs(words[r["source"]] - r["target"]) <= 80 for r in plan)
    assert sum(words.values()) <= 1.5 * sum(sizes(rows).values())


def test_near_dup_stage_decides_by_row(spark, docs):
    import corpus_pipeline as C

    rng = random.Random(12)
    a, b, c, d, e = (text(60, rng) for _ in range(5))
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (4, d), (4, d + " again"), (5, a), (6, e), (6, c), (None, a), (None, a), (7, ""), (7, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in C.near_dup(spark, docs(rows), "").collect()), key=str)
    at_4 = [t for i, t in got if i == 4]
    assert len(at_4) == 1 and at_4[0] in (d, d + " again")
    assert [x for x in got if x[0] != 4] == sorted([(1, a), (2, b), (3, c), (6, e), (None, a), (None, a), (7, ""), (7, "")], key=str)
    assert C.near_dup(spark, docs([]), "").count() == 0


def lines_kept(rows):
    """Brute force of line dedup: rows (doc_id, text) of distinct doc_ids."""
    order = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0))
    known, out = set(), {}
    for doc_id, x in order:
        split, gone = x.split("\n"), set()
        for p in range(len(split) - 2):
            window = tuple(split[p : p + 3])
            if re.search(r"[^\x20\x09-\x0D]", "".join(window)):
                gone |= set(range(p, p + 3)) if window in known else set()
                known.add(window)
        spans = sum(p - 1 not in gone for p in gone)
        out[doc_id] = (len(split), len(gone), spans, "\n".join(w for p, w in enumerate(split) if p not in gone))
    return out


def test_line_dedup(docs, monkeypatch):
    from traceloom.llm import line_dedup

    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " ", "c d"]) for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "\n".join(str(k) for k in range(30_000))), (204, "x\n" * 20_000), (None, "x\nx\nx"), (205, "a\r\nb\r\nc\r\n"), (206, "a\r\nb\r\nc")]
    monkeypatch.setattr(line_dedup, "LEAST", 7)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_spans"], r["kept_text"]) for r in line_dedup.line_deduplicated(docs(rows)).collect()}
    assert got.pop(200) == (0, 0, 0, None)
    assert got == lines_kept(rows)
    same = line_dedup.line_deduplicated(docs([(5, "a\nb\nc"), (5, "a\nb\nc"), (6, "z\na\nb\nc")])).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in same) == [(5, 0, "a\nb\nc"), (5, 0, "a\nb\nc"), (6, 3, "z")]
    assert line_dedup.line_deduplicated(docs([])).count() == 0


def test_fingerprint_rings_of_wide_ids(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f " * 40).alias("text"))
    rows = rows.unionByName(spark.createDataFrame([(-(2**63), "low"), (2**63 - 1, "high"), (None, None)], "doc_id long, text string"))
    sizes = [r["count"] for r in fingerprint.in_rings(rows).where("NOT ghost").groupBy("bucket").count().collect()]
    assert sum(sizes) == 3003 and max(sizes) < 1000
    out = {r.doc_id: r for r in fingerprint.edited_fingerprints(rows).collect()}
    assert len(out) == 3003
    assert out[2**63 - 1].edited_sha256 == hashlib.sha256(b"higa").hexdigest()
    assert fingerprint.edited_fingerprints(rows.limit(0)).collect() == []


def _brute_hits(items, text, window=10):
    words, hit, names = decontaminate.words_of(text), set(), set()
    for name, item in items:
        item = decontaminate.words_of(item)
        n = min(window, len(item))
        for k in range(len(item) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == item[k : k + n]:
                    hit |= set(range(p, p + n))
                    names.add(name)
    return hit, names


def test_decontaminate_repeated_words_against_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        letters = "abc"[: rng.randint(1, 3)]
        items = [(str(k), " ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(rng.randint(0, 6))]
        texts = [" ".join(rng.choice(letters + "z") for _ in range(rng.choice([0, 1, 5, 12, 60]))) for _ in range(4)] + [None]
        search = decontaminate.Searcher([(a, decontaminate.words_of(b)) for a, b in items])
        _, found = decontaminate._found(search, texts)
        for i, text in enumerate(texts):
            runs, heads = found.get(i, ([], []))
            assert ({x for p, n in runs for x in range(p, p + n)}, {search.names[int(search.item[s])] for _, s, _ in heads}) == _brute_hits(items, text)


def test_decontaminate_is_linear_in_a_repeated_word():
    search = decontaminate.Searcher([("a", [b"x"] * 1600)])
    began = time.time()
    assert decontaminate._found(search, ["x " * 3200])[1] == {0: ([(0, 3200)], [(0, 0, 1600)])}
    assert time.time() - began < 5


def test_decontaminate_many_blocks(spark):
    items = [(f"i{k}", f"only{k} words{k} here{k}") for k in range(5)] + [(None, "null item name"), ("empty", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, "x only1 words1 here1 only3 words3 here3"), (1, "clean"), (None, "null item name"), (4, None)], "doc_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.decontaminated(docs, bench, block_bytes=b).collect()), key=str) for b in (1 << 20, 1))
    assert one == many
    assert {r[0:4] for r in one} == {(1, 7, 6, 2), (1, 1, 0, 0), (None, 3, 3, 1), (4, 0, 0, 0)}
    assert sorted(r.text or "" for r in decontaminate.remove_contaminated(docs, bench, block_bytes=1).collect()) == ["", "clean"]


@pytest.mark.parametrize("name", ["op8_decontaminate", "op9_suffix_dedup", "op10_near_dup"])
def test_query_agrees_with_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_components_of_new_links_go_on_from_known_labels(spark):
    from traceloom.llm import near_dup

    rng = np.random.default_rng(3)
    edges = [(i + 1, i) for i in range(40)] + [(7, 7)] + (rng.integers(100, 160, (70, 2))).tolist()
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    frame = lambda some: spark.createDataFrame([tuple(map(int, e)) for e in some], "a long, b long")
    first = near_dup.components(frame(edges[::2]))
    got = near_dup.components(frame(edges[1::2]), first)
    assert {r["c"]: r["label"] for r in got.collect()} == {v: root(v) for v in parent}
    assert near_dup.components(frame([]), first).count() == first.count()
