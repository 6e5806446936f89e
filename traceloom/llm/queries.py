"""The queries opN_<name> over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignments
from .byte_bpe import round_trip
from .classify import fold
from .common import table
from .decontaminate import decontaminated
from .filter_audit import filter_audit
from .fingerprint import edited_fingerprints
from .langid import languages
from .line_dedup import line_deduplicated
from .mixing import mixture
from .near_dup import near_duplicates
from .quality import quality_scores
from .suffix_dedup import deduplicated
from .token_output import token_output
from .toxicity import toxicity_scores

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
END_ID = 2
#: Scores from here on count as label 1.
CUT = 0.3


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def held_out(n: int, which: int):
    """Whether a row's fold is not for learning; false for a null doc_id."""
    return F.coalesce(fold(F.col("doc_id"), n) == which, F.lit(False))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_output(documents(spark, sf_dir), tokenizer_path(), END_ID, with_ids=False)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = table(spark, sf_dir, "labels").where(~held_out(5, 0)).select("doc_id", "quality")
    out = quality_scores(documents(spark, sf_dir), training)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = languages(docs, docs.where(~held_out(4, 2)))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), F.col("best_lang").alias("lang_pred"), "score", "accepted")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    training = table(spark, sf_dir, "labels").where(~held_out(4, 2)).select("doc_id", "toxic")
    out = toxicity_scores(documents(spark, sf_dir), training)
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_deduplicated(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=2, percent=80)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir), with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), tokenizer_path(RANKS))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(documents(spark, sf_dir), *map(tokenizer_path, ALIGNED), with_groups=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": op1_token_output,
    "op2_quality": op2_quality,
    "op3_fingerprint": op3_fingerprint,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_language": op6_language,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_near_dup": op10_near_dup,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_alignment": op13_alignment,
}
#: By brute force: the whole line of copies in one window.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    sha256('mix-1|' || doc_id) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM d GROUP BY source
), w AS (
  SELECT *, (CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, source_size::DOUBLE * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(cap, coalesce((max(CASE WHEN level <= cap / weight THEN level END) OVER ()) * weight, cap)) AS target FROM l
), p AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS until
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (until + e * source_size)::DOUBLE / target AS finish FROM p, (SELECT unnest([0, 1]) AS e) WHERE size > 0
), q AS (
  SELECT doc_id, source, size, (sum(size) OVER (ORDER BY finish, k, e, source ROWS UNBOUNDED PRECEDING))::DOUBLE
    <= (SELECT sum(size)::DOUBLE * 1.5::DOUBLE FROM d) AS took FROM c
), g AS (SELECT doc_id, source, size, count(*) FILTER (took) AS n FROM q GROUP BY doc_id, source, size)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(g.n, 0))::BIGINT AS taken
FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.source IS NOT DISTINCT FROM g.source AND p.size = g.size
"""

#: Windows compared as text. Rows of one doc_id are taken to be one row here.
OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents
), w AS (
  SELECT doc_id, p, line, lead(line) OVER o AS line2, lead(line, 2) OVER o AS line3 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)
), r AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, p) > 1 AS again FROM w
  WHERE line3 IS NOT NULL AND regexp_matches(line || line2 || line3, '[^\x20\x09-\x0D]')
), c AS (
  SELECT DISTINCT doc_id, p + k AS p FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE again
), m AS (
  SELECT l.doc_id, l.p, l.line, c.p IS NOT NULL AS gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.p = c.p
), s AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), FALSE) AS begins FROM m
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every run of as many words as an item's window, compared as lists.
OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, ws, least(len(ws), 10) AS n
  FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, n, list_slice(ws, p, p + n - 1) AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM b)
), dw AS (
  SELECT doc_id, n, p, list_slice(ws, p, p + n - 1) AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM b) WHERE len(ws) >= n)
), h AS (
  SELECT doc_id, n, p, win FROM dw WHERE win IN (SELECT win FROM bw)
), c AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM h) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(coalesce(item_id, ''), ',' ORDER BY coalesce(item_id, '')) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h JOIN bw USING (win)) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""

#: Every 50-byte string as a blob; what is kept is put together in hexadecimal, two digits a byte.
OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, encode(coalesce(text, '')) AS e, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), s AS (
  SELECT doc_id, p, e[p + 1:p + 50] AS k FROM (SELECT doc_id, e, unnest(range(0, n - 49)) AS p FROM t WHERE n >= 50)
), f AS (SELECT k, min(doc_id) AS first_id FROM s GROUP BY k HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, p FROM s JOIN f USING (k) WHERE first_id < doc_id),
e AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS begins FROM r
), g AS (SELECT doc_id, p, sum(begins) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM e),
m AS (SELECT doc_id, min(p) AS low, max(p) + 50 AS high FROM g GROUP BY doc_id, run),
k AS (
  SELECT m.doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY m.doc_id ORDER BY low), 0) AS previous, h, n FROM m JOIN t ON m.doc_id = t.doc_id
), o AS (
  SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, 2 * previous + 1, 2 * (low - previous)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS kept
  FROM k GROUP BY doc_id
)
SELECT t.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN o ON t.doc_id = o.doc_id
"""

#: All pairs of sets that share a shingle; links are followed until nothing more is reached.
OP10_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) < 2 THEN ws ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS sh FROM d
), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT a AS doc_id, b AS other FROM p UNION SELECT reach.doc_id, p.b FROM reach JOIN p ON reach.other = p.a
), least_id AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(other, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(other, s.doc_id)) AS kept
FROM s LEFT JOIN least_id ON s.doc_id = least_id.doc_id
"""

#: Cells of failures, then every order of the letters with the bits that come before each.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
  SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), FALSE)::INT AS mask FROM d
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, mask
), e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT e1.x || e2.x || e3.x || e4.x || e5.x AS filter_order, [e1.b, e2.b, e3.b, e4.b, e5.b] AS bits
  FROM e e1, e e2, e e3, e e4, e e5 WHERE e1.b + e2.b + e3.b + e4.b + e5.b = 31 AND e1.b | e2.b | e3.b | e4.b | e5.b = 31
), s AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (prior | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & prior = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & prior > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & prior = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & prior = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

SQL: dict[str, str] = {"op12_filter_audit": OP12_SQL, "op4_line_dedup": OP4_SQL, "op5_mixing": OP5_SQL, "op8_decontaminate": OP8_SQL, "op9_suffix_dedup": OP9_SQL, "op10_near_dup": OP10_SQL}
