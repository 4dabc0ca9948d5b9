"""The queries of this subpackage and their SQL: ``QUERIES`` and ``ORACLES``, read by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, audit, bpe, dedup, langid, mixing, pii, quality, repair, secrets, sharding, toxicity, twotier
from .common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.scan(table(spark, sf_dir, "documents")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op11_bpe_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twotier.encoded_digests(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_language": op4_language,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_sharding": op7_sharding,
    "op8_neighbours": op8_neighbours,
    "op9_mixing": op9_mixing,
    "op10_secrets": op10_secrets,
    "op11_bpe_two_tier": op11_bpe_two_tier,
    "op12_filter_audit": op12_filter_audit,
    "op13_conversation_repair": op13_conversation_repair,
}
# exact: all pairs that share a shingle, and all that is reachable over links
ORACLES: dict[str, str] = {
    "op1_near_duplicates": r"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets WHERE doc_id IS NOT NULL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM sides UNION SELECT r.doc_id, s.b FROM reach r JOIN sides s ON r.other = s.a),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(sets.doc_id, coalesce(other, sets.doc_id)) AS component_id, least(sets.doc_id, coalesce(other, sets.doc_id)) = sets.doc_id AS kept FROM sets LEFT JOIN least ON least.doc_id = sets.doc_id""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
m AS (SELECT doc_id, part, CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INTEGER)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > least, false) AS INTEGER) AS mask FROM w),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM f p, f q, f r, f s, f t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND list_unique([p.f, q.f, r.f, s.f, t.f]) = 5),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[:step - 1]), 0) AS INTEGER) AS earlier FROM o, range(1, 6) r(step)),
a AS (SELECT part, filter_order, step, own, sum(n) FILTER (mask & (own | earlier) = 0) AS kept, sum(n) FILTER (mask & own > 0 AND mask & earlier = 0) AS removed, sum(n) FILTER (mask & own > 0 AND mask & earlier > 0) AS redundant,
  sum(n) FILTER (mask = own) AS unique_fails, sum(good) FILTER (mask & own > 0 AND mask & earlier = 0) AS good_lost, sum(toxic) FILTER (mask & own > 0 AND mask & earlier = 0) AS toxic_lost FROM c, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM a""",
    # a CRC-32 byte by byte, then all edits of a row in each state of the grammar
    "op13_conversation_repair": r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '-') AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
drawn AS (SELECT keyed.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 20 AS what FROM keyed, crc),
damaged AS (SELECT c, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN what = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE what <> 0),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(role || chr(0) || text), copy) AS nth FROM damaged),
told AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY nth) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open,
  lag(initial) OVER (PARTITION BY c ORDER BY nth) || initial AS pair FROM placed),
lines AS MATERIALIZED (SELECT *, CASE WHEN blank OR again THEN 'x' WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS code, CASE WHEN open THEN 5 ELSE 0 END AS more FROM told),
faults AS (SELECT c, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM lines GROUP BY c),
ins(state, now, cost, letters, put) AS (VALUES ('', '', 0, '', CAST([] AS VARCHAR[])), ('', 'u', 5, 'I', ['user:']), ('', 'a', 10, 'II', ['user:', 'assistant:']), ('s', 's', 0, '', []), ('s', 'u', 5, 'I', ['user:']), ('s', 'a', 10, 'II', ['user:', 'assistant:']),
  ('u', 'u', 0, '', []), ('u', 'a', 5, 'I', ['assistant:']), ('u', 'u', 10, 'II', ['assistant:', 'user:']), ('a', 'a', 0, '', []), ('a', 'u', 5, 'I', ['user:']), ('a', 'a', 10, 'II', ['user:', 'assistant:'])),
fits(state, code) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
moves AS MATERIALIZED (SELECT code, i.state, now AS target, cost + 2 AS cost, letters || 'D' AS letters, put, CAST(NULL AS VARCHAR) AS role, false AS stays FROM ins i, (SELECT unnest(['s', 'u', 'a', 'o', 'x']) AS code)
  UNION ALL SELECT f.code, i.state, f.code, cost, letters || 'K', put, NULL, true FROM ins i JOIN fits f ON f.state = i.now
  UNION ALL SELECT k.code, i.state, f.code, cost + 1, letters || 'R', put, CASE f.code WHEN 'u' THEN 'user' ELSE 'assistant' END, true FROM ins i JOIN fits f ON f.state = i.now AND f.code <> 's', (SELECT unnest(['s', 'u', 'a', 'o']) AS code) k),
run AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS nth, '' AS state, {'cost': CAST(0 AS BIGINT), 'letters': '', 'put': CAST([] AS VARCHAR[])} AS best FROM lines
  UNION ALL SELECT r.c, l.nth, m.target, min({'cost': r.best.cost + m.cost + CASE WHEN m.stays THEN l.more ELSE 0 END, 'letters': r.best.letters || m.letters, 'put': r.best.put || m.put || CASE WHEN m.stays THEN [coalesce(m.role, l.role) || ':' || l.text] ELSE [] END})
  FROM run r JOIN lines l ON l.c = r.c AND l.nth = r.nth + 1 JOIN moves m ON m.code = l.code AND m.state = r.state GROUP BY r.c, l.nth, m.target),
ended AS (SELECT r.c, min({'cost': r.best.cost + i.cost, 'letters': r.best.letters || i.letters, 'put': r.best.put || i.put}) AS best FROM run r JOIN (SELECT c, max(nth) AS nth FROM lines GROUP BY c) n ON n.c = r.c AND n.nth = r.nth JOIN ins i ON i.state = r.state AND i.now IN ('', 'a') GROUP BY r.c)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.letters, '') AS audit, sha256(coalesce(array_to_string(best.put, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM keyed) o LEFT JOIN faults USING (c) LEFT JOIN ended USING (c)""",
}
