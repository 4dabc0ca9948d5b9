"""Columns that plain SQL can tell, over the whole small table."""

import duckdb
import pytest

from rillflow.llm import queries

SF = "/root/testdata/sf0.01"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op2_quality_rules": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
often AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM often, (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
same AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(same.n, 0) AS n_dup_lines,
  coalesce(covered.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(covered.n, 0) > 30 * len(w) AS base_failed FROM t LEFT JOIN same USING (doc_id) LEFT JOIN covered USING (doc_id)""",
    "op3_pii": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255)) AS n_ip,
  len(list_filter(list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))),
    lambda d: length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[i] AS INTEGER) ELSE CAST(d[i] AS INTEGER) * 2 - CASE WHEN d[i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
  len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15)) AS n_phone FROM t""",
    "op4_language": "SELECT doc_id, text IS NULL OR NOT regexp_matches(text, '\\pL') AS und FROM documents",
    "op7_sharding": "SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, 'rows' AS law, CAST(NULL AS INTEGER) AS grown_shard FROM documents",
    "op9_mixing": f"SELECT doc_id, len({WORDS}) AS size, CAST(sum(len({WORDS})) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM documents",
    "op10_secrets": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM t""",
}


@pytest.mark.parametrize("name", SQL)
def test_columns_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, SF)
    if "und" in names:
        got = got.selectExpr("doc_id", "lang_pred = 'und' as und")
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


def test_near_duplicates_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.execute(queries.ORACLES["op1_near_duplicates"])
    names = [d[0] for d in found.description]
    assert sorted(map(tuple, queries.QUERIES["op1_near_duplicates"](spark, SF).select(*names).collect())) == sorted(found.fetchall())
