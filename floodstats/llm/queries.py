"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import deleted, langid, mixing, packing, quality, runs, secrets, simhash, spans, syncmers, toxicity, transport
from .common import table


#: Words that a repeated run must have in the query of op5, so that a few one-word sentences in a row leave clean documents alone.
FLOOR = 18


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted.lm_scores(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.drawn(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents"), words=FLOOR)


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_predictions(table(spark, sf_dir, "documents"))


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.stream_digests(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_best_fit_packing,
        op3_lm_scoring,
        op4_source_mixing,
        op5_substring_dedup,
        op6_document_fingerprints,
        op7_language_id,
        op8_transport_streams,
        op9_quality_classifier,
        op10_simhash_near_dedup,
        op11_periodic_runs,
        op12_toxicity,
    )
}


def _spans_sql(name: str, kind: int, pattern: str, group: int, where: str) -> str:
    """CTE of one kind's matches: starts from the lengths of what stands between them."""
    p = pattern.replace("'", "''")
    return f"""{name}0 AS (SELECT n, x, regexp_extract_all(x, '{p}', 0) AS m, regexp_extract_all(x, '{p}', {group}) AS v, string_split_regex(x, '{p}') AS b FROM t),
{name}1 AS (SELECT n, m, v, b, unnest(range(1, len(m) + 1)) AS i FROM {name}0),
{name}2 AS (SELECT n, {kind} AS k, m[i] AS w, v[i] AS v, list_sum(list_transform(b[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS a FROM {name}1),
{name} AS (SELECT n, k, v, CAST(a AS BIGINT) AS a, CAST(a + length(w) AS BIGINT) AS z FROM {name}2 WHERE {where})"""


_NAME = "['assign', 'access', 'hex', 'live'][k + 1] || ':' || a || ':' || z"
_OP1 = f"""WITH t AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS x, coalesce(source, '') AS o, coalesce(nullif(regexp_extract(coalesce(text, ''), '{secrets.ADDRESS}'), ''), '#' || coalesce(CAST(doc_id AS VARCHAR), '')) AS r FROM documents),
{_spans_sql("sa", 0, secrets.ASSIGN, 2, "length(v) >= 8")},
{_spans_sql("sk", 1, secrets.ACCESS, 0, "true")},
{_spans_sql("sh", 2, secrets.HEX, 0, "true")},
{_spans_sql("sc", 3, secrets.CANDIDATE, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")},
base AS (SELECT * FROM sa UNION ALL SELECT * FROM sk UNION ALL SELECT * FROM sh),
every AS (SELECT * FROM base UNION ALL SELECT * FROM sc WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.n = sc.n AND base.a < sc.z AND sc.a < base.z)),
cnt AS (SELECT v, count(DISTINCT o) AS owners, count(DISTINCT (o, r)) AS repositories FROM every JOIN t USING (n) GROUP BY 1),
own AS (SELECT *, owners <= {secrets.MAX_OWNERS} AND repositories <= {secrets.MAX_REPOSITORIES} AS live FROM cnt),
told AS (SELECT every.*, live, owners, repositories FROM every JOIN own USING (v)),
per AS (SELECT n, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({_NAME}, ',' ORDER BY a, k) FILTER (k < 3) AS base,
string_agg({_NAME}, ',' ORDER BY a, k) FILTER (k < 3 OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, string_agg(a || ':' || owners || ':' || repositories, ',' ORDER BY a, k) AS ownership FROM told GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(ownership, '') AS ownership
FROM t LEFT JOIN per USING (n)"""

#: A run's words agree with those its period on for six words at least (12 - 6 words of a run of 12 with period 6), so runs are islands of
#: equal sequences of six. The checksum is made from its polynomial.
_OP11 = """WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], [k FOR k IN range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w0, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS digits FROM documents),
c AS (SELECT r, doc_id, w0, len(w0) AS n, xor(list_reduce(list_concat([4294967295], list_filter(digits, lambda x: x > 0)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d CROSS JOIN tab),
e AS (SELECT *, (h // 10) % nullif(n, 0) AS a, 1 + (n - (h // 10) % nullif(n, 0)) // (3 + (h // 10) % 8) AS p FROM c),
t AS (SELECT r, n, unnest(range(n)) AS i, unnest(CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w0[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w0 END) AS w FROM e),
g AS (SELECT r, n, i, w || ' ' || string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS gram FROM t),
m AS (SELECT x.r, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.r = y.r AND x.gram = y.gram AND y.i > x.i AND y.i - x.i <= x.n // 2 AND y.i <= y.n - 6),
s AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island, i FROM m),
runs AS (SELECT r, start, length, min(q) AS period FROM (SELECT r, q, min(i) AS start, count(*) + 5 + q AS length FROM s GROUP BY r, q, island) WHERE length >= greatest(12, 2 * q) GROUP BY 1, 2, 3),
per AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, period := period), [-length, start, period]) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY 1),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM t WHERE NOT EXISTS (SELECT 1 FROM runs WHERE runs.r = t.r AND t.i >= start + period AND t.i < start + length) GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM e LEFT JOIN per USING (r) LEFT JOIN kept USING (r)"""

#: The other operators hash, train, tokenise or iterate in ways that SQL lacks; the tests hold them against brute force.
ORACLES: dict[str, str] = {"op1_secret_scans": _OP1, "op11_periodic_runs": _OP11}
