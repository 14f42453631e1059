"""Queries over the jobs of the folder jobs/: each runs its job twice into a new folder of the shared one and gives the whole output."""

from __future__ import annotations

import uuid

from jobs import design_levels, report_catalogue

from ..functions.shared import shared_dir
from .data import rounded
from .registry import query
from .series import GUMBEL, am_cte

_DAYS = """cal AS (SELECT CAST(unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS DATE) AS t FROM orders),
raw AS (SELECT c_nationkey AS k, CAST(o_orderdate AS DATE) AS t, round(sum(o_totalprice), 2) AS x FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
every AS (SELECT ks.k, cal.t, coalesce(raw.x, 0e0) AS x FROM (SELECT DISTINCT k FROM raw) ks CROSS JOIN cal LEFT JOIN raw ON raw.k = ks.k AND raw.t = cal.t),
d AS (SELECT k, t, CASE WHEN count(x) OVER (PARTITION BY k, year(t)) >= 0.9e0 * (365 + CASE WHEN year(t) % 4 = 0 AND (year(t) % 100 <> 0 OR year(t) % 400 = 0) THEN 1 ELSE 0 END) THEN x END AS x FROM every)"""


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    f"""WITH {_DAYS}, {am_cte(14)}, {GUMBEL}
SELECT k AS station, 'maximum' AS kind, CAST(year AS DOUBLE) AS at, round(am, 3) AS value FROM am WHERE am IS NOT NULL
UNION ALL SELECT k, 'level', p.T, round(CASE WHEN n >= 3 AND sd > 0 THEN loc - scale * ln(-ln(1 - 1 / p.T)) ELSE b0 END, 3) FROM f CROSS JOIN (SELECT unnest([2e0, 5e0, 10e0, 20e0, 50e0, 100e0]) AS T) p"""
)
def job1_design_levels(spark, sf):
    out = _folder(spark, "job1")
    design_levels.run(spark, sf, out)
    return rounded(design_levels.run(spark, sf, out), 3, "value")


@query(
    f"""WITH w AS (SELECT coalesce(nullif(source, ''), 'unnamed') AS k, coalesce(nullif(lang, ''), 'unnamed') AS lang, doc_id, doc_id // 100 AS block, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n FROM documents),
tot AS (SELECT k, count(*) AS reports, count(*) FILTER (n = 0) AS empty, count(DISTINCT lang) AS languages, CAST(sum(n) AS BIGINT) AS words, max(n) AS longest, max(doc_id) AS newest, count(DISTINCT block) AS blocks FROM w GROUP BY 1),
am AS (SELECT k, block, CAST(max(n) AS DOUBLE) AS am FROM w WHERE block IS NOT NULL GROUP BY 1, 2), {GUMBEL}
SELECT tot.k AS source, reports, empty, languages, words, longest, newest, blocks, coalesce(newest // 100 < (SELECT max(doc_id) // 100 FROM w), true) AS lags, p.T AS period,
round(CASE WHEN n >= 3 AND sd > 0 THEN loc - scale * ln(-ln(1 - 1 / p.T)) ELSE b0 END, 4) AS expected FROM tot LEFT JOIN (f CROSS JOIN (SELECT unnest([2e0, 10e0, 100e0]) AS T) p) ON f.k = tot.k"""
)
def job2_report_catalogue(spark, sf):
    out, reports = _folder(spark, "job2"), f"{sf}/documents.parque[t]"  # a pattern, since the table may be a file or a folder
    report_catalogue.run(spark, reports, out)
    return rounded(report_catalogue.run(spark, reports, out), 4, "expected")
