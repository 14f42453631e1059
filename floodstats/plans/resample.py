"""Queries over the streaming operators, run as batches: a stream that has ended gives the same rows."""

from __future__ import annotations

from ..streaming import resample as R
from .data import EVENTS, events, rounded
from .registry import query


@query(f"WITH {EVENTS} SELECT k, date_trunc('day', t) AS t, max(x) AS x_max, count(x) AS x_count FROM ev GROUP BY 1, 2", times=("t",))
def stream_resample(spark, sf):
    return R.resample(events(spark, sf), ["k"], how=("max", "count"))


@query(
    f"""WITH {EVENTS}, o AS (SELECT k, t, x, CASE WHEN t < lag(t) OVER (PARTITION BY k ORDER BY t) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM ev WHERE x > 150),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY t) AS g FROM o) SELECT k, min(t) AS start, max(t) + INTERVAL 1 HOUR AS until, max(x) AS peak, count(*) AS n FROM s GROUP BY k, g""",
    times=("start", "until"),
)
def stream_exceedances(spark, sf):
    return rounded(R.exceedances(events(spark, sf), ["k"], 150.0, "1 hour").withColumnRenamed("end", "until"), 6, "peak")
