"""The analyses that chain the operators, from tables to tables. Each returns DataFrames; sources.sinks writes them.

Facts are long: rivers (scen, ensemble, time, index, WSE, Q), tides and surges (time, index, ...). `index` is the station.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import dates
from ..operators import circular as C
from ..operators import climate as L
from ..operators import ensemble as N
from ..operators import extremes as E
from ..operators import network as W
from ..operators import relational as R
from ..operators import series as S
from ..operators import skill as K
from ..operators import spatial as G

SERIES = ["scen", "ensemble", "index"]
# Return periods of the extreme-value analysis.
PERIODS = (1.1, 1.5, 2, 5, 10, 20, 30, 50, 100)


def select_stations(rivers: DataFrame, coupling: DataFrame, names: dict[str, str], start: str, end: str, exclude: tuple[str, str] | None = None) -> DataFrame:
    """Rivers at the coupled stations (coupling: index, rivmth_idx, z0, ...), scenarios renamed, within a period; values of an
    excluded period are null. rivers has the model's own rivmth_idx."""
    name = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    own = rivers.where(F.col("scen").isin(list(names)) & F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).withColumn("scen", F.element_at(name, F.col("scen")))
    out = own.join(coupling, "rivmth_idx").drop("rivmth_idx")
    for c in ("WSE", "Q") if exclude else ():
        out = S.exclude_period(out, *exclude, t="time", x=c)
    return out


def surge_levels(tide: DataFrame, surge: DataFrame, keys: list[str], t: str = "time") -> tuple[DataFrame, DataFrame]:
    """From sub-daily tide and surge: (keys, month, clim) of the surge, and daily values: Htide with its extremes, Hseas, Hsurge,
    Htot and the skew surge (daily greatest total less daily greatest tide)."""
    clim = L.monthly(surge.withColumnRenamed(t, "t").withColumnRenamed("surge", "x"), keys)
    both = R.align(tide, surge, [*keys, t]).withColumn("month", F.month(t).cast("long")).join(clim, [*keys, "month"])
    day = F.date_trunc("day", F.col(t)).alias(t)
    total, storm = F.col("tide") + F.col("surge"), F.col("surge") - F.col("clim")
    daily = both.groupBy(*keys, day).agg(
        F.max("tide").alias("Htide_day_max"),
        F.min("tide").alias("Htide_day_min"),
        F.avg("clim").alias("Hseas_day_mean"),
        F.max(storm).alias("Hsurge_day_max"),
        F.avg(storm).alias("Hsurge_day_mean"),
        F.max(total).alias("Htot_day_max"),
        F.avg(total).alias("Htot_day_mean"),
    )
    return clim, daily.withColumn("Hskewsurge_day", F.col("Htot_day_max") - F.col("Htide_day_max"))


def driver_table(rivers: DataFrame, surges: DataFrame, scen: str, min_dist: int = 30, half: int = 5) -> DataFrame:
    """(ensemble, index, year, day, h, Hskewsurge_day, Q): what drove each year's greatest water level h = WSE - z0."""
    own = rivers.where(F.col("scen") == scen).withColumn("h", F.col("WSE") - F.col("z0"))
    both = own.join(surges.select("index", "time", "Hskewsurge_day"), ["index", "time"], "left")
    return S.drivers(both, ["ensemble", "index"], "h", ["Hskewsurge_day", "Q"], "time", min_dist, half)


def extreme_values(rivers: DataFrame, scens: list[str], x: str = "WSE", min_dist: int = 14, periods: tuple[float, ...] = PERIODS, alphas: tuple[float, ...] = (0.05, 0.95), samples: int = 1000, seed: int = 42) -> dict[str, DataFrame]:
    """annual_maxima, params, extreme_values and extreme_values_ci of every scenario, member and station."""
    am = S.annual_max(rivers.where(F.col("scen").isin(scens)), SERIES, "time", x, min_dist)
    ci = E.level_intervals(am, SERIES, list(periods), "am", alphas=alphas, samples=samples, seed=seed)
    return {"annual_maxima": am, "params": E.fit(am, SERIES, "am"), "extreme_values": E.return_levels(am, SERIES, list(periods), "am"), "extreme_values_ci": ci}


def extreme_map(cells: DataFrame, periods: tuple[float, ...] = PERIODS, min_dist: int = 14, n_min: int = 30) -> DataFrame:
    """(lat, lon, T, level) of daily cells (time, lat, lon, sfcelv); only cells with finite values."""
    am = S.annual_max(cells.where(F.col("sfcelv").isNotNull() & ~F.isnan("sfcelv")), ["lat", "lon"], "time", "sfcelv", min_dist)
    return E.return_levels(am, ["lat", "lon"], list(periods), "am", n_min=n_min)


def validation(sim: DataFrame, obs: DataFrame, meta: DataFrame, min_years: int = 8, share: float = 0.9, shift_days: int = -1, lags: range = range(-10, 11), min_dist: int = 30) -> tuple[DataFrame, DataFrame]:
    """Scores of sim (ensemble, grdc_id, time, outflw) against obs (grdc_id, time, discharge) at the stations of meta
    (grdc_id, ...): daily ones, and those of annual maxima. Stations need min_years years with data."""
    o = S.drop_incomplete_years(obs, ["grdc_id"], share, "time", "discharge", "obs")
    enough = S.years_with_data(o, ["grdc_id"], "time", "obs").where(F.col("years") >= min_years)
    o = o.join(meta.select("grdc_id"), "grdc_id", "left_semi").join(enough, "grdc_id", "left_semi").select("grdc_id", F.to_date("time").alias("t"), "obs")
    s = sim.select("ensemble", "grdc_id", F.date_add(F.to_date("time"), shift_days).alias("t"), F.col("outflw").alias("sim"))
    keys = ["ensemble", "grdc_id"]
    pair = K.preprocess_pair(s.join(o, ["grdc_id", "t"]), keys, share)
    return K.metrics(pair, keys, list(lags)), K.annual_max_metrics(pair, keys, min_dist=min_dist)


def dominant_drivers(drivers: DataFrame, level: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Of driver_table(): (ensemble, index) with rank correlations of level with each driver and whether they are significant
    and positive; and the vote of the ensemble with its class: 1 surge, 2 discharge, 3 both (compound), 4 neither."""
    keys = ["ensemble", "index"]
    test = lambda c, n: K.spearman_test(drivers, keys, "h", c).select(*keys, F.col("r").alias(f"{n}_r"), F.col("p").alias(f"{n}_p"))
    m = R.merge([test("Hskewsurge_day", "H"), test("Q", "Q")], keys)
    m = m.withColumns({n: F.coalesce((F.col(f"{n}_p") < level) & (F.col(f"{n}_r") > 0), F.lit(False)) for n in ("H", "Q")})
    vote = N.majority(m, ["index"], "ensemble", ["H", "Q"]).select("index", F.col("H").alias("h"), F.col("Q").alias("q"))
    return m, N.driver_class(vote)


def surge_influence(levels: DataFrame, intervals: DataFrame, a: str, b: str, period: float, alphas: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """(index, dh, agree, significant): scenario a's return level less b's (member mean), whether members agree on its sign, and
    whether intervals of the two are apart in every member."""
    at = levels.where(F.col("T") == period)
    d = N.difference(at, ["ensemble", "index"], "scen", a, b, "level")
    side = lambda al, n: intervals.where((F.col("T") == period) & (F.col("alpha") == al)).select(*SERIES, F.col("level").alias(n))
    ci = R.align(side(alphas[0], "lo"), side(alphas[1], "hi"), SERIES)
    out = d.groupBy("index").agg(F.avg("diff").alias("dh"), (F.abs(F.sum(F.signum("diff"))) == F.count("*")).alias("agree"))
    return out.join(N.separated(ci, ["index"], "ensemble", "scen", a, b, "lo", "hi"), "index", "left")


def people_affected(compound: DataFrame, single: DataFrame, people: DataFrame, edges: DataFrame, mouths: DataFrame, least: float = 0.01) -> DataFrame:
    """(index, T, people_affected): people of the cells (id, people) where the compound level (id, T, level) is more than least
    above the single one, summed over all that drains to each river mouth (index, id)."""
    both = R.align(compound, single.withColumnRenamed("level", "_single"), ["id", "T"]).join(people, "id")
    hit = both.select("id", "T", G.exposed(F.col("people"), F.col("level"), F.col("_single"), least).alias("state"))
    basins = W.catchments(edges, mouths.select("id")).join(mouths.withColumnRenamed("id", "outlet"), "outlet").select("id", "index")
    return hit.join(basins, "id").groupBy("index", "T").agg(F.sum("state").alias("people_affected"))


def expected_impact(affected: DataFrame, keys: list[str], x: str = "people_affected") -> DataFrame:
    return L.expected_annual(affected, keys, "T", x)


def station_attributes(rivers: DataFrame, surges: DataFrame) -> DataFrame:
    """(index, Q_amax, Q_amax_cv, Q_mean, Hskewsurge_amax, Hskewsurge_amax_cv, Htiderange_amax, Htiderange_mean, wse_std)."""
    r = rivers.select("index", "ensemble", F.col("time").alias("t"), "Q", "WSE")
    mean = r.groupBy("index", "t").agg(F.avg("Q").alias("x"), F.avg("WSE").alias("w"))
    s = surges.select("index", F.col("time").alias("t"), F.col("Hskewsurge_day").alias("x"), (F.col("Htide_day_max") - F.col("Htide_day_min")).alias("range"))
    k = ["index"]
    one = mean.groupBy(*k).agg(F.avg("x").alias("Q_mean"), F.stddev_pop("w").alias("wse_std"))
    tide = R.align(L.annual_then_mean(s, k, ["max"], x="range").withColumnRenamed("range_amax", "Htiderange_amax"), s.groupBy(*k).agg(F.avg("range").alias("Htiderange_mean")), k)
    top = lambda d, n: R.align(L.annual_then_mean(d, k, ["max"]).withColumnRenamed("x_amax", f"{n}_amax"), S.annual_max_variation(d, k).withColumnRenamed("cv", f"{n}_amax_cv"), k)
    return R.merge([one, tide, top(mean, "Q"), top(s, "Hskewsurge")], k)


def flood_timing(rivers: DataFrame, x: str = "Q", min_dist: int = 30) -> DataFrame:
    return C.mean_flood_day(C.flood_days(rivers, SERIES, "time", x, min_dist), SERIES)


def seasonal_forcing(clim: DataFrame, keys: list[str], stations: DataFrame, year: int) -> DataFrame:
    """(keys, t, x): monthly means, put in mid-month, interpolated to half-hours of a year."""
    months = clim.select(*keys, F.explode(F.sequence(F.lit(year - 1), F.lit(year + 1))).alias("_y"), "month", "clim")
    anchors = months.select(*keys, F.make_timestamp("_y", F.col("month").cast("int"), F.lit(15), F.lit(0), F.lit(0), F.lit(0)).alias("t"), F.col("clim").alias("x"))
    grid = stations.select(*keys).distinct().withColumn("t", F.explode(dates(F.lit(f"{year}-01-01").cast("timestamp"), F.lit(f"{year}-12-31 23:30:00").cast("timestamp"), "30 minutes")))
    return L.interpolate_time(anchors, grid, keys)
