from datetime import date, timedelta

import numpy as np
import pytest
from floodstats.functions import calendar as T
from floodstats.functions import scalar as X
from floodstats.operators import custom
from floodstats.sources import rasters
from pyspark.sql import functions as F


def one(spark, c):
    return spark.range(1).select(c.cast("string") if not isinstance(c, tuple) else F.struct(*c)).first()[0]


def test_times(spark):
    assert one(spark, T.cf_time(F.lit(36.0), "hours since 1980-01-01")) == "1980-01-02 12:00:00"
    assert one(spark, T.cf_time(F.lit(59.25), "days since 1980-01-01", "noleap")) == "1980-03-01 06:00:00"
    assert one(spark, T.cf_time(F.lit(365.0 * 5), "days since 1979-01-01", "noleap")) == "1984-01-01 00:00:00"
    with pytest.raises(ValueError):
        T.cf_time(F.lit(1.0), "days since 1980-01-01", "lunar")
    for y in (2000, 2001):
        for d in (1, 59, 60, 61, 365):
            assert one(spark, T.month_of_day(F.lit(d), F.lit(y))) == str((date(y, 1, 1) + timedelta(days=d - 1)).month)


def test_utm(spark):
    # On the central meridian the easting is the false one, and the northing is the scaled length of the meridian.
    x, y = one(spark, X.utm(F.lit(9.0), F.lit(45.0), F.lit(32)))
    assert x == pytest.approx(500_000) and y == pytest.approx(0.9996 * 4984944.378, abs=0.01)
    x, y = one(spark, X.utm(F.lit(9.0), F.lit(-45.0), F.lit(32)))
    assert y == pytest.approx(10_000_000 - 0.9996 * 4984944.378, abs=0.01)
    x, y = one(spark, X.utm(F.lit(12.0), F.lit(0.0), F.lit(32)))
    assert y == pytest.approx(0, abs=1e-6) and x == pytest.approx(833978.557, abs=0.01)


def test_custom(spark):
    df = spark.createDataFrame([("a", i, float(v), float(v * v)) for i, v in enumerate([3, 1, 2])] + [("b", 0, None, 1.0)], "k string, t int, x double, y double").repartition(3)
    got = {r.k: (r.s, r.last) for r in custom.reduce_series(df, ["k"], lambda x, y: [np.nansum(x * y), x[-1]], ["x", "y"], ["s", "last"]).collect()}
    assert got["a"] == (36, 2) and got["b"][0] == 0
    got = {(r.k, r.t): r.c for r in custom.transform_series(df.where("k = 'a'"), ["k"], np.cumsum, out="c").collect()}
    assert got == {("a", 0): 3, ("a", 1): 4, ("a", 2): 6}


def test_control_to_geotiff(tmp_path):
    v = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "g.bin").write_bytes(v.tobytes())
    (tmp_path / "g.ctl").write_text("DSET ^g.bin\nUNDEF -9999\nOPTIONS yrev\nXDEF 4 LINEAR 0.5 1\nYDEF 3 LINEAR 10.5 1\nZDEF 1 LEVELS 0\nTDEF 1 LINEAR 00Z01jan2000 1dy\nVARS 1\nq 0 99 flow\nENDVARS\n")
    rasters.control_to_geotiff(f"{tmp_path}/g.ctl", f"{tmp_path}/g.tif")
    got, place, missing = rasters.decode_geotiff((tmp_path / "g.tif").read_bytes())
    assert (got[0] == v).all() and place == (0, 13, 1, -1) and missing == -9999
