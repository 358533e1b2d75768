import pytest
from pyspark.sql import functions as F

from airlattice.constants import AQI_BREAKPOINTS
from airlattice.functions.aqi import aqi, sub_index


def _band_cases(pollutant):
    """From the band table: each ceiling has its band's highest index, half of it the index interpolated from zero
    in the band it falls into, a value just above it belongs to the next band, and above the last there is none."""
    bands = AQI_BREAKPOINTS[pollutant]

    def index(c):
        for ceiling, high, low in bands:
            if c <= ceiling:
                return int((high - low) / ceiling * c + low)
        return 0
    values = [v for ceiling, _, _ in bands for v in (ceiling, ceiling / 2, ceiling + 0.01)]
    return [(v, index(v)) for v in values]


@pytest.mark.parametrize("pollutant", sorted(AQI_BREAKPOINTS))
def test_every_band_and_its_edges(spark, pollutant):
    cases = _band_cases(pollutant)
    df = spark.createDataFrame([(float(v), want) for v, want in cases], "c double, want int")
    got = df.select("c", "want", sub_index(pollutant, "c").alias("i")).collect()
    assert [(r.c, r.i) for r in got] == [(r.c, r.want) for r in got]
    top = AQI_BREAKPOINTS[pollutant][-1][0]
    assert spark.createDataFrame([(2.0 * top,)], "c double").select(sub_index(pollutant, "c").alias("i")).first().i == 0


def test_sub_index_null_and_nan_are_zero(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "c double")
    assert [r.i for r in df.select(sub_index("pm10", "c").alias("i")).collect()] == [0, 0]


def test_unknown_pollutant_raises():
    with pytest.raises(KeyError):
        sub_index("nh3", F.lit(1.0))


def test_aqi_is_the_largest_sub_index(spark):
    df = spark.createDataFrame([(0.0, 40.0, 0.0, 0.0, 0.0, 0.0)], "co double, no2 double, o3 double, "
                               "pm2_5 double, pm10 double, so2 double")
    df = df.withColumn("pm2_5", F.lit(20.0))  # 100
    assert df.select(aqi().alias("a")).first()["a"] == 100
