import math

import pytest
from pyspark.sql import functions as F

from temblor.functions import calendar, geo, magnitude, risk
from helpers import tuples


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x DOUBLE")


def test_mag_key_limits(spark):
    values = [-0.3, math.nan, math.inf, 4.6, None, -math.inf, 2.1, 0.0]
    keys = tuples(doubles(spark, values).select(magnitude.mag_key(F.col("x"))))
    assert [k for (k,) in keys] == [0, 0, 4294967295, 46, None, 0, 21, 0]


@pytest.mark.parametrize("m", [2.0, 4.0, 6.0, 8.0])
def test_energy(spark, m):
    energy = one(spark, magnitude.magnitude_to_energy(F.lit(m)))
    assert math.log10(energy) == pytest.approx(11.8 + 1.5 * m)


def test_round_half_away(spark):
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.2, math.nan, 1e300, None]
    result = [r for (r,) in tuples(doubles(spark, values).select(geo.round_half_away(F.col("x"))))]
    assert result == [1, -1, 2, 3, -3, 0, 0, 0, 2**31 - 1, None]


def test_distance(spark):
    quarter = one(spark, geo.haversine_km(F.lit(90.0), F.lit(0.0), 0.0, 0.0))
    assert quarter == pytest.approx(geo.EARTH_RADIUS_KM * math.pi / 2)


@pytest.mark.parametrize("lat0,lon0,radius", [(10, 20, 2000), (85, 0, 900), (0, 179, 500), (-60, -30, 5)])
def test_circle_box_never_cuts_the_circle(spark, lat0, lon0, radius):
    box = geo.circle_box(lat0, lon0, radius)
    points = spark.range(181).withColumnRenamed("id", "i").join(
        spark.range(361).withColumnRenamed("id", "j")
    ).select((F.col("i") - 90.0).alias("lat"), (F.col("j") - 180.0).alias("lon"))
    inside = points.filter(geo.haversine_km(F.col("lat"), F.col("lon"), lat0, lon0) <= radius)
    kept = inside
    for column, (low, high) in box.items():
        kept = kept.filter(F.col(column).between(low, high))
    assert kept.count() == inside.count()


@pytest.mark.parametrize("text,micros", [
    ("2023-03-14T06:15:42.25Z", 1678774542250000),
    ("2023-03-14T07:01:05.500251Z", 1678777265500251),
    ("2023-03-14T06:15:42Z", 1678774542000000),
    ("2023-03-14T08:15:42+02:00", 1678774542000000),
    ("not a time", None),
])
def test_timestamps(spark, text, micros):
    assert one(spark, F.unix_micros(calendar.parse_timestamp(F.lit(text)))) == micros


def test_readings(spark):
    bs = [r for (r,) in tuples(doubles(spark, [0.5, 0.8, 1.2, 1.3]).select(
        risk.b_value_interpretation(F.col("x"))))]
    assert bs == [risk.HIGH_STRESS, risk.NORMAL_STRESS, risk.NORMAL_STRESS, risk.LOW_STRESS]
    levels = [r for (r,) in tuples(doubles(spark, [0.2, 0.1, 0.06, 0.05]).select(
        risk.risk_level(F.col("x"))))]
    assert levels == ["High", "Moderate", "Moderate", "Low"]


def test_energy_units(spark):
    assert one(spark, risk.energy_tnt_tons(F.lit(4.184e9))) == 1.0
    assert one(spark, risk.energy_tnt_scaled(F.lit(4.184e21))) == 1.0


def test_names(spark):
    weekdays = [one(spark, calendar.weekday_name(F.lit(i))) for i in range(7)]
    assert weekdays == list(calendar.WEEKDAYS)
    months = [one(spark, calendar.month_name(F.lit(i))) for i in range(1, 13)]
    assert months == list(calendar.MONTHS)
