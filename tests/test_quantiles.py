"""Values at ranks against sorted lists, also where brackets have to be narrowed."""

import math
import random

import pytest
from pyspark.sql import functions as F

from temblor.operators import quantiles
from temblor.operators.ordering import page
from temblor.operators.stats import column_stats, medians


def frame_of(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, k int").repartition(4)


def shapes():
    rng = random.Random(11)
    return {
        "spread": [rng.gauss(0, 100) for _ in range(4000)],
        "two heavy values around the middle": [0.0] * 1990 + [1.0] * 1990 + [rng.random() for _ in range(21)],
        "one heavy value": [rng.random() for _ in range(900)] + [0.5] * 3000 + [rng.random() + 1 for _ in range(300)],
        "within a thousandth": [5 + rng.random() / 1000 for _ in range(3000)],
        "huge": [rng.choice([-1, 1]) * 10.0 ** rng.randint(200, 300) * rng.random() for _ in range(2000)],
        "odd ones": [math.nan] * 600 + [None] * 50 + [math.inf, -math.inf] * 300 + [float(i) for i in range(500)],
        "equal": [3.0] * 100, "one": [7.0], "two": [1.0, 2.0],
    }


@pytest.mark.parametrize("few", [10, 50_000])
@pytest.mark.parametrize("name", sorted(shapes()))
def test_values_at_ranks(spark, monkeypatch, name, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    values = shapes()[name]
    plain = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    ranks = sorted({0, len(plain) - 1, len(plain) // 2, (len(plain) - 1) // 2, len(plain) // 7})
    found = quantiles.values_at_ranks(frame_of(spark, values), {"v": ranks})["v"]
    assert list(map(str, found)) == [str(plain[r]) for r in ranks]


def test_a_million_values_inside_one_thousandth(spark):
    frame = spark.range(1_000_001).select((F.lit(2.0) + F.col("id") / 2_000_000_000.0).alias("v"))
    assert medians(frame, "v").first()["median"] == 2.0 + 500_000 / 2_000_000_000.0


def test_columns_without_values(spark):
    frame = spark.createDataFrame([(None, 1), (None, 2)], "v double, k int")
    assert [tuple(r) for r in medians(frame, "v").collect()] == [("v", None)]
    assert column_stats(frame, "v").collect() == []
    assert quantiles.values_at_ranks(frame, {"v": []}) == {"v": []}


def test_pages_by_magnitude_follow_the_sorted_table(make, monkeypatch):
    from temblor.operators import ordering

    monkeypatch.setattr(ordering, "SHORT_LIST", 2)
    monkeypatch.setattr(quantiles, "FEW", 3)
    rng = random.Random(2)
    events = make(mag=[rng.choice([None, math.nan, 1.0, 1.0, rng.random()]) for _ in range(60)])
    ordered = [r["unid"] for r in events.orderBy(F.desc("mag"), F.desc("time"), F.asc("unid")).collect()]
    for offset, limit in ((0, 5), (7, 20), (40, 20), (55, 30)):
        assert [r["unid"] for r in page(events, "magnitude", limit, offset).collect()] == ordered[offset : offset + limit]
