"""Operators against brute force on generated data."""

import random
import statistics

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from temblor.operators import stats


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(
    st.one_of(
        st.floats(-5, 12, allow_nan=False),
        st.sampled_from([1.0, 1.0005, 1.001, 33.0]),
        st.floats(-1e12, 1e12, allow_nan=False),
    ), min_size=1, max_size=40,
))
def test_median_is_exact(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "mag DOUBLE")
    row = stats.magnitude_stats(frame).first()
    assert row["median_magnitude"] == statistics.median(values)
    assert row["mean_magnitude"] == pytest.approx(statistics.fmean(values), abs=1e-3, rel=1e-9)
    assert (row["min_magnitude"], row["max_magnitude"]) == (min(values), max(values))


def test_median_of_two_columns_with_a_hot_value(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1.5, 1.5, rng.uniform(0, 9)]), rng.choice([33.0, rng.uniform(0, 700)]))
            for _ in range(3000)]
    frame = spark.createDataFrame(rows, "mag DOUBLE, depth DOUBLE")
    found = {r["column"]: r for r in stats.column_stats(frame, "mag", "depth").collect()}
    for i, name in enumerate(("mag", "depth")):
        values = [r[i] for r in rows]
        assert found[name]["median"] == statistics.median(values)
        assert found[name]["std"] == pytest.approx(statistics.stdev(values), rel=1e-9)
