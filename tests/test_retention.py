from datetime import timedelta

import pytest

from helpers import hours, tuples, utc
from temblor.operators.retention import RetentionConfig, apply_retention, retention_old_count

AS_OF = utc(2023, 3, 15)


def ids(frame):
    return sorted(r["unid"] for r in frame.collect())


def test_newest_by_number(make, base_time):
    events = make(time=[base_time + timedelta(seconds=i) for i in range(5)])
    config = RetentionConfig(max_events=3, retention_days=0)
    assert ids(apply_retention(events, AS_OF, config)) == ["test_2", "test_3", "test_4"]


def test_by_age(make):
    events = make(time=[AS_OF - timedelta(days=2), AS_OF - hours(12), AS_OF - timedelta(days=1)])
    config = RetentionConfig(max_events=0, retention_days=1)
    assert ids(apply_retention(events, AS_OF, config)) == ["test_1", "test_2"]
    assert tuples(retention_old_count(events, config.cutoff(AS_OF))) == [(1,)]


def test_both_rules(make):
    events = make(time=[AS_OF - hours(h) for h in (1, 2, 3, 40)])
    config = RetentionConfig(max_events=2, retention_days=1)
    assert ids(apply_retention(events, AS_OF, config)) == ["test_0", "test_1"]


@pytest.mark.parametrize("config", [
    RetentionConfig(auto_cleanup=False, max_events=1), RetentionConfig(max_events=0, retention_days=0),
])
def test_rules_can_be_off(make, config):
    events = make(time=[AS_OF - timedelta(days=d) for d in (1, 900)])
    assert len(ids(apply_retention(events, AS_OF, config))) == 2


def test_defaults():
    config = RetentionConfig()
    assert (config.max_events, config.auto_cleanup, config.retention_days) == (100_000, True, 365)
