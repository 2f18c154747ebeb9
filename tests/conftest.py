import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from helpers import BASE  # noqa: E402
from temblor.schema import EVENT_COLUMNS, EVENT_SCHEMA  # noqa: E402
from temblor.session import build_session  # noqa: E402

@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Events from lists of overrides of the base event; ids are numbered by default."""

    def build(*overrides, **columns):
        if columns:
            length = len(next(iter(columns.values())))
            overrides = [{c: v[i] for c, v in columns.items()} for i in range(length)]
        data = [
            tuple((BASE | {"unid": f"test_{i}"} | o)[c] for c in EVENT_COLUMNS)
            for i, o in enumerate(overrides)
        ]
        return spark.createDataFrame(data, EVENT_SCHEMA)

    return build


@pytest.fixture
def base_time():
    return BASE["time"]
