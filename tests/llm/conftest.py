import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from temblor.llm.registry import ship  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def package(spark):
    ship(spark)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (id, text) pairs; other columns can be given."""

    def build(*rows, lang="en", source="s"):
        full = [(i, t, lang, source, len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return build
