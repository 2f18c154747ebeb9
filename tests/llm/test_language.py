"""Language ID: held-out accuracy, spans of mixed text, and the exact Viterbi path."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from temblor.llm import lang_id

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(DATA)
    return lang_id.learn(docs.filter(~lang_id.held_out()))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    result = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(result) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in result)
    unseen = [r for r in result if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in unseen) / len(unseen) > 0.98
    assert all(0 <= r["score"] <= 1 for r in result)


def test_spans_of_mixed_text(spark, model, documents):
    docs = spark.read.parquet(DATA).filter("n_chars between 600 and 3000 and text not like '%|%' and text not like '%&&&%'")
    en = docs.filter("lang = 'en'").orderBy("doc_id").first()["text"]
    de = docs.filter("lang = 'de'").orderBy("doc_id").first()["text"]
    row = lang_id.predict(documents((1, en + " " + de)), model).first()
    assert {s["lang"] for s in row["spans"]} == {"en", "de"}
    border = len(en.encode())
    inside = sum(s["end"] - s["start"] for s in row["spans"] if s["lang"] == ("en" if s["start"] < border else "de"))
    assert inside > 0.9 * (border + len(de.encode()))


@pytest.mark.parametrize("seed", range(5))
def test_path_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    count = np.array([3, 0, 5, 1, 4])
    first = np.concatenate([[0], np.cumsum(count)])
    scores = (rng.normal(size=(count.sum(), 3)) * 15).astype(np.float32)
    found = lang_id._paths(scores, count, first)
    for a, b in zip(first[:-1], first[1:]):
        value = lambda p: sum(scores[a + i, s] for i, s in enumerate(p)) - lang_id.SWITCH * sum(x != y for x, y in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(value(found[a:b]) - best) < 1e-3


def test_odd_texts(spark, model, documents):
    rows = [(1, None), (2, ""), (3, "123 ### 4.5"), (4, "the " * 30_000), (None, "the of and that"), (6, "ელ"), (7, "ʼ漢字 かな"), (7, "the")]
    found = {(r["doc_id"], r["lang_pred"]) for r in lang_id.predict(documents(*rows), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "en"), (7, "en")} <= found
    assert not {(6, "und"), (7, "und")} & found
    assert lang_id.predict(documents().limit(0), model).collect() == []


def test_nothing_to_learn_from(documents):
    docs = documents((1, "a b c"), (2, None)).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lang_id.identify(docs).collect()} == {"und"}
    assert lang_id.keep_identified(docs).collect() == []


def test_stage_keeps_columns_and_clean_texts(spark):
    docs = spark.read.parquet(DATA)
    bad = spark.createDataFrame([(-1, "12 34", "en", "s", 5), (-2, None, "en", "s", 0), (-3, "", None, None, None)], docs.schema)
    both = docs.union(bad).withColumns({"id": F.lit(1), "score": F.lit("x")})
    kept = lang_id.keep_identified(both)
    assert kept.columns == both.columns
    assert kept.filter("doc_id < 0").count() == 0 and kept.count() == docs.count()
