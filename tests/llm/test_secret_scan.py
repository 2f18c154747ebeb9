"""Spans against Python's own matching, and the ledger load by load."""

import random
import re

import pytest
from pyspark.sql import functions as F

from temblor.llm import secret_scan
from temblor.llm.arrays import running_sums
from temblor.llm.secret_scan import BASE_RULES, RULES, Rule, scan_versions, spans_by_path

VERSIONS = "path string, version bigint, text string"


def plain(text, rules=RULES):
    """The contract's words: leftmost matches that do not overlap, then those that are too short go."""
    base = {
        "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
        "access": (r"AKIA[A-Z0-9]+", 0, 0, 20), "hex": (r"[0-9a-f]+", 0, 0, 24)}
    spans = []
    for k, rule in enumerate(rules):
        pattern, flags, group, least = base.get(rule.kind, (rule.pattern, 0, rule.group, rule.least))
        spans += [(m.start(), k, m.end(), rule.kind) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]


def found(spark, root, rules=RULES):
    rows = spans_by_path(spark, root, "string", "bigint", rules).collect()
    return {(r["path"], r["version"]): [f"{s['kind']}:{s['start']}:{s['stop']}" for s in r["spans"]] for r in rows}


PIECES = ["password", "PassWD", "secret", "tOkEn", "apikey", "API_KEY", "=", ":", " ", "'", '"', "\n", "abc", "hunter22", "token=token=abcdef",
          "AKIA", "AKIA" + "Q" * 16, "AKIA" + "Q" * 15, "0123456789abcdef" * 2, "deadbeef" * 2, "é", "😀", "ſecret=abcdefgh", "toKen", "-", "x" * 30,
          "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "secret=token : abcdefgh", "Key"]


def test_spans_equal_plain_matching(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    texts += ["", None, " ", "password=" * 2000, "token=abcdef " * 1500, "f" * 100_000, "é" * 50_000 + "secret: abcdef", "AKIA" * 9]
    rows = [(f"p{i}", 0, t) for i, t in enumerate(texts)]
    scan_versions(spark.createDataFrame(rows, VERSIONS).repartition(4), str(tmp_path), "one")
    assert found(spark, str(tmp_path)) == {(p, v): plain(t or "") for p, v, t in rows}


def test_running_sums(spark):
    for n in (0, 1, 511, 512, 513, 3000):
        numbers = [(k * 7) % 11 for k in range(n)]
        frame = spark.createDataFrame([(numbers,)], "a array<bigint>")
        plain_sums = [sum(numbers[: k + 1]) for k in range(n)] if n < 600 else list(__import__("itertools").accumulate(numbers))
        assert frame.select(running_sums(F.col("a")).alias("s")).first()["s"] == plain_sums


def scanned(spark, root, load):
    rows = spark.read.parquet(f"{root}/findings").filter(F.col("load") == load).collect()
    return sorted((r["blob"][:4], tuple(sorted(r["rules"]))) for r in rows)


def test_only_unseen_blobs_and_rules_are_scanned(spark, tmp_path):
    root = str(tmp_path)
    first = [("a", 1, "password=hunter2"), ("b", 1, "password=hunter2"), ("a", 2, "nothing"), ("c", 1, None), ("c", 2, "")]
    scan_versions(spark.createDataFrame(first, VERSIONS), root, "monday", rules=BASE_RULES)
    assert len(scanned(spark, root, "monday")) == 3
    # The old text comes back under another path; one text is new.
    second = [("d", 1, "password=hunter2"), ("a", 3, "AKIA" + "Z" * 16)]
    scan_versions(spark.createDataFrame(second, VERSIONS), root, "tuesday", rules=BASE_RULES)
    assert len(scanned(spark, root, "tuesday")) == 1
    expected = {(p, v): plain(t or "", BASE_RULES) for p, v, t in first + second}
    assert found(spark, root, BASE_RULES) == expected
    # The same load once more replaces itself.
    scan_versions(spark.createDataFrame(second, VERSIONS), root, "tuesday", rules=BASE_RULES)
    assert len(scanned(spark, root, "tuesday")) == 1 and found(spark, root, BASE_RULES) == expected
    # A new version of one rule: all blobs once more, for that rule alone, and its old findings no longer count.
    changed = (Rule("assign", "pass(word)=", 1, 1, version=2), *BASE_RULES[1:])
    scan_versions(spark.createDataFrame(first + second, VERSIONS), root, "rules", rules=changed)
    assert [r for _, r in scanned(spark, root, "rules")] == [("assign@2",)] * 4
    again = found(spark, root, changed)
    assert again[("b", 1)] == again[("d", 1)] == ["assign:0:9"] and again[("a", 3)] == ["access:0:20"]


def test_copies_are_scanned_once_and_found_everywhere(spark, tmp_path):
    rows = [(f"p{i}", 0, "api_key = 'abcdef123'") for i in range(400)] + [("p1", 0, "api_key = 'abcdef123'"), (None, None, "token=abcdef")]
    scan_versions(spark.createDataFrame(rows, VERSIONS).repartition(5), str(tmp_path), "x")
    assert len(scanned(spark, str(tmp_path), "x")) == 2
    result = spans_by_path(spark, str(tmp_path), "string", "bigint").collect()
    assert len(result) == 402 and all(len(r["spans"]) == 1 for r in result)


def test_empty_tables_and_clashing_names(spark, tmp_path):
    nothing = spark.createDataFrame([], VERSIONS)
    scan_versions(nothing, str(tmp_path / "a"), "x")
    wide = spark.createDataFrame([("p", 1, "token=abcdef", "b", "s", 3)], VERSIONS + ", blob string, spans string, place int").withColumn("_match", F.lit(1))
    scan_versions(wide, str(tmp_path / "b"), "x")
    assert found(spark, str(tmp_path / "b")) == {("p", 1): ["assign:0:12"]}


@pytest.mark.parametrize("name", ["n_assign", "n_access", "n_hex"])
def test_digest_counts(spark, tmp_path, name):
    text = "token=abcdefg AKIA" + "A" * 16 + " " + "0a" * 12 + " -----BEGIN PRIVATE KEY-----"
    scan_versions(spark.createDataFrame([("1", 0, text)], VERSIONS), str(tmp_path), "x")
    row = secret_scan.digest_spans(spans_by_path(spark, str(tmp_path), "string", "bigint")).first()
    assert row[name] == 1 and row["spans"] == ",".join(plain(text)) and row["spans"].endswith("private-key:60:87")
