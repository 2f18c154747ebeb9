"""Secrets in every version of every text, by an incremental ledger of contents; expressions only.

A text is known by the hash of its content, its blob. The ledger holds which path had which blob in
which version, and which rules have been applied to which blob. A scan reads the texts of those blobs
only for which a rule, in its present version, has not been applied, each blob once however many paths
have it, and applies only these rules. Findings are then joined back to all paths by blob.

Each load writes partitions of its own and replaces them when it is run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from temblor.llm.arrays import running_sums


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters. A change of a rule
    needs a new ``version``; then all blobs are scanned for it once more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def long_enough(self, match: Column) -> Column:
        return F.length(F.regexp_extract(match, self.pattern, self.group)) >= self.least

    def span(self, placed: Column) -> Column:
        return F.struct(F.lit(self.name).alias("rule"), (placed["_stop"] - placed["_length"]).alias("start"), placed["_stop"].alias("stop"))


# The three base rules. Long runs are asked for in the pattern itself where that finds
# the same matches: no later start in a run can succeed if the first one does not.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# What this scan finds beyond these: headers of private keys and signed web tokens.
RULES = (
    *BASE_RULES,
    Rule("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web-token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
_SPAN = "struct<rule: string, start: bigint, stop: bigint>"


def add_spans(frame: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES, wanted: Column | None = None, name: str = "spans") -> DataFrame:
    """``frame`` with array ``name`` of (rule, start, stop): the places of each rule's leftmost matches
    that do not overlap, in code points, the end exclusive.

    ``wanted`` limits the rules, by name. Places come from the lengths of the matches and of what is
    between them, which are worked out only where something matches. Working columns begin with
    ``_``; they replace columns of that name.
    """
    text = F.col(text_col)
    found = []
    for k, rule in enumerate(rules):
        asked = F.lit(True) if wanted is None else F.array_contains(wanted, rule.name)
        # Step by step, so that no pattern runs twice over a text.
        nothing = F.array().cast("array<string>")
        frame = frame.withColumn("_match", F.when(asked, F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).otherwise(nothing))
        frame = frame.withColumn("_between", F.when(F.size("_match") > 0, F.split(text, rule.pattern, -1)).otherwise(nothing))
        lengths = F.transform("_match", lambda m: F.length(m).cast("bigint"))
        steps = F.zip_with(F.slice("_between", 1, F.size("_match")), "_match", lambda b, m: (F.length(b) + F.length(m)).cast("bigint"))
        good = F.transform("_match", rule.long_enough)
        frame = frame.withColumns({"_length": lengths, "_steps": steps, "_good": good}).drop("_match", "_between")
        frame = frame.withColumn("_stop", running_sums(F.col("_steps")))
        placed = F.filter(F.arrays_zip("_stop", "_length", "_good"), lambda z: z["_good"])
        frame = frame.withColumn(f"_found{k}", F.transform(placed, rule.span))
        frame = frame.drop("_length", "_steps", "_good", "_stop")
        found.append(f"_found{k}")
    empty = F.array().cast(f"array<{_SPAN}>")
    return frame.withColumn(name, F.concat(empty, *found)).drop(*found)


@dataclass(frozen=True)
class Ledger:
    """Folders below one root in storage that all executors share."""

    root: str

    @property
    def versions(self) -> str:
        return f"{self.root}/versions"

    @property
    def findings(self) -> str:
        return f"{self.root}/findings"


_FINDINGS_SCHEMA = f"blob string, rules array<string>, spans array<{_SPAN}>, load string"


def _findings(spark: SparkSession, ledger: Ledger, load: str | None = None) -> DataFrame | None:
    """What has been scanned, without the load of that name; None for a new ledger."""
    try:
        stored = spark.read.schema(_FINDINGS_SCHEMA).parquet(ledger.findings)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored if load is None else stored.filter(F.col("load") != load)


def _write(frame: DataFrame, path: str, load: str) -> None:
    """One load's partition, replacing an earlier attempt."""
    frame.withColumn("load", F.lit(load)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("load").parquet(path)


def scan_versions(
    versions: DataFrame, root: str, load: str, path_col: str = "path", version_col: str | None = "version",
    text_col: str = "text", rules: tuple[Rule, ...] = RULES,
) -> None:
    """Take ``versions`` (path, version, text) into the ledger at ``root`` as load ``load``.

    Only blobs that the ledger does not know, and known blobs for rules not yet applied to them in
    this version, are scanned. ``versions`` may repeat what earlier loads had, as the texts of known
    blobs are needed for a new rule; a load that is run again replaces itself.

    A null text is the empty text. Null paths and versions are values like others; repeated rows are
    recorded each. An empty table leaves empty partitions out. Other columns are not read.
    """
    spark, ledger = versions.sparkSession, Ledger(root)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    version = F.lit(None).cast("string") if version_col is None else F.col(f"`{version_col}`")
    named = versions.select(F.col(f"`{path_col}`").alias("path"), version.alias("version"), text.alias("text")).withColumn(
        "blob", F.sha2("text", 256))
    _write(named.select("path", "version", "blob"), ledger.versions, load)

    recorded = spark.read.schema(_versions_schema(named)).parquet(ledger.versions).filter(F.col("load") == load)
    # One place for each blob, by a number, so that hash aggregation can choose it.
    place = F.xxhash64("path", "version")
    wanted = recorded.groupBy("blob").agg(F.min(place).alias("place"))
    names = F.array(*[F.lit(r.name) for r in rules])
    earlier = _findings(spark, ledger, load)
    if earlier is None:
        wanted = wanted.withColumn("rules", names)
    else:
        done = earlier.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        wanted = wanted.join(done, "blob", "left").select(
            "blob", "place", F.array_except(names, F.coalesce("done", F.array().cast("array<string>"))).alias("rules"))
        wanted = wanted.filter(F.size("rules") > 0)
    # A blob's copies have other places, so they do not meet in one task; texts are hashed, not sorted.
    texts = named.withColumn("place", place).join(wanted.hint("shuffle_hash"), ["blob", "place"])
    scanned = add_spans(texts.select("blob", "rules", "text"), "text", rules, F.col("rules")).drop("text")
    # Rows that repeat path, version and text were scanned each, with one result.
    _write(scanned.dropDuplicates(["blob"]), ledger.findings, load)


def _versions_schema(named: DataFrame) -> str:
    kinds = dict(named.dtypes)
    return f"path {kinds['path']}, version {kinds['version']}, blob string, load string"


def spans_by_path(spark: SparkSession, root: str, path_type: str = "string", version_type: str = "string", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, version, blob, load, spans) of everything that the ledger holds; ``spans`` by the present rules,
    by start and then in the order of the rules."""
    ledger = Ledger(root)
    versions = spark.read.schema(f"path {path_type}, version {version_type}, blob string, load string").parquet(ledger.versions)
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    names = F.array(*[F.lit(r.name) for r in rules])
    nothing = F.array().cast("array<struct<start: bigint, rank: int, stop: bigint, kind: string>>")
    found = _findings(spark, ledger)
    if found is None:
        return versions.withColumn("spans", nothing)
    # Most blobs hold nothing; only the others are joined.
    found = found.filter(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("all"))
    kept = F.filter("all", lambda s: F.array_contains(names, s["rule"]))
    found = found.select("blob", F.array_sort(F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), F.element_at(order, s["rule"]).alias("rank"), s["stop"].alias("stop"),
        F.element_at(kinds, s["rule"]).alias("kind")))).alias("found"))
    return versions.join(found, "blob", "left").select(
        "path", "version", "blob", "load", F.coalesce("found", nothing).alias("spans"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest_spans(found: DataFrame, id_col: str = "doc_id", base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(doc_id, n_<kind>..., base_sha256, spans) from ``spans_by_path``."""
    kinds = [r.kind for r in base]
    def number_of(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    found = found.withColumn("_base", F.filter("spans", lambda s: s["kind"].isin(*kinds)))
    return found.select(
        F.col("path").alias(id_col), *map(number_of, kinds),
        F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
