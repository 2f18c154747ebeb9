"""GeoJSON in and out: feature collections, single features and the 13-column table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from temblor.schema import (
    COLLECTION_SCHEMA,
    EVENT_COLUMNS,
    EVENT_SCHEMA,
    FEATURE_SCHEMA,
    RENAMED_PROPERTIES,
)

_PROPERTY_OF = {column: name for name, column in RENAMED_PROPERTIES.items()}
_JSON_TIME = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "timeZone": "UTC",
}


# The fields that must be present in the optional nested parts.
_ORIGIN_REQUIRED = ("Source_id", "Source_catalog", "Lastupdate", "Time", "Lat", "Lon", "Depth")
_MAG_REQUIRED = ("Value", "Type")
_ARRIVAL_REQUIRED = ("id", "Sta")


def _complete(items: Column, required, inner=None, inner_required=()) -> Column:
    """True unless an array has a member that lacks a required field; null arrays are fine."""

    def good(item: Column) -> Column:
        ok = F.lit(True)
        for name in required:
            ok = ok & item[name].isNotNull()
        return ok & _complete(inner(item), inner_required) if inner else ok

    return F.coalesce(F.forall(items, good), F.lit(True))


def empty_events(spark: SparkSession) -> DataFrame:
    """The event table without rows."""
    return spark.createDataFrame([], EVENT_SCHEMA)


def parsed_once(texts: DataFrame, text: str, schema: T.StructType, name: str) -> DataFrame:
    """Adds struct ``name``, the JSON of column ``text``.

    The parse goes through a one-element array and ``explode``, so that the optimizer cannot
    copy it into every filter on its result: each text is parsed once.
    """
    return texts.select("*", F.explode(F.array(F.from_json(text, schema))).alias(name))


def feature_columns(feature: str, corrupt: str) -> list[Column]:
    """Event columns, ``origins``, ``arrivals`` and ``error`` of a parsed feature struct.

    ``error`` is null for a good feature. ``corrupt`` names the column that is set when some
    part of the text could not be read.
    """
    prop = {c: F.col(f"{feature}.properties.{_PROPERTY_OF.get(c, c)}") for c in EVENT_COLUMNS}
    origins = F.col(f"{feature}.properties.origins")
    arrivals = F.col(f"{feature}.properties.arrivals")
    found = {_PROPERTY_OF.get(c, c): prop[c].isNotNull() for c in EVENT_COLUMNS}
    found["geometry"] = F.size(f"{feature}.geometry.coordinates") >= 2
    found["origins"] = _complete(
        origins["origins"], _ORIGIN_REQUIRED, lambda o: o.mags, _MAG_REQUIRED
    )
    found["arrivals"] = _complete(arrivals, _ARRIVAL_REQUIRED)
    missing = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in found.items()])
    )
    broken = F.col(corrupt).isNotNull()
    no_properties = F.col(f"{feature}.properties").isNull()
    error = (
        F.when(F.col(feature).isNull() | (no_properties & broken), "not a feature")
        .when(no_properties, "no properties")
        .when(F.size(missing) > 0, F.concat(F.lit("bad or missing: "), F.array_join(missing, ",")))
        .when(broken, "bad optional field")
    )
    return [
        *[prop[c].alias(c) for c in EVENT_COLUMNS],
        origins.alias("origins"),
        arrivals.alias("arrivals"),
        error.alias("error"),
    ]


def parse_features(features: DataFrame, text: str = "feature") -> DataFrame:
    """Read one Feature per row from a text column.

    Adds the 13 event columns, ``origins``, ``arrivals`` and ``error``, which is null for a
    good feature and names the defect otherwise. Other columns are kept.
    """
    parsed = parsed_once(features, text, FEATURE_SCHEMA, "_f")
    return parsed.select(*features.columns, *feature_columns("_f", "_f._corrupt_record"))


def require_all(parsed: DataFrame, text: str = "feature") -> DataFrame:
    """Stop the job with a clear message at the first row that has an error."""
    complaint = F.concat(F.lit("bad event: "), F.col("error"), F.lit(": "), F.col(text))
    return parsed.filter(
        F.when(F.col("error").isNull(), True).otherwise(F.raise_error(complaint).cast("boolean"))
    )


def split_collections(bodies: DataFrame, text: str = "value") -> DataFrame:
    """One row per member of each FeatureCollection, as raw JSON in ``feature``.

    A body that is not a collection stays as one row that no feature parser accepts.
    """
    parsed = bodies.withColumn("_c", F.from_json(F.col(text), COLLECTION_SCHEMA))
    members = F.when(
        F.col("_c.features").isNull(), F.array(F.col(text))
    ).otherwise(F.col("_c.features"))
    return parsed.select(
        *[c for c in bodies.columns if c != text], F.explode(members).alias("feature")
    )


def read_collections(bodies: DataFrame, text: str = "value", mode: str = "strict") -> DataFrame:
    """Events of FeatureCollection texts.

    ``strict``: one bad feature fails the whole read. ``quarantine``: every member comes
    back with its ``error`` and its raw ``feature``, to be split by the caller.
    """
    parsed = parse_features(split_collections(bodies, text))
    if mode == "quarantine":
        return parsed
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    return require_all(parsed).drop("feature", "error")


def read_feature_collection(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Events of the FeatureCollection files below ``path``.

    A file is one response body of at most 20,000 features, so it fits a task. Larger
    dumps belong in the one-feature-per-line form, which splits: see ``read_feature_lines``.
    """
    bodies = spark.read.text(path, wholetext=True)
    # Spark has no row for an empty file, but an empty body is no collection either.
    empty = _empty_files(spark, path)
    if empty:
        bodies = bodies.unionByName(spark.createDataFrame([("",)] * empty, "value STRING"))
    return read_collections(bodies, "value", mode)


def _empty_files(spark: SparkSession, path: str) -> int:
    """How many files below ``path`` are empty; hidden ones are passed over, as by Spark's readers."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    found, empty = system.globStatus(root) or [], 0
    for top in found:
        files = system.listFiles(top.getPath(), True)
        while files.hasNext():
            one = files.next()
            empty += one.getLen() == 0 and one.getPath().getName()[0] not in "._"
    return empty


def read_feature_lines(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """Events of files that hold one Feature per line."""
    parsed = parse_features(spark.read.text(path).withColumnRenamed("value", "feature"))
    if mode == "quarantine":
        return parsed
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    return require_all(parsed).drop("feature", "error")


def to_event_table(records: DataFrame) -> DataFrame:
    """The 13 table columns of parsed records or of Feature structs.

    Takes what ``parse_features`` gives, or any frame with a ``properties`` struct.
    """
    if "properties" in records.columns:
        return records.select(
            *[F.col(f"properties.{_PROPERTY_OF.get(c, c)}").alias(c) for c in EVENT_COLUMNS]
        )
    return records.select(*EVENT_COLUMNS)


def _point() -> Column:
    return F.struct(
        F.lit("Point").alias("type"), F.array(F.col("lon"), F.col("lat")).alias("coordinates")
    )


def to_event_records(events: DataFrame) -> DataFrame:
    """The table as records: point geometry rebuilt, nulls replaced by ``""``, 0 or 1970."""
    zero = {"string": F.lit(""), "double": F.lit(0.0), "timestamp": F.timestamp_micros(F.lit(0))}
    filled = events.select(
        *[
            F.coalesce(F.col(f.name), zero[f.dataType.simpleString()]).alias(f.name)
            for f in EVENT_SCHEMA
        ]
    )
    return filled.select(
        _point().alias("geometry"),
        *[F.col(c).alias(_PROPERTY_OF.get(c, c)) for c in EVENT_COLUMNS],
    )


def feature_json(**extra_properties: Column) -> Column:
    """The GeoJSON Feature text of an event row."""
    properties = F.struct(
        *[F.col(c).alias(_PROPERTY_OF.get(c, c)) for c in EVENT_COLUMNS],
        *[column.alias(name) for name, column in extra_properties.items()],
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        _point().alias("geometry"),
        F.col("unid").alias("id"),
        properties.alias("properties"),
    )
    return F.to_json(feature, _JSON_TIME)


def to_features(events: DataFrame, text: str = "value") -> DataFrame:
    """One GeoJSON Feature text per event."""
    return events.select(feature_json().alias(text))


def write_feature_collection(events: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one Feature per line, in parallel."""
    to_features(events).write.mode(mode).text(path)
