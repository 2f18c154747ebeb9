"""Fixed schemas of the event table, the GeoJSON input and its nested parts."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(text: str) -> T.StructType:
    """A struct from ``name type`` pairs of simple types, in the order given."""
    struct = T.StructType()
    for pair in text.split(","):
        name, kind = pair.split()
        struct.add(name, kind)
    return struct


# Names, order and types of the event table and of the GeoJSON fields.
EVENT_SCHEMA = _fields("""
    unid string, lat double, lon double, time timestamp, mag double, magtype string,
    depth double, evtype string, flynn_region string, source_id string,
    source_catalog string, lastupdate timestamp, author string
""")

MAGNITUDE_SCHEMA = _fields(
    "Value double, Type string, Nsta integer, Error double, Rang integer"
)

ORIGIN_SCHEMA = _fields("""
    Source_id string, Source_catalog string, Lastupdate timestamp, Time timestamp,
    Lat double, Lon double, Depth double, Evtype string, Auth string,
    Ndef integer, Nsta integer, Gap double, Rms double, Stime double, Smajor double,
    Sminor double, azimut double, Sdepth double, Mindist double, Maxdist double,
    Antype string, Loctype string
""").add("mags", T.ArrayType(MAGNITUDE_SCHEMA))

ARRIVAL_SCHEMA = _fields("""
    id string, Sta string, Dist double, Evaz double, Picktype string,
    Direction string, Detchar string, Phase string, Datetime string,
    Timeres double, Azim double, Azres double, Slow double, Sres double,
    Tdef string, Adef string, Sdef string, Snr double, Amp double, Per double
""")

POINT_SCHEMA = T.StructType().add("type", "string").add("coordinates", T.ArrayType(T.DoubleType()))

ORIGIN_COLLECTION_SCHEMA = (
    T.StructType()
    .add("geometry", POINT_SCHEMA)
    .add("origins", T.ArrayType(ORIGIN_SCHEMA))
)

PROPERTIES_SCHEMA = (
    _fields("""
    source_id string, source_catalog string, lastupdate timestamp, time timestamp,
    flynn_region string, lat double, lon double, depth double, evtype string, auth string,
    mag double, magtype string, unid string
""")
    .add("origins", ORIGIN_COLLECTION_SCHEMA)
    .add("arrivals", T.ArrayType(ARRIVAL_SCHEMA))
)

_FEATURE_FIELDS = (
    T.StructType()
    .add("type", "string")
    .add("geometry", POINT_SCHEMA)
    .add("id", "string")
    .add("properties", PROPERTIES_SCHEMA)
)

FEATURE_SCHEMA = T.StructType(_FEATURE_FIELDS.fields).add("_corrupt_record", "string")

# The collection keeps its members as raw JSON text, so that one broken member is parsed,
# reported and set aside on its own.
COLLECTION_SCHEMA = (
    T.StructType().add("type", "string").add("features", T.ArrayType(T.StringType()))
)

MESSAGE_SCHEMA = (
    T.StructType()
    .add("action", "string")
    .add("data", T.StructType(_FEATURE_FIELDS.fields))
    .add("_corrupt_record", "string")
)

MESSAGE_ACTIONS = ("create", "update")

EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# JSON property name -> event column, where the two differ.
RENAMED_PROPERTIES = {"auth": "author"}
