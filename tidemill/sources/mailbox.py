"""Message exports: one JSON document per message, parts nested to any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNREADABLE, NO_ID, NO_PAYLOAD = "unreadable line", "missing id", "missing payload"

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("thread_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("labels", T.ArrayType(T.StringType())),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
            ),
        ),
    ]
)
PART_SCHEMA = T.StructType(
    [
        T.StructField("message_id", T.StringType()),
        T.StructField("path", T.ArrayType(T.IntegerType())),
        T.StructField("mime_type", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(raw, doc) for lines of an export (a column ``value``), from a file or a stream; ``doc`` is NULL for what is not JSON.

    The one-element inline keeps a filter on ``doc`` from parsing every line a second time.
    """
    parsed = F.inline(F.array(F.struct(F.try_parse_json("value").alias("doc"))))
    return lines.select(F.col("value").alias("raw"), parsed)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a stored export, parsed."""
    return parsed_lines(spark.read.text(path))


def _field(path: str, kind: str) -> Column:
    return F.try_variant_get("doc", path, kind)


def export_messages(export: DataFrame) -> DataFrame:
    """Messages of an export; the header dates are kept as text, ``ts`` is the arrival time."""
    # Milliseconds since 1970 in UTC, whatever the session's time zone.
    seconds = _field("$.internalDate", "string").try_cast("bigint").cast("decimal(20,0)") / 1_000
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return export.filter(F.col("doc").isNotNull()).select(
        _field("$.id", "string").alias("id"),
        _field("$.threadId", "string").alias("thread_id"),
        (F.lit("1970-01-01").cast("timestamp_ntz") + since).alias("ts"),
        _field("$.labelIds", "array<string>").alias("labels"),
        _field("$.payload.headers", "array<struct<name:string,value:string>>").alias("headers"),
    )


def export_rejects(export: DataFrame) -> DataFrame:
    """(id, raw, cause) of the lines that give no message with parts; nothing else is left out."""
    cause = (
        F.when(F.col("doc").isNull(), UNREADABLE)
        .when(_field("$.id", "string").isNull(), NO_ID)
        .when(_field("$.payload", "variant").isNull(), NO_PAYLOAD)
    )
    return export.select(_field("$.id", "string").alias("id"), "raw", cause.alias("cause")).filter(F.col("cause").isNotNull())


def export_parts(export: DataFrame) -> DataFrame:
    """One row per part of each message, nested to any depth, in a single pass over the export.

    Each level's parts are listed from the level above within the row, as often as the line has opening
    brackets: no tree is deeper. Lines that ``export_rejects`` lists give no parts.
    """
    nodes = "array<struct<path:array<int>,node:variant>>"

    def children(node: Column) -> Column:
        parts = F.coalesce(
            F.try_variant_get(node["node"], "$.parts", "array<variant>"), F.array().cast("array<variant>")
        )
        return F.transform(
            parts,
            lambda part, at: F.struct(F.concat(node["path"], F.array(at)).alias("path"), part.alias("node")),
        )

    root = F.array(F.struct(F.array().cast("array<int>").alias("path"), _field("$.payload", "variant").alias("node")))
    levels = F.length("raw") - F.length(F.replace("raw", F.lit("["), F.lit("")))

    def deeper(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["last"], children)).cast(nodes)
        return F.when(F.size(state["last"]) > 0, F.struct(F.concat(state["found"], below).alias("found"), below.alias("last"))).otherwise(state)

    start = F.struct(root.cast(nodes).alias("found"), root.cast(nodes).alias("last"))
    every = F.aggregate(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), start, deeper)["found"]
    rows = export.filter(F.col("doc").isNotNull() & _field("$.id", "string").isNotNull() & _field("$.payload", "variant").isNotNull())
    return rows.select(_field("$.id", "string").alias("message_id"), F.explode(every).alias("_part")).select(
        "message_id",
        "_part.path",
        F.try_variant_get("_part.node", "$.mimeType", "string").alias("mime_type"),
        F.try_variant_get("_part.node", "$.body.data", "string").alias("data"),
    )
