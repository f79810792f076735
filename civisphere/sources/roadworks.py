"""Work-zone features (GeoJSON) as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: West, south, east, north. Fixed values.
BOX = (-71.85, 46.50, -70.75, 47.25)
_S = T.StringType()
FEATURE = T.StructType([
    T.StructField("id", _S),
    T.StructField("geometry", T.StructType([T.StructField("type", _S), T.StructField("coordinates", _S)])),
    T.StructField("properties", T.StructType([*(T.StructField(n, _S) for n in ("event_type", "event_status", "vehicle_impact", "direction", "start_date", "end_date", "description", "update_date")), T.StructField("road_names", T.ArrayType(_S))])),
])


def parse_roadworks(raw: DataFrame, body: str = "body", source: str | None = None) -> DataFrame:
    """Features with their first point and a ``reject`` reason: missing_id,
    geometry, outside (no point in the box), duplicate (an accepted row of the
    same source and id stands before) or null for good ones; a body that cannot
    be read gives one row, rejected as malformed."""
    name = F.col(source) if source else F.lit("")
    made = F.from_json(body, T.StructType([T.StructField("features", T.ArrayType(FEATURE))]))["features"]
    rows = raw.select(name.alias("source"), F.posexplode_outer(made).alias("position", "f"))
    flat = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"-?[0-9]+(?:\.[0-9]+)?[eE]?[-+]?[0-9]*"), F.lit(0))
    out = rows.select("source", "position", "f.id", *(f"f.properties.{n}" for n in FEATURE["properties"].dataType.names), flat.alias("flat"))
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("flat") / 2).cast("int") - 1), lambda i: F.struct(F.get("flat", 2 * i).try_cast("double").alias("lon"), F.get("flat", 2 * i + 1).try_cast("double").alias("lat")))
    out = out.withColumn("points", F.when(F.size("flat") >= 2, points)).withColumns({"lon": F.get("points", 0)["lon"], "lat": F.get("points", 0)["lat"]})
    west, south, east, north = BOX
    inside = F.exists("points", lambda p: p["lon"].between(west, east) & p["lat"].between(south, north))
    reason = F.when(F.col("position").isNull(), "malformed").when(F.coalesce(F.trim("id"), F.lit("")) == "", "missing_id").when(F.col("lon").isNull() | F.col("lat").isNull(), "geometry").when(~inside, "outside")
    out = out.withColumn("reject", reason)
    # rows without an id keep apart, so they do not meet in one task
    key = F.when(F.col("reject").isNull(), F.col("id")).otherwise(F.concat_ws("|", F.lit(""), "position"))
    first = F.row_number().over(W.partitionBy("source", key).orderBy("position"))
    return out.withColumn("reject", F.when(F.col("reject").isNull() & (first > 1), "duplicate").otherwise(F.col("reject"))).drop("flat", "points")


def is_active(rows: DataFrame, as_of: str) -> DataFrame:
    """Adds ``active``: status active and no end before ``as_of``."""
    end = F.try_to_timestamp("end_date")
    return rows.withColumn("active", (F.col("event_status") == "active") & (end.isNull() | (end >= F.lit(as_of).cast("timestamp"))))
