"""Bundles of threat-intelligence objects, and answers of a collection server, as rows of objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """The objects of all bundle files below ``path``, one file per bundle or one bundle per line."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.when(F.try_parse_json("value").isNotNull(), F.array("value")).otherwise(F.split("value", "\r?\n"))
    return bundle_objects(whole.select(F.explode(lines).alias("value")), "value")


def bundle_objects(rows: DataFrame, column: str) -> DataFrame:
    """``rows``' other columns and, per object of each bundle text: ``bundle_id, place, id, type, spec_version, created, modified, body``.

    A text is a bundle if it has the type ``bundle``; an envelope of a server's answer (``objects`` without a type) counts as
    well. Texts that are neither have no rows; a bundle without objects has none either. ``body`` is the object's JSON.
    """
    others = [c for c in rows.columns if c != column]
    kind = F.get_json_object(F.col(column), "$.type")
    members = F.from_json(F.get_json_object(F.col(column), "$.objects"), "array<string>")
    objects = rows.where(kind.isNull() | (kind == "bundle")).select(*others, F.get_json_object(F.col(column), "$.id").alias("bundle_id"), F.posexplode(members).alias("place", "body"))
    text = lambda name: F.get_json_object("body", f"$.{name}")
    return objects.select(
        *others, "bundle_id", "place", text("id").alias("id"), text("type").alias("type"), F.coalesce(text("spec_version"), F.lit("2.0")).alias("spec_version"),
        text("created").try_cast("timestamp").alias("created"), text("modified").try_cast("timestamp").alias("modified"), "body",
    ).where(F.col("type").isNotNull())
