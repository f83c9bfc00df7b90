"""Enrichment of results: templates, lookups, outside calls."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.session import ship_package

BROADCAST_ROWS = 200_000
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {}


def template(text: str, missing: str = "") -> Column:
    """``${column}`` and ``${struct.field}`` replaced by the row's values; unknown or null ones by ``missing``."""
    parts = re.split(r"\$\{([\w.]+)\}", text)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit(missing)) for i, p in enumerate(parts)])


def lookup(rows: DataFrame, side: DataFrame, on: str, key: str, values: dict[str, object]) -> DataFrame:
    """Add columns of a side table by key, or their defaults where the key is absent. ``values``: column -> default.

    The side has one row per key (the least is taken if there are more). It is broadcast only if it has at
    most ``BROADCAST_ROWS`` rows; a larger one is joined by shuffle, where AQE splits hot keys.
    """
    slim = side.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*[F.col(c) for c in values])).alias("__v"))
    small = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(slim) if small else slim, rows[on] == F.col("__key"), "left")
    added = [F.coalesce(F.col(f"__v.{c}"), F.lit(d).cast(side.schema[c].dataType)).alias(c) for c, d in values.items()]
    return joined.select(*[rows[c] for c in rows.columns if c not in values], *added)


def call(rows: DataFrame, name: str, function: Callable[[pd.Series], pd.Series], argument: str, on_error: str = "null") -> DataFrame:
    """Add ``name``: what an outside function (a web service, a command) returns for ``argument``, in Arrow
    batches; each distinct argument of a batch is asked once. ``on_error``: ``null``, ``skip`` (an empty text)
    or ``drop`` (the row goes)."""
    if on_error not in ("null", "skip", "drop"):
        raise ValueError(on_error)
    ship_package(rows.sparkSession)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType()), T.StructField("__ok", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            asked = pd.Series(pdf[argument].dropna().unique())
            answers, failed = {}, set()
            for value in asked:
                try:
                    answers[value] = function(pd.Series([value])).iloc[0]
                except Exception:  # noqa: BLE001 - an outside failure is data here
                    failed.add(value)
            asked_for = pdf[argument].tolist()
            yield pdf.assign(**{name: [answers.get(v) for v in asked_for], "__ok": [v not in failed for v in asked_for]})

    out = rows.mapInPandas(run, schema)
    if on_error == "drop":
        return out.where("__ok").drop("__ok")
    if on_error == "skip":
        return out.withColumn(name, F.when(F.col("__ok"), F.col(name)).otherwise("")).drop("__ok")
    return out.drop("__ok")


def register(name: str, enricher: Callable[[DataFrame], DataFrame]) -> None:
    REGISTRY[name] = enricher


def apply(rows: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        rows = REGISTRY[name](rows)
    return rows
