"""The alert pipeline as a whole, and the timers of incidents.

Stages run in the order scope, inhibit, silence, dedup, group, strip; alerts out of scope pass untouched. All stages
but the timers are narrow steps and windows cut into blocks of time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.operators import alerts as A
from spanlight.operators import scan
from spanlight.session import ship_package


@dataclass
class Inhibition:
    source: list[A.Matcher]
    target: list[A.Matcher]
    equal: list[str]
    duration_s: int


@dataclass
class AlertPipeline:
    """The settings of all stages; what is left empty is skipped. ``strip`` names the event's columns that do not go on."""

    rules: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    levels: list[str] = field(default_factory=list)
    inhibitions: list[Inhibition] = field(default_factory=list)
    silences: list[tuple[list[A.Matcher], int, int]] = field(default_factory=list)
    dedup_by: list[str] = field(default_factory=list)
    dedup_resolve_s: int = 3600
    group_by: list[str] = field(default_factory=list)
    group_resolve_s: int = 3600
    strip: list[str] = field(default_factory=list)


def firsts(alerts: DataFrame, by: list[str], resolve_s: int) -> DataFrame:
    """Of every island of equal alerts the first one; the others are folded into it.

    A row starts its island where the one before it (in its block of time, or the last of the blocks before) is more than
    ``resolve_s`` seconds away, so no island is gathered."""
    numbered = scan.islands(alerts, by, "ts", ["seq"], resolve_s, "__i")
    first = F.row_number().over(Window.partitionBy(*by, "__i", F.floor(F.col("ts") / max(resolve_s, 6 * 3600))).orderBy("ts", "seq"))
    candidates = numbered.withColumn("__first", first).where("__first = 1")  # of each block of an island
    again = F.row_number().over(Window.partitionBy(*by, "__i").orderBy("ts", "seq"))
    return candidates.withColumn("__first", again).where("__first = 1").select(*alerts.columns)


def grouped(alerts: DataFrame, by: list[str], resolve_s: int) -> DataFrame:
    """The alerts with ``incident_id``: the key and the first second of their incident, hashed."""
    numbered = scan.islands(alerts, by, "ts", ["seq"], resolve_s, "__i")
    starts = numbered.groupBy(F.struct(*by, F.lit(0).alias("__whole")).alias("__g"), F.col("__i").alias("__gi")).agg(F.min("ts").alias("__start"))
    here = numbered.withColumn("__n", F.struct(*by, F.lit(0).alias("__whole")))
    joined = here.join(starts, (here["__n"] == starts["__g"]) & (here["__i"] == starts["__gi"]))
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.col("__start").cast("string"))
    return joined.select(*[here[c] for c in alerts.columns], F.sha2(text, 256).alias("incident_id"))


def run(alerts: DataFrame, pipeline: AlertPipeline) -> DataFrame:
    """The alerts that are passed on, with ``incident_id`` (null without grouping and out of scope).

    Null labels are empty texts for matchers and values of their own for keys; repeated rows count as alerts of their own.
    """
    inside = A.scope_column(pipeline.rules, pipeline.tags, pipeline.levels)
    outside = alerts.where(~inside).withColumn("incident_id", F.lit(None).cast("string"))
    rows = alerts.where(inside)
    for i in pipeline.inhibitions:
        rows = A.inhibit(rows, i.source, i.target, i.equal, i.duration_s)
    if pipeline.silences:
        rows = A.silence(rows, pipeline.silences)
    if pipeline.dedup_by:
        rows = firsts(rows, pipeline.dedup_by, pipeline.dedup_resolve_s)
    rows = grouped(rows, pipeline.group_by, pipeline.group_resolve_s) if pipeline.group_by else rows.withColumn("incident_id", F.lit(None).cast("string"))
    return rows.unionByName(outside).drop(*pipeline.strip)


def incident_timers(alerts: DataFrame, by: list[str], wait_s: int, interval_s: int, repeat_s: int, resolve_s: int) -> DataFrame:
    """When incidents are reported: ``by, first_ts, at_ts, trigger, n_alerts``, as an engine would that looks every second.

    An incident is reported first ``wait_s`` seconds after it began (``group_wait``). Later alerts are reported as soon as
    ``interval_s`` seconds have passed since the last report (``group_interval``); without any it is repeated every ``repeat_s``
    seconds (``repeat``; 0 = never), until ``resolve_s`` quiet seconds end it (``resolved``). An incident that is not open yet
    cannot be resolved; resolving comes before the interval, that before repeating. ``n_alerts`` counts the alerts up to then.

    Alerts are first added up by second, so an incident's fold sees at most as many rows as it has seconds.
    """
    ship_package(alerts.sparkSession)
    islands = scan.islands(alerts, by, "ts", ["seq"], resolve_s, "__i")
    seconds = islands.groupBy(*by, "__i", "ts").agg(F.count("*").alias("__n"))
    schema = T.StructType([*[alerts.schema[k] for k in by], *[T.StructField(n, T.LongType()) for n in ("first_ts", "at_ts")], T.StructField("trigger", T.StringType()), T.StructField("n_alerts", T.LongType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        times, sums = pdf["ts"].tolist(), pdf["__n"].cumsum().tolist()
        keys = [pdf[k].iloc[0] for k in by]
        end, seen, at = times[-1] + resolve_s, 0, times[0] + wait_s
        out = []

        def report(at: int, trigger: str) -> None:
            nonlocal seen
            while seen < len(times) and times[seen] <= at:
                seen += 1
            out.append((*keys, times[0], at, trigger, sums[seen - 1]))

        report(at, "group_wait")
        while True:
            dirty = max(times[seen], at + interval_s) if seen < len(times) else None
            again = at + repeat_s if repeat_s else None
            resolved = max(end, at + 1)
            following = min(x for x in (dirty, again, resolved) if x is not None)
            if following == resolved:
                report(resolved, "resolved")
                break
            at = following
            report(at, "group_interval" if at == dirty else "repeat")
        return pd.DataFrame(out, columns=schema.fieldNames())

    return seconds.groupBy(*by, "__i").applyInPandas(lambda pdf: fold(pdf), schema)


# -- selectors --------------------------------------------------------------------------------------------
def selector(name: str, columns: list[str]) -> Column:
    """A value of a result by its public name: ``rule``, ``level``, ``event.<field>``, ``match.<field>``,
    ``enrichment.<name>``, ``correlation.group_key.<field>``. What a result does not have is null."""
    space, _, rest = name.partition(".")
    if name == "rule":
        return F.coalesce(*[F.col(c).cast("string") for c in ("rule_id", "rule_title") if c in columns])
    if name == "level":
        return F.lower("level") if "level" in columns else F.lit(None).cast("string")
    if space == "event" and rest:
        return F.col(f"`{rest}`").cast("string") if rest in columns else F.lit(None).cast("string")
    if space == "match" and rest and "matched_fields" in columns:
        hits = F.filter("matched_fields", lambda m: m.field == rest)
        return F.try_element_at(hits, F.lit(1)).getField("value")
    if space == "enrichment" and rest:
        return F.col(f"enrichment.`{rest}`").cast("string") if "enrichment" in columns else F.lit(None).cast("string")
    if name.startswith("correlation.group_key.") and "group_key" in columns:
        return F.try_element_at("group_key", F.lit(name.removeprefix("correlation.group_key.")))
    if space in ("match", "correlation"):
        return F.lit(None).cast("string")
    raise ValueError(f"unknown selector {name!r}")


def select_values(results: DataFrame, names: list[str]) -> DataFrame:
    """The results with one column per selector, named like it."""
    return results.select("*", *[selector(n, results.columns).alias(n) for n in names])

