"""Alert handling: scope, inhibition, silences, deduplication and incidents.

Alerts are rows of a DataFrame with a time in seconds (``ts``) and a unique ``seq``. The stages run in the
order scope, inhibit, silence, dedup, group; each maps a DataFrame to a DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.operators import scan
from spanlight.rules.match import java_regex
from spanlight.session import discard, materialise, ship_package

SILENCES_AT_ONCE = 200
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed values: the 64-bit FNV-1a hash


@dataclass
class Matcher:
    """``label = value``, ``!=``, ``=~`` (whole text matches) or ``!~``; an absent label is an empty text."""

    label: str
    op: str
    value: str

    @classmethod
    def parse(cls, text: str) -> Matcher:
        found = re.fullmatch(r"\s*([\w.]+)\s*(=~|!~|!=|=)\s*\"?(.*?)\"?\s*", text)
        if not found:
            raise ValueError(f"no matcher: {text!r}")
        return cls(*found.groups())

    def column(self) -> Column:
        text = F.coalesce(F.col(self.label).cast("string"), F.lit(""))
        if self.op in ("=", "!="):
            test = text == self.value
        else:
            test = text.rlike(java_regex(f"^(?:{self.value})$", []))
        return ~test if self.op.startswith("!") else test


def all_match(matchers: list[Matcher]) -> Column:
    return reduce(lambda a, b: a & b, [m.column() for m in matchers], F.lit(True))


def scope_column(rules: list[str] = (), tags: list[str] = (), levels: list[str] = ()) -> Column:
    """Whether an alert is of the given rules (ids or titles, with ``*``), tag prefixes and levels; an empty list is no limit."""
    tests = []
    if rules:
        patterns = "|".join(re.escape(r).replace(r"\*", ".*") for r in rules)
        tests.append(F.coalesce(F.col("rule_id").rlike(rf"^(?:{patterns})\z"), F.lit(False)) | F.coalesce(F.col("rule_title").rlike(rf"^(?:{patterns})\z"), F.lit(False)))
    if tags:
        tests.append(F.coalesce(F.exists("tags", lambda t: reduce(lambda a, b: a | b, [F.startswith(t, F.lit(p)) for p in tags])), F.lit(False)))
    if levels:
        tests.append(F.coalesce(F.lower("level").isin([x.lower() for x in levels]), F.lit(False)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def in_scope(alerts: DataFrame, rules: list[str] = (), tags: list[str] = (), levels: list[str] = ()) -> DataFrame:
    """The alerts in scope (:func:`scope_column`)."""
    return alerts.where(scope_column(rules, tags, levels))


def inhibit(alerts: DataFrame, source: list[Matcher], target: list[Matcher], equal: list[str], duration_s: int) -> DataFrame:
    """Drop target alerts while a source alert with the same ``equal`` labels was active: one that arrived
    before, less than ``duration_s`` seconds ago. An alert that matches both sides is a source and is never
    inhibited, so an inhibited alert is no source.

    The last source before each target is carried along in one window per key, cut into blocks of time.
    """
    width = max(duration_s, 6 * 3600)
    own = F.floor(F.col("ts") / width).cast("long")
    is_source, is_target = F.coalesce(all_match(source), F.lit(False)), F.coalesce(all_match(target), F.lit(False))
    marked = alerts.withColumns({"__source": is_source, "__target": is_target & ~is_source})
    blocks = F.when(F.col("__source"), F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(True).alias("own"))))
    spread = marked.withColumn("__x", F.explode(blocks))
    w = Window.partitionBy(*equal, "__x.b").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("__source"), F.col("ts"))).over(w)
    muted = F.col("__target") & F.coalesce(F.col("ts") - F.col("__last") < duration_s, F.lit(False))
    return spread.withColumn("__last", last).where(F.col("__x.own") & ~muted).select(*alerts.columns)


def silence(alerts: DataFrame, silences: list[tuple[list[Matcher], int, int]]) -> DataFrame:
    """Drop alerts for which a silence is active: all its matchers match and ``start <= ts < end``.

    Silences are tested in groups, one filter each, however many there are.
    """
    active = [all_match(m) & (F.col("ts") >= start) & (F.col("ts") < end) for m, start, end in silences]
    for i in range(0, len(active), SILENCES_AT_ONCE):
        alerts = alerts.where(~F.coalesce(reduce(lambda a, b: a | b, active[i : i + SILENCES_AT_ONCE]), F.lit(False)))
    return alerts


def fnv1a(*texts: Column) -> Column:
    """The FNV-1a hash of texts (each ended by a zero byte) as 16 hex digits, in Arrow batches."""

    @F.pandas_udf("string")
    def run(joined: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(text: str) -> str:
            if text not in known:
                h = 0xCBF29CE484222325
                for byte in text.encode():
                    h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
                known[text] = f"{h:016x}"
            return known[text]

        return joined.map(one)

    return run(F.concat(*[F.concat(F.coalesce(t.cast("string"), F.lit("")), F.lit("\0")) for t in texts]))


def dedup(alerts: DataFrame, by: list[str], resolve_s: int) -> DataFrame:
    """One row per island of equal alerts: a fingerprint of ``by`` stays open until no such alert has come for
    more than ``resolve_s`` seconds. Result: ``by, fingerprint, first_ts, last_ts, n, first_seq, resolved_ts``."""
    islands = scan.islands(alerts, by, "ts", ["seq"], resolve_s, "__i")
    ship_package(alerts.sparkSession)
    out = islands.groupBy(*by, "__i").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.min_by("seq", F.struct("ts", "seq")).alias("first_seq"))
    return out.withColumn("fingerprint", fnv1a(*[F.col(c) for c in by])).withColumn("resolved_ts", F.col("last_ts") + resolve_s).drop("__i")


def repeats(alerts: DataFrame, by: list[str], resolve_s: int, repeat_s: int) -> DataFrame:
    """The alerts that are passed on: an island's first, and then the first after each ``repeat_s`` seconds."""
    islands = scan.islands(alerts, by, "ts", ["seq"], resolve_s, "__i")
    inside = Window.partitionBy(*by, "__i")
    step = F.floor((F.col("ts") - F.min("ts").over(inside)) / repeat_s)
    first = F.row_number().over(Window.partitionBy(*by, "__i", "__step").orderBy("ts", "seq"))
    return islands.withColumn("__step", step).withColumn("__first", first).where("__first = 1").select(*alerts.columns)


def incidents(alerts: DataFrame, by: list[str], resolve_s: int) -> DataFrame:
    """Alerts grouped by their selectors into incidents, each ended by ``resolve_s`` quiet seconds."""
    islands = scan.islands(alerts, by, "ts", ["seq"], resolve_s, "__i")
    return (
        islands.groupBy(*by, "__i")
        .agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_alerts"), F.count_distinct("rule_title").alias("n_rules"), F.array_sort(F.collect_set("level")).alias("levels"))
        .withColumn("incident_id", F.sha2(F.concat_ws("", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.col("start_ts").cast("string")), 256))
        .drop("__i")
    )


@dataclass
class EntityGraph:
    """How alerts are joined into incidents by the entities they share.

    ``max_alerts``, if given, is a guard: of each value the first so many alerts (by ``ts`` if there is one, then ``seq``)
    are joined by it, the others not. Without it every alert is.
    """

    entities: list[str]
    stop_values: list[str] = field(default_factory=list)
    max_alerts: int | None = None


def entity_incidents(alerts: DataFrame, graph: EntityGraph) -> DataFrame:
    """``seq, incident``: alerts that share an entity value, directly or over others, are one incident; its name
    is its least ``seq``. Stop values, nulls and blanks join nothing, nor do a value's alerts beyond ``max_alerts``.

    Connected components on the graph of alerts and values: labels are passed on as minima, alternately from
    alerts to values and back, with each label replaced by its own label in between, so that long chains need
    logarithmically many rounds. All steps are aggregations; no pairs of alerts are made.
    """
    order = [c for c in ("ts", "seq") if c in alerts.columns]
    values = alerts.select(*order, F.explode(F.array(*[F.concat(F.lit(f"{e}="), F.lower(F.trim(F.col(e).cast("string")))) for e in graph.entities])).alias("value"))
    stops = [f"{e}={s.lower()}" for e in graph.entities for s in [*graph.stop_values, ""]]
    values = values.where(F.col("value").isNotNull() & ~F.col("value").isin(stops)).distinct()
    if graph.max_alerts is not None:
        arrival = Window.partitionBy("value").orderBy(*order)
        values = values.withColumn("__n", F.row_number().over(arrival)).where(F.col("__n") <= graph.max_alerts)
    values = values.select("seq", "value")
    sizes = values.groupBy("value").count().where(F.col("count") > 1).select("value")
    edges = materialise(values.join(sizes, "value", "left_semi"), "edges")
    labels = written = materialise(alerts.select("seq", F.col("seq").alias("label")), "labels")
    while True:
        best = edges.join(labels, "seq").groupBy("value").agg(F.min("label").alias("low"))
        offer = edges.join(best, "value").groupBy("seq").agg(F.min("low").alias("low"))
        moved = labels.join(offer, "seq", "left").select("seq", F.col("label").alias("before"), F.least("label", F.coalesce("low", "label")).alias("label"))
        target = moved.select(F.col("seq").alias("label"), F.col("label").alias("jump"))
        after = materialise(moved.join(target, "label", "left").select("seq", "before", F.least("label", F.coalesce("jump", "label")).alias("label")), "labels")
        discard(written)
        written, labels = after, after.select("seq", "label")
        if after.where("label <> before").isEmpty():
            break
    discard(edges)
    return labels.select("seq", F.col("label").alias("incident"))
