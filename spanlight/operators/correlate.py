"""Correlations: windowed aggregates over the matches of rules, per group key.

Batch correlations run in time order with ``seq`` breaking ties; an event sees only what arrived before it.
The sliding window is closed, ``[ts - span, ts]`` in whole seconds. Tumbling buckets are aligned to the epoch.
A session ends after a gap above the limit, or once it would last longer than the time span.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.operators import scan
from spanlight.rules.compile import compile_collection
from spanlight.rules.fields import Resolver, number_of, text_of
from spanlight.rules.model import Collection, Correlation, RuleError
from spanlight.session import ship_package

TIE = 1 << 30  # seconds are spread so far apart that every event of a second has its own place
SPARE = 1 << 28
BLOCK_S = 6 * 3600
PERCENT = {"value_median": 50.0}


def seconds_of(column: Column, kind: T.DataType) -> Column:
    """Event time in whole seconds: numbers are seconds, or milliseconds above 1e12; timestamps and texts in UTC."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(column.cast("timestamp")) / 1_000_000).cast("long")
    number = number_of(column, kind)
    value = F.when(F.abs(number) > 1e12, F.floor(number / 1000)).otherwise(F.floor(number)).cast("long")
    return F.coalesce(value, F.floor(F.unix_micros(column.try_cast("timestamp")) / 1_000_000).cast("long")) if isinstance(kind, T.StringType) else value


def matches(events: DataFrame, collection: Collection, correlation: Correlation, time: str, seq: str, json: set[str] = frozenset(), mapping: dict | None = None) -> DataFrame:
    """The correlation's input: one row per event and matching rule: ``rule, ts, seq, k0.., v0..``.

    Group keys follow the aliases of each rule; values that are no scalars give a null key, which is a group.
    """
    resolver = Resolver(events.schema, set(json), mapping or {})
    references = {r: collection.rule(r) for r in correlation.rules}
    compiled = compile_collection(Collection(list({id(r): r for r in references.values()}.values()), [], collection.filters), events.schema, json, mapping)
    predicate = {id(c.rule): c.predicate for c in compiled}
    when = seconds_of(F.col(f"`{time}`"), events.schema[time].dataType)

    def text(name: str) -> Column:
        found = resolver.find(name)
        return F.lit(None).cast("string") if found is None or found.many else text_of(found.column, found.type)

    def number(name: str) -> Column:
        found = resolver.find(name)
        return F.lit(None).cast("double") if found is None or found.many else number_of(found.column, found.type)

    numeric = correlation.type in ("value_sum", "value_avg", "value_percentile", "value_median")
    options = []
    for reference, rule in references.items():
        if id(rule) not in predicate:
            raise RuleError(f"rule {reference!r} cannot be compiled")
        keys = [text(correlation.aliases.get(g, {}).get(reference, g)).alias(f"k{i}") for i, g in enumerate(correlation.group_by)]
        values = [(number if numeric else text)(f).alias(f"v{i}") for i, f in enumerate(correlation.fields)]
        options.append(F.when(predicate[id(rule)], F.struct(F.lit(reference).alias("rule"), *keys, *values)))
    # the plain test first: it reaches the scan, and only matching events are expanded
    some = reduce(lambda a, b: a | b, [predicate[id(r)] for r in references.values()])
    return events.where(some & when.isNotNull()).select(when.alias("ts"), F.col(f"`{seq}`").alias("seq"), F.explode(F.array(*options)).alias("m")).where(F.col("m").isNotNull()).select("ts", "seq", "m.*")


def _keys(correlation: Correlation) -> list[str]:
    return [f"k{i}" for i in range(len(correlation.group_by))]


def aggregate(correlation: Correlation, w) -> Column:
    """The correlation's value over a window (or, with ``w`` None, over a group)."""
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    kind = correlation.type
    if kind == "event_count":
        return over(F.count(F.lit(1))).cast("double")
    if kind == "value_count":
        parts = [F.col(f"v{i}") for i in range(len(correlation.fields))]
        value = parts[0] if len(parts) == 1 else F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("\u001f", *parts))
        return F.size(over(F.collect_set(value))).cast("double")
    if kind == "value_sum":
        return F.coalesce(over(F.sum("v0")), F.lit(0.0))
    if kind == "value_avg":
        return F.coalesce(over(F.avg("v0")), F.lit(0.0))
    if kind in ("value_percentile", "value_median"):
        share = PERCENT.get(kind, correlation.percentile) / 100
        finite = F.when(~F.isnan("v0") & (F.abs("v0") != float("inf")), F.col("v0"))
        return over(F.percentile(finite, F.lit(share)))
    return F.size(over(F.collect_set("rule"))).cast("double")


def compare(value: Column, predicates: list[tuple[str, float]]) -> Column:
    tests = {
        "gt": lambda n: value > n, "gte": lambda n: value >= n, "lt": lambda n: value < n, "lte": lambda n: value <= n,
        "eq": lambda n: value == n, "neq": lambda n: value != n,
    }
    return F.coalesce(reduce(lambda a, b: a & b, [tests[op](n) for op, n in predicates]) if predicates else value.isNotNull(), F.lit(False))


def _expression(tree, fired: Column) -> Column:
    """A condition over the rules that fired; quantified selectors are false."""
    kind = tree[0]
    if kind == "name":
        return F.array_contains(fired, tree[1])
    if kind == "not":
        return ~_expression(tree[1], fired)
    if kind == "of":
        return F.lit(False)
    return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), [_expression(x, fired) for x in tree[1]])


def in_order(history: Column, rules: list[str]) -> Column:
    """Whether the rules occur in their order, at times that do not fall, in an array of (ts, seq, rule)."""
    start = F.lit(-(1 << 62)).cast("long")
    reached = F.aggregate(
        F.array(*[F.lit(r) for r in rules]),
        start,
        lambda at, rule: F.when(at.isNotNull(), F.array_min(F.transform(F.filter(history, lambda x: (x.rule == rule) & (x.ts >= at)), lambda x: x.ts))),
    )
    return reached.isNotNull()


def windowed(rows: DataFrame, correlation: Correlation) -> DataFrame:
    """Every match with ``value`` (the aggregate as of its arrival) and ``fires``."""
    keys = _keys(correlation)
    if correlation.window == "tumbling":
        placed = rows.withColumn("bucket", F.floor(F.col("ts") / correlation.timespan).cast("long"))
        w = Window.partitionBy(*keys, "bucket").orderBy("ts", "seq", "rule").rowsBetween(Window.unboundedPreceding, 0)
    elif correlation.window == "session":
        placed = with_sessions(rows, keys, correlation.gap if correlation.gap is not None else correlation.timespan, correlation.timespan)
        w = Window.partitionBy(*keys, "bucket").orderBy("ts", "seq", "rule").rowsBetween(Window.unboundedPreceding, 0)
    else:
        placed, w = _sliding(rows, keys, correlation.timespan)
    history = F.collect_list(F.struct("ts", "rule")).over(w)
    if correlation.type.startswith("temporal"):
        fired = F.array_distinct(F.transform(history, lambda x: x.rule)) if correlation.type == "temporal_ordered" else F.collect_set("rule").over(w)
        placed = placed.withColumn("fired", fired)
        if correlation.type == "temporal_ordered":
            placed = placed.withColumn("history", history)
        value = F.size("fired").cast("double")
        if correlation.expression is not None:
            fires = _expression(correlation.expression, F.col("fired"))
        else:
            fires = compare(value, correlation.predicates)
        if correlation.type == "temporal_ordered":
            fires = fires & in_order(F.col("history"), correlation.rules)
    else:
        most = correlation.attributes.get("max_group_entries")
        placed = placed.withColumn("value", aggregate(correlation, w) if most is None else newest_entries(correlation, placed, int(most)))
        value = F.col("value")
        fires = compare(value, correlation.predicates)
    out = placed.withColumn("value", value).withColumn("fires", F.coalesce(fires, F.lit(False)))
    if "own" in out.columns:
        out = out.where("own")
    return out.drop("fired", "history", "own", "place", "block", "tie")


def newest_entries(correlation: Correlation, placed: DataFrame, most: int) -> Column:
    """The aggregate over no more than the ``most`` newest entries of a window: older ones are dropped from it, as an engine
    with bounded state does (attribute ``max_group_entries``). A row carries at most that many entries."""
    if most < 1 or correlation.type not in ("event_count", "value_count", "value_sum", "value_avg"):
        raise RuleError(f"max_group_entries does not go with {correlation.type}")
    sliding = "place" in placed.columns
    order = ["place"] if sliding else ["ts", "seq", "rule"]
    rows = Window.partitionBy(*_keys(correlation), "block" if sliding else "bucket").orderBy(*order).rowsBetween(-(most - 1), 0)
    parts = [F.col(f"v{i}") for i in range(len(correlation.fields))]
    value = F.lit(1.0) if not parts else parts[0] if len(parts) == 1 else F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws("\u001f", *parts))
    entries = F.collect_list(F.struct((F.col("place") if sliding else F.lit(0)).alias("at"), value.alias("v"))).over(rows)
    if sliding:
        entries = F.filter(entries, lambda e: e.at >= F.col("place") - F.lit(correlation.timespan * TIE + SPARE))
    present = F.filter(F.transform(entries, lambda e: e.v), lambda v: v.isNotNull())
    if correlation.type == "event_count":
        return F.size(entries).cast("double")
    if correlation.type == "value_count":
        return F.size(F.array_distinct(present)).cast("double")
    total = F.aggregate(present, F.lit(0.0), lambda a, v: a + v)
    return total if correlation.type == "value_sum" else F.when(F.size(present) > 0, total / F.size(present)).otherwise(0.0)


def _sliding(rows: DataFrame, keys: list[str], span: int) -> tuple[DataFrame, Window]:
    """Rows with a unique place in time, and a range window that ends at the row itself.

    A group is cut into blocks of time; a row is repeated in the next block if it lies within that block's
    look-back, so a hot group is spread over as many tasks as it has blocks.
    """
    width = max(span, BLOCK_S)
    ranked = rows.withColumn("tie", F.row_number().over(Window.partitionBy(*keys, "ts").orderBy("seq", "rule")))
    own = F.floor(F.col("ts") / width).cast("long")
    blocks = F.when(F.col("ts") >= (own + 1) * width - span, F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), F.struct((own + 1).alias("block"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(own.alias("block"), F.lit(True).alias("own")))
    )
    placed = ranked.withColumn("b", F.explode(blocks)).select(*ranked.columns, "b.block", "b.own").withColumn("place", F.col("ts") * TIE + F.col("tie"))
    return placed, Window.partitionBy(*keys, "block").orderBy("place").rangeBetween(-(span * TIE + SPARE), 0)


def with_sessions(rows: DataFrame, keys: list[str], gap: int, cap: int) -> DataFrame:
    """Add ``bucket``: the session's first second. Gaps cut first; only the sessions that outlast the cap are
    folded in order, each by itself."""
    ship_package(rows.sparkSession)
    stretched = scan.islands(rows, keys, "ts", ["seq", "rule"], gap, "__s")
    inside = Window.partitionBy(*keys, "__s")
    stretched = stretched.withColumn("__first", F.min("ts").over(inside)).withColumn("__last", F.max("ts").over(inside))
    short = stretched.where(F.col("__last") - F.col("__first") <= cap).withColumn("bucket", F.col("__first"))
    long = stretched.where(F.col("__last") - F.col("__first") > cap)
    moments = long.select(*keys, "__s", "ts").distinct()
    schema = T.StructType([*[moments.schema[k] for k in keys], moments.schema["__s"], moments.schema["ts"], T.StructField("bucket", T.LongType())])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", ignore_index=True)
        starts, start = [], None
        for t in pdf["ts"]:
            start = t if start is None or t - start > cap else start
            starts.append(start)
        return pdf.assign(bucket=starts)

    folded = moments.groupBy(*keys, "__s").applyInPandas(fold, schema)
    on = reduce(lambda a, b: a & b, [long[c].eqNullSafe(folded[c]) for c in [*keys, "__s", "ts"]])
    capped = long.join(folded, on).select(*[long[c] for c in long.columns], folded["bucket"])
    return short.unionByName(capped).drop("__s", "__first", "__last")


def correlate(events: DataFrame, collection: Collection, correlation: Correlation, time: str, seq: str, json: set[str] = frozenset(), mapping: dict | None = None) -> DataFrame:
    """The firings of a correlation: ``correlation, ts, seq, k0.., value``; every arrival is evaluated anew.

    With ``suppress`` or ``action: reset`` the firings are what an engine that mutes or empties its window
    after firing would give (:func:`fold`).
    """
    rows = matches(events, collection, correlation, time, seq, json, mapping)
    if correlation.action == "reset":
        out = fold(rows, correlation)
    else:
        out = windowed(rows, correlation).where("fires")
        if correlation.suppress:
            out = suppress(out, _keys(correlation), correlation.suppress)
    return out.select(F.lit(correlation.key).alias("correlation"), "ts", "seq", *_keys(correlation), F.col("value").cast("double").alias("value"))


def suppress(fires: DataFrame, keys: list[str], mute: int) -> DataFrame:
    """Firings that are not within ``mute`` seconds of the last one let through; muted ones do not extend it."""
    return scan.spaced(fires, keys, "ts", ["seq"], mute)


def fold(rows: DataFrame, correlation: Correlation) -> DataFrame:
    """The exact fold, in arrival order, for windows that are emptied after firing. A group is split wherever a pause empties
    its window anyway; an activity without such a pause is folded as a whole, as every step depends on the one before."""
    ship_package(rows.sparkSession)
    keys = _keys(correlation)
    kind, span, rules = correlation.type, correlation.timespan, correlation.rules
    if kind not in ("event_count", "value_sum", "value_avg", "value_count", "temporal", "temporal_ordered") or correlation.expression is not None:
        raise RuleError("reset works with counts, sums, averages and temporal correlations")
    checks, mute = correlation.predicates, correlation.suppress or 0
    tests = {"gt": float.__gt__, "gte": float.__ge__, "lt": float.__lt__, "lte": float.__le__, "eq": float.__eq__, "neq": float.__ne__}
    window, gap = correlation.window, correlation.gap if correlation.gap is not None else span
    schema = T.StructType([*rows.schema.fields, T.StructField("value", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq", "rule"], ignore_index=True)
        state: list[tuple] = []
        out, last = [], None
        for row in pdf.itertuples(index=False):
            t = int(row.ts)
            if window == "sliding":
                state = [s for s in state if s[0] >= t - span]
            elif window == "tumbling":
                state = [s for s in state if s[0] // span == t // span]
            elif state and (t - state[-1][0] > gap or t - state[0][0] > span):
                state = []
            state.append((t, row.rule, getattr(row, "v0", None)))
            present = [s[2] for s in state if s[2] is not None and s[2] == s[2]]
            if kind == "event_count":
                value = float(len(state))
            elif kind == "value_count":
                value = float(len(set(present)))
            elif kind == "value_sum":
                value = float(sum(present))
            elif kind == "value_avg":
                value = float(sum(present) / len(present)) if present else 0.0
            else:
                value = float(len({s[1] for s in state}))
            fires = all(tests[op](value, float(n)) for op, n in checks)
            if fires and kind == "temporal_ordered":
                at = None
                for rule in rules:
                    times = [s[0] for s in state if s[1] == rule and (at is None or s[0] >= at)]
                    if not times:
                        fires = False
                        break
                    at = min(times)
            if fires and (last is None or t - last >= mute):
                out.append((*row, value))
                last, state = t, []
        return pd.DataFrame(out, columns=[*pdf.columns, "value"])

    # after a pause that empties the window and lets the mute time pass nothing of what came before counts
    pause = max(span, mute, gap if window == "session" else 0)
    split = scan.islands(rows, keys, "ts", ["seq", "rule"], pause, "__i")
    return split.groupBy(*keys, "__i").applyInPandas(lambda pdf: run(pdf.drop(columns="__i")), schema)


MAX_CHAIN = 10  # fixed value: how deep correlations may stand on correlations


def chain_order(collection: Collection) -> list[Correlation]:
    """The correlations, those that others refer to first; an error for circles and for chains deeper than ``MAX_CHAIN``."""
    named = {n: c for c in collection.correlations for n in (c.title, c.name, c.id) if n}
    depth: dict[int, int] = {}

    def deep(c: Correlation, above: tuple[int, ...]) -> int:
        if id(c) in above:
            raise RuleError(f"{c.key!r} refers to itself")
        if len(above) >= MAX_CHAIN:
            raise RuleError(f"more than {MAX_CHAIN} correlations stand on each other")
        if id(c) not in depth:
            depth[id(c)] = 1 + max([deep(named[r], (*above, id(c))) for r in c.rules if r in named], default=0)
        return depth[id(c)]

    return sorted(collection.correlations, key=lambda c: deep(c, ()))


def correlate_all(events: DataFrame, collection: Collection, time: str, seq: str, json: set[str] = frozenset(), mapping: dict | None = None) -> dict[str, DataFrame]:
    """The firings of every correlation of a collection by its key; correlations of correlations get those of the ones they refer to.

    A correlation refers either to rules or to correlations with the same group keys."""
    named = {n: c.key for c in collection.correlations for n in (c.title, c.name, c.id) if n}
    out: dict[str, DataFrame] = {}
    for c in chain_order(collection):
        below = [r for r in c.rules if r in named]
        if not below:
            out[c.key] = correlate(events, collection, c, time, seq, json, mapping)
        elif len(below) == len(c.rules):
            out[c.key] = chain([(r, out[named[r]]) for r in below], c)
        else:
            raise RuleError(f"{c.key!r} mixes rules and correlations")
    return out


def chain(fired: list[tuple[str, DataFrame]], correlation: Correlation) -> DataFrame:
    """A correlation over the firings of others: ``fired`` are their names and results; keys are taken over."""
    keys = _keys(correlation)
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("rule"), "ts", "seq", *keys) for name, df in fired])
    out = windowed(rows, correlation).where("fires")
    return out.select(F.lit(correlation.key).alias("correlation"), "ts", "seq", *keys, F.col("value").cast("double").alias("value"))


def last_events(rows: DataFrame, correlation: Correlation, n: int = 10) -> DataFrame:
    """Firings with references to the last ``n`` events in their window."""
    keys = _keys(correlation)
    placed, w = _sliding(rows, keys, correlation.timespan)
    seen = placed.withColumn("value", aggregate(correlation, w)).withColumn("__refs", F.collect_list(F.struct("ts", "seq")).over(w))
    refs = F.when(F.size("__refs") > n, F.slice("__refs", F.size("__refs") - (n - 1), F.lit(n))).otherwise(F.col("__refs"))
    return seen.withColumn("event_refs", refs).where(F.col("own") & compare(F.col("value"), correlation.predicates)).select("ts", "seq", *keys, "value", "event_refs")


def current_state(rows: DataFrame, correlation: Correlation) -> DataFrame:
    """Each group's value at its last event, and how far it is from its first threshold."""
    keys = _keys(correlation)
    valued = windowed(rows, correlation)
    newest = valued.groupBy(*keys).agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "seq")).alias("x")) if keys else valued.agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "seq")).alias("x"))
    threshold = float(correlation.predicates[0][1]) if correlation.predicates else 0.0
    return newest.select(*keys, F.col("x.ts").alias("ts"), F.col("x.value").alias("value"), (F.lit(threshold) - F.col("x.value")).alias("missing"))

