"""Detection and correlation over streams."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanlight.operators.correlate import matches
from spanlight.operators.detect import detect
from spanlight.rules.model import Collection, Correlation, RuleError
from spanlight.session import ship_package

FAR = 1 << 62


def detections(stream: DataFrame, collection: Collection, **options) -> DataFrame:
    """The detections of a stream; stateless, the same projection as in batch."""
    return detect(stream, collection, **options)


def tumbling_counts(stream: DataFrame, collection: Collection, correlation: Correlation, time: str, seq: str, late: str = "10 minutes") -> DataFrame:
    """An event count per tumbling window and group, final once the watermark has passed; built-in windowed state.

    Events later than ``late`` are dropped, as tumbling windows drop what comes after their end.
    """
    if correlation.type != "event_count":
        raise RuleError("tumbling counts need an event count")
    rows = matches(stream, collection, correlation, time, seq)
    keys = [f"k{i}" for i in range(len(correlation.group_by))]
    stamped = rows.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", late)
    counted = stamped.groupBy(F.window("event_time", f"{correlation.timespan} seconds"), *keys).agg(F.count("*").cast("double").alias("value"))
    tests = {"gt": F.col("value").__gt__, "gte": F.col("value").__ge__, "lt": F.col("value").__lt__, "lte": F.col("value").__le__, "eq": F.col("value").__eq__, "neq": F.col("value").__ne__}
    for op, n in correlation.predicates:
        counted = counted.where(tests[op](n))
    return counted


def sliding_correlation(stream: DataFrame, collection: Collection, correlation: Correlation, time: str, seq: str, late: str = "1 hour") -> DataFrame:
    """Firings of a sliding correlation (event_count, value_count, value_sum, temporal), event by event, in order of
    time and ``seq`` within a micro-batch, from a state per group: entries, and the time of the last firing for ``suppress``.

    A group's state holds what the windows of events up to ``late`` behind its newest hold; it is dropped once the
    watermark has passed the last window's end. Spark hands a group over in chunks without order, so its rows of one
    micro-batch (time, seq, rule and value) are gathered and sorted in one task.
    Events more than ``late`` behind the newest are dropped. Output: ``k0.., ts, seq, value``.
    """
    kinds = ("event_count", "value_count", "value_sum", "temporal")
    if correlation.type not in kinds or correlation.expression is not None:
        raise RuleError(f"streams support {kinds}")
    ship_package(stream.sparkSession)
    rows = matches(stream, collection, correlation, time, seq)
    keys = [f"k{i}" for i in range(len(correlation.group_by))]
    if not keys:
        rows, keys = rows.withColumn("k0", F.lit("")), ["k0"]
    rows = rows.withColumn("item", F.col("v0").cast("string") if "v0" in rows.columns else F.lit(None).cast("string")).select(*keys, "ts", F.col("seq").cast("long").alias("seq"), "rule", "item", F.timestamp_seconds("ts").alias("event_time")).withWatermark("event_time", late)
    out = T.StructType([*[T.StructField(k, T.StringType()) for k in keys], T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("value", T.DoubleType())])
    state_schema = "times array<long>, rules array<string>, items array<string>, fired long"
    span, kind, mute, reset = correlation.timespan, correlation.type, correlation.suppress or 0, correlation.action == "reset"
    behind = stream.sparkSession.range(1).select(F.unix_seconds(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {late}"))).first()[0]
    checks = list(correlation.predicates)
    tests = {"gt": float.__gt__, "gte": float.__ge__, "lt": float.__lt__, "lte": float.__le__, "eq": float.__eq__, "neq": float.__ne__}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, rules, values, fired = (list(x) if i < 3 else x for i, x in enumerate(state.get)) if state.exists else ([], [], [], None)
        newest = times[-1] if times else -FAR
        found = []
        for row in pd.concat(list(batches)).sort_values(["ts", "seq"]).itertuples(index=False):
            ts = int(row.ts)
            low, here = bisect_left(times, ts - span), bisect_right(times, ts)
            for held, x in ((times, ts), (rules, row.rule), (values, row.item)):
                held.insert(here, x)
            window = slice(low, here + 1)
            present = [v for v in values[window] if v is not None and v == v] if kind in ("value_count", "value_sum") else ()
            value = {"event_count": lambda: here + 1 - low, "value_count": lambda: len(set(present)), "value_sum": lambda: sum(map(float, present)), "temporal": lambda: len(set(rules[window]))}[kind]()
            if all(tests[op](float(value), float(n)) for op, n in checks) and (not mute or fired is None or ts - fired >= mute):
                found.append((*key, ts, int(row.seq), float(value)))
                fired = ts if fired is None else max(fired, ts)
                if reset:
                    for held in (times, rules, values):
                        del held[window]
            newest = max(newest, ts)
        # what comes next is at most ``late`` behind the newest
        old = bisect_left(times, newest - behind - span)
        state.update((times[old:], rules[old:], values[old:], fired))
        last = max([*times[-1:], *([] if fired is None else [fired])])
        state.setTimeoutTimestamp(max((last + max(span, mute) + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=[f.name for f in out.fields])

    return rows.groupBy(*keys).applyInPandasWithState(step, out, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def write_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run a stream through ``handle`` batch by batch, from a checkpoint; ``once`` stops when the input is used up."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
