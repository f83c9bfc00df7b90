"""Sessions of activity separated by inactivity gaps, by pointer doubling over cells of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.operators.scan import same_keys
from spanlight.session import discard, materialise


def settle(linked: DataFrame, payload: list[str]) -> DataFrame:
    """The root of every node that has a predecessor, by pointer doubling: ``root`` and the node's ``payload`` columns.

    ``linked`` are those nodes: ``id``, ``ptr`` (the predecessor's id) and payload; an id that only occurs as a pointer is
    a root. In each round the nodes are joined with themselves: every node that is not settled takes over the pointer of
    the node it points to, so that pointers double their reach and a chain of m nodes is settled after log2(m) + 1
    rounds. A node is settled when it points to a root, or takes the pointer of a settled node; it stays in its round's
    table, which later rounds only read, and the unsettled part of a table is dropped when the next round is written.
    """
    active = linked.select("id", "ptr", *payload)
    done: list[DataFrame] = []
    last = None
    while True:
        known = [active.select(F.col("id").alias("tid"), F.col("ptr").alias("tptr"), F.lit(False).alias("tdone"))]
        known += [d.select(F.col("id").alias("tid"), F.col("ptr").alias("tptr"), F.lit(True).alias("tdone")) for d in done]
        targets = reduce(DataFrame.unionByName, known)
        moved = active.join(targets, active["ptr"] == targets["tid"], "left").select(
            active["id"], F.coalesce("tptr", "ptr").alias("ptr"), *[active[c] for c in payload], (F.col("tdone").isNull() | F.col("tdone")).alias("done")
        )
        step = materialise(moved, "pointers", partition_by=["done"])
        if last is not None:
            discard(last, "done=false")
        done.append(step.where("done").drop("done"))
        active, last = step.where("not done").drop("done"), step
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done).select(F.col("ptr").alias("root"), *payload)


def sessionise(df: DataFrame, keys: list[str], time_us: str, gap_us: int) -> DataFrame:
    """Sessions per entity: ``keys, start_us, end_us, n_events``; a session goes on while the next event comes
    at most ``gap_us`` after the one before.

    Events of one *cell* (a stretch of time as long as the gap) always belong together, so rows are first
    added up per entity and cell, before and after the shuffle; a hot entity shrinks to its cells, at most the time
    span over the gap. Every cell is a node; it is linked to the cell before it if its first event comes within the gap
    after that cell's last one (a self-join on entity and cell, which spreads a hot entity over all tasks). Pointer
    doubling finds the root of every node (:func:`settle`), and the nodes are added up by root.

    Null keys are an entity of their own, null times are left out, ties count each row. The cells and pointers are
    written to the shared folder while this is called; the result reads them.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.where(F.col(time_us).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(time_us).cast("long").alias("us"))
    cells = (
        rows.withColumn("cell", F.expr(f"us div {gap_us} - if(us % {gap_us} < 0, 1, 0)").cast("long"))
        .groupBy(*names, "cell")
        .agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    cells = materialise(cells, "cells")
    before = cells.select(*names, (F.col("cell") + 1).alias("cell"), F.col("id").alias("ptr"), F.col("hi").alias("phi")).toDF(*names, "cell", "ptr", "phi")
    near = cells["lo"] - before["phi"] <= gap_us
    nodes = cells.join(before, same_keys(cells, before, [*names, "cell"]) & near, "left").select(*[cells[c] for c in (*names, "id", "lo", "hi", "n")], "ptr")
    nodes = materialise(nodes, "nodes")

    members = settle(nodes.where(F.col("ptr").isNotNull()), ["hi", "n"])
    added = members.groupBy("root").agg(F.max("hi").alias("last"), F.sum("n").alias("more"))
    sessions = nodes.where(F.col("ptr").isNull()).join(added, F.col("id") == F.col("root"), "left")
    return sessions.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], F.col("lo").alias("start_us"),
        F.coalesce("last", "hi").alias("end_us"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_events"),
    )
