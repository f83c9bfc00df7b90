"""Overlapping, nested and gapped intervals per entity: a sweep line over their boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def covered_periods(df: DataFrame, keys: list[str], start: str, end: str, block_width: int = BLOCK) -> DataFrame:
    """Merge closed integer intervals per entity into continuous periods and list the gaps between them.

    Every interval gives a plus event at its start and a minus event at its end; equal boundaries of an entity
    are added up before the shuffle. The running count of active intervals is 0 before a period's first
    boundary and 0 after its last. Intervals that share a point belong together; a period may have length 0.
    A ``gap`` runs from a period's end to the start of the entity's next one.

    Result: ``keys, kind ('period' | 'gap'), start, end``. Rows with a null start or end, or ending before they
    start, are left out; null keys form an entity of their own. Duplicates change nothing.

    The sweep runs in blocks of ``block_width`` units: no task holds more than one block of one entity, which
    has at most ``block_width`` distinct boundaries. The boundaries are shuffled twice, to add up equal ones (with a map-side
    combine) and to lay each block out in order; between blocks only one row each travels: its total, where its prefix sum is
    least, and its first boundary, from which follow the count it begins with, and the next close and boundary after it.
    """
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("whole"))  # never null itself
    boundary = F.explode(F.array(
        F.struct(F.col(start).cast("long").alias("t"), F.lit(1).alias("d")),
        F.struct(F.col(end).cast("long").alias("t"), F.lit(-1).alias("d")),
    ))
    # key and block in one struct, which is never null: a join on it adds no test that would tell its two sides apart
    place = F.struct("g", F.floor(F.col("e.t") / F.lit(block_width)).cast("long").alias("block")).alias("gb")
    swept = rows.select(key.alias("g"), boundary.alias("e")).select(place, "e.t", "e.d").groupBy("gb", "t").agg(F.sum("d").alias("net"))
    in_block = Window.partitionBy("gb").orderBy("t")
    counted = swept.withColumn("prefix", F.sum("net").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))

    blocks = counted.groupBy("gb").agg(F.sum("net").alias("total"), F.min(F.struct("prefix", "t")).alias("least"), F.min("t").alias("first"))
    along = Window.partitionBy("gb.g").orderBy("gb.block")
    blocks = blocks.withColumn("carry", F.coalesce(F.sum("total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the count never falls below 0, so a block closes a period where its least prefix takes back all it began with
    closes_at = F.when(F.col("least.prefix") + F.col("carry") == 0, F.col("least.t"))
    blocks = blocks.select(
        F.col("gb").alias("of"), "carry",
        F.min(closes_at).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("next_close"),
        F.lead("first").over(along).alias("next_first"),
    )
    joined = counted.join(blocks, counted["gb"] == blocks["of"], "inner")
    after = F.col("prefix") + F.col("carry")
    edges = joined.select("gb", "t", "next_close", "next_first", (after - F.col("net") == 0).alias("opens"), (after == 0).alias("closes")).where("opens or closes")
    upto = F.coalesce(F.min(F.when(F.col("closes"), F.col("t"))).over(in_block.rowsBetween(0, Window.unboundedFollowing)), F.col("next_close"))
    beyond = F.coalesce(F.lead("t").over(in_block), F.col("next_first"))
    spans = edges.select("gb", "t", "opens", "closes", upto.alias("upto"), beyond.alias("beyond")).select("gb.g", F.explode(F.array(
        F.when(F.col("opens"), F.struct(F.lit("period").alias("kind"), F.col("t").alias("s"), F.col("upto").alias("e"))),
        F.when(F.col("closes"), F.struct(F.lit("gap").alias("kind"), F.col("t").alias("s"), F.col("beyond").alias("e"))),
    )).alias("x")).where(F.col("x.e").isNotNull())
    return spans.select(*[F.col(f"g.k{i}").alias(k) for i, k in enumerate(keys)], "x.kind", F.col("x.s").alias(start), F.col("x.e").alias(end))
