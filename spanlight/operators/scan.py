"""Running sums over long ordered groups, without gathering a group in one task.

A group's rows are cut into blocks; rows are summed inside their block, and every block gets what the
earlier blocks of its group add up to. The block totals of a group are bounded by its extent over the block
width, not by its rows.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.session import ship_package


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def running_sums(df: DataFrame, keys: list[str], block: str, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add, for each ``result: column`` of ``sums``, the inclusive running sum of the column in its group.

    ``keys`` name the group (nulls are a group of their own), ``block`` an integer column that does not
    decrease along ``order``; ``order`` must be unique within a group for a defined result. Nulls count as 0.
    """
    # keys and block as one struct: it is never null and nulls in it are equal, so the join keeps the windows' partitioning
    # and adds no test that would tell its two sides apart
    df_columns = df.columns
    group = F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("__whole")).alias("g")
    df = df.withColumn("__g", F.struct(group, F.col(block).alias("b")))
    inner = Window.partitionBy("__g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__g.g").orderBy("__g.b").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("__g").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__tot_{r}") for r, c in sums.items()])
    carry = totals.select(
        F.col("__g").alias("__cg"),
        *[F.coalesce(F.sum(f"__tot_{r}").over(earlier), F.lit(0)).alias(f"__carry_{r}") for r in sums],
    )
    local = df.withColumns({f"__in_{r}": F.sum(F.coalesce(F.col(c), F.lit(0))).over(inner) for r, c in sums.items()})
    joined = local.join(carry, local["__g"] == carry["__cg"], "inner")
    return joined.select(*[local[c] for c in df_columns], *[(F.col(f"__in_{r}") + F.col(f"__carry_{r}")).alias(r) for r in sums])


def islands(df: DataFrame, keys: list[str], time: str, order: list[str], gap: int, name: str = "island", inclusive: bool = False, width: int = 6 * 3600) -> DataFrame:
    """Add ``name``: the number of the row's island in its group; a new one begins where the time since the row before
    exceeds ``gap`` (or reaches it, with ``inclusive``). ``time`` is a whole number that is not null.

    The group is cut into blocks of ``width``, so that a hot group is spread over as many tasks as it has blocks. The rows
    are shuffled once; between blocks only one row each travels: its first and last time and how many islands begin in it.
    """
    columns = [c for c in df.columns if c != name]
    group = F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("__whole")).alias("g")
    cut = df.withColumn("__g", F.struct(group, F.floor(F.col(time) / max(gap, width)).cast("long").alias("b")))
    apart = lambda since: F.coalesce((since >= gap if inclusive else since > gap).cast("int"), F.lit(0))
    inside = Window.partitionBy("__g").orderBy(time, *order)
    fresh = cut.withColumn("__fresh", apart(F.col(time) - F.lag(time).over(inside)))
    counted = fresh.withColumn("__in", F.sum("__fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))

    along = Window.partitionBy("__g.g").orderBy("__g.b")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = counted.groupBy("__g").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.sum("__fresh").alias("begun"))
    blocks = blocks.withColumn("opens", apart(F.col("first") - F.max("last").over(earlier)))
    blocks = blocks.select(F.col("__g").alias("__of"), (F.coalesce(F.sum(F.col("begun") + F.col("opens")).over(earlier), F.lit(0)) + F.col("opens")).alias("__carry"))
    joined = counted.join(blocks, counted["__g"] == blocks["__of"], "inner")
    return joined.select(*[counted[c] for c in columns], (F.col("__in") + F.col("__carry")).alias(name))


def spaced(df: DataFrame, keys: list[str], time: str, order: list[str], least: int) -> DataFrame:
    """The rows of each group that are at least ``least`` apart, taken greedily in order: the first, then the first that comes
    ``least`` or more after the one taken last, and so on.

    Of each moment only the first row (by ``order``) can be taken; moments further apart than ``least`` from the one before
    begin anew, so that islands of moments are chosen from by themselves. What a task folds are moments (bounded by the
    island's time span), not rows.
    """
    ship_package(df.sparkSession)
    columns = df.columns
    nth = F.row_number().over(Window.partitionBy(*keys, time).orderBy(*order))
    firsts = df.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
    moments = islands(firsts.select(*keys, time), keys, time, [], least, "__i", inclusive=True)
    schema = T.StructType([*[moments.schema[k] for k in keys], moments.schema[time]])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time, ignore_index=True)
        keep, last = [], None
        for t in pdf[time]:
            taken = last is None or t - last >= least
            keep.append(taken)
            last = t if taken else last
        return pdf[keep][[*keys, time]]

    chosen = moments.groupBy(*keys, "__i").applyInPandas(choose, schema).select(F.struct(*keys, time).alias("__taken"))
    marked = firsts.withColumn("__at", F.struct(*keys, time))
    return marked.join(chosen, marked["__at"] == chosen["__taken"], "left_semi").select(*columns)
