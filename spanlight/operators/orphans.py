"""References to records that the store did not hold."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.operators import bloom
from spanlight.operators.scan import running_sums
from spanlight.operators.timestamps import BLANKS
from spanlight.session import materialise

DAY_US = 86_400_000_000


@dataclass
class Referring:
    """A referring table: its name, rows, and reference columns (strings or arrays of strings)."""

    name: str
    rows: DataFrame
    fields: list[str] = field(default_factory=list)
    record: str = "id"
    at: str = "added_at"


def clean_id(column: Column) -> Column:
    """Ids compare trimmed and in lower case; blank ids are null."""
    return F.nullif(F.lower(F.trim(column, F.lit(BLANKS))), F.lit(""))


def _labelled(name: str, values: Column) -> Column:
    present = F.coalesce(values, F.array().cast("array<string>"))
    return F.transform(present, lambda x: F.struct(F.lit(name).alias("ref_field"), x.alias("target")))


def references(tables: list[Referring]) -> DataFrame:
    """``src_table, record_id, ref_field, target_id, at_us``, one row per reference; nulls and blanks are none.

    Rows whose own time is null cannot be judged and give no references.
    """
    parts = []
    for t in tables:
        arrays = []
        for name in t.fields:
            column = t.rows[name]
            values = column if t.rows.schema[name].dataType.typeName() == "array" else F.array(column)
            arrays.append(_labelled(name, values))
        parts.append(
            t.rows.where(t.rows[t.at].isNotNull())
            .select(F.lit(t.name).alias("src_table"), t.rows[t.record].alias("record_id"), F.unix_micros(t.rows[t.at].cast("timestamp")).alias("at_us"), F.explode(F.concat(*arrays)).alias("r"))
            .select("src_table", "record_id", "r.ref_field", clean_id(F.col("r.target")).alias("target_id"), "at_us")
            .where(F.col("target_id").isNotNull())
        )
    return reduce(DataFrame.unionByName, parts)


def lifetimes(tables: list[DataFrame], key: str = "id", start: str = "added_at", end: str = "deleted_at") -> DataFrame:
    """``target_id, from_us, to_us`` of every stored row of the parent tables (``to_us`` null = never deleted)."""
    parts = [
        t.select(clean_id(t[key]).alias("target_id"), F.unix_micros(t[start].cast("timestamp")).alias("from_us"), F.unix_micros(t[end].cast("timestamp")).alias("to_us"))
        .where(F.col("target_id").isNotNull())
        for t in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def find_orphans(refs: DataFrame, parents: DataFrame, blocks: int | None = None) -> DataFrame:
    """The references whose target had no live row at their time: ``refs``' columns and ``reason``.

    1. A Bloom filter over the parent keys is broadcast: negatives are definite orphans (``missing``) and leave here,
       without a shuffle. It is sized by the approximate number of distinct parent keys (``blocks`` overrides that); one
       that is too large to broadcast is partitioned, and the references are shuffled to it.
    2. The filter-positive references are verified exactly. Per target (added up before the shuffle) their earliest
       time is joined to the earliest start of a row that was never removed: if that came first, all references to
       the target are sound. The other targets are doubtful; a second Bloom filter, of these, keeps the sound
       references out of the rest, again without a shuffle.
    3. The doubtful references' distinct (target, time) pairs meet the additions (+1) and removals (-1) of their
       targets in one co-partitioned pass; the running sum of both is the number of rows alive. None alive:
       ``missing`` if the id has no row at all, ``late`` if none was added yet, else ``deleted``. The pass runs in
       blocks of a day per id, so that an id that has a third of all references, or of all versions, is spread
       over as many tasks as it has days.

    A parent lives from ``from_us`` (included) to ``to_us`` (excluded, null = for ever); a parent without a
    start never lives but its id exists. Repeated rows and ties change nothing.
    """
    columns = refs.columns
    if blocks is None:
        blocks = bloom.blocks_for(parents.agg(F.approx_count_distinct("target_id", 0.02)).first()[0])
    held = materialise(bloom.build(parents, "target_id", blocks), "bloom")
    flagged = bloom.probe(refs, "target_id", held, blocks, "maybe")
    positive = flagged.where("maybe").select(*columns)

    used = positive.groupBy("target_id").agg(F.min("at_us").alias("first_at"))
    kept = parents.where(F.col("to_us").isNull() & F.col("from_us").isNotNull()).groupBy(F.col("target_id").alias("__id")).agg(F.min("from_us").alias("kept_from"))
    doubtful = used.join(kept, F.col("target_id") == F.col("__id"), "left").where(F.col("kept_from").isNull() | (F.col("kept_from") > F.col("first_at"))).select("target_id")
    doubts = materialise(bloom.build(doubtful, "target_id", blocks), "bloom")
    # the one pass over all references that keeps some: the definite orphans and the doubtful references
    rest = materialise(bloom.probe(flagged, "target_id", doubts, blocks, "doubt").where(F.col("doubt") | ~F.col("maybe")).select(*columns, "maybe"), "references")
    definite = rest.where(~F.col("maybe")).select(*columns, F.lit("missing").alias("reason"))
    candidates = rest.where("maybe").select(*columns)
    suspects = bloom.probe(parents, "target_id", doubts, blocks, "doubt").where("doubt").select(*parents.columns)

    pairs = candidates.select("target_id", F.col("at_us").alias("t")).distinct().select("target_id", "t", F.lit(1).alias("probe"), F.lit(0).alias("net"), F.lit(0).alias("added"), F.lit(0).alias("known"))
    lives = (F.col("from_us").isNotNull()) & (F.col("to_us").isNull() | (F.col("to_us") > F.col("from_us")))
    change = lambda t, net, added, known: F.struct(t.cast("long").alias("t"), net.alias("net"), added.alias("added"), known.alias("known"))
    first = F.lit(-(1 << 62)).cast("long")
    changes = suspects.select(
        "target_id",
        F.explode(F.array(
            change(first, F.lit(0), F.lit(0), F.lit(1)),
            change(F.col("from_us"), F.when(lives, 1).otherwise(0), F.lit(1), F.lit(0)),
            change(F.when(lives, F.col("to_us")), F.lit(-1), F.lit(0), F.lit(0)),
        )).alias("c"),
    ).select("target_id", "c.*").where(F.col("t").isNotNull())
    changes = changes.groupBy("target_id", "t").agg(*[F.sum(c).cast("int").alias(c) for c in ("net", "added")], F.max("known").alias("known"))
    line = changes.select("target_id", "t", F.lit(0).alias("probe"), "net", "added", "known").unionByName(pairs)
    line = line.withColumn("block", F.floor(F.col("t") / DAY_US).cast("long"))
    judged = running_sums(line, ["target_id"], "block", ["t", "probe"], {"alive": "net", "so_far": "added", "exists": "known"})
    reason = F.when(F.col("exists") == 0, "missing").when(F.col("so_far") == 0, "late").otherwise("deleted")
    bad = judged.where((F.col("probe") == 1) & (F.col("alive") <= 0)).select(F.col("target_id").alias("__id"), F.col("t").alias("__t"), reason.alias("reason"))
    verified = candidates.join(bad, (candidates["target_id"] == bad["__id"]) & (candidates["at_us"] == bad["__t"]), "inner").select(*columns, "reason")
    return definite.unionByName(verified)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, reason and month."""
    period = F.date_format(F.timestamp_micros("at_us"), "yyyy-MM")
    return orphans.groupBy("src_table", "ref_field", "reason", period.alias("period")).agg(F.count("*").alias("n_references"), F.count_distinct("target_id").alias("n_targets"))
