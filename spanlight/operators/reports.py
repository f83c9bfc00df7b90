"""Measurements of rules: backtests, coverage, scorecards, hygiene, visibility and triage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.rules.model import Collection

MAD_SCALE = 1.4826  # fixed value: makes the MAD of normal values their standard deviation


def fire_counts(detections: DataFrame) -> DataFrame:
    """``rule_title, fires, last_ts`` of detections with ``rule_title`` and ``ts``."""
    return detections.groupBy("rule_title").agg(F.count("*").alias("fires"), F.max("ts").alias("last_ts"))


def backtest(fires: DataFrame, expectations: list[dict], unexpected: str = "warn") -> DataFrame:
    """Fire counts against ``{rule, at_least, at_most, exactly}``: ``rule_title, fires, status``. A rule without an
    expectation is ``unexpected`` if it fired (or ``passed`` where unexpected detections are allowed)."""
    spark = fires.sparkSession
    rows = [(e["rule"], e.get("at_least"), e.get("at_most"), e.get("exactly")) for e in expectations]
    wanted = spark.createDataFrame(rows, "rule_title string, at_least long, at_most long, exactly long")
    n = F.coalesce("fires", F.lit(0))
    known = F.col("expected").isNotNull()
    bad = (n < F.coalesce("at_least", F.lit(0))) | (n > F.coalesce("at_most", n)) | (n != F.coalesce("exactly", n))
    status = F.when(~known, F.lit("passed" if unexpected == "allow" else "unexpected")).when(bad, "failed").otherwise("passed")
    joined = fires.select("rule_title", "fires").join(F.broadcast(wanted.withColumn("expected", F.lit(True))), "rule_title", "full")
    return joined.select("rule_title", n.alias("fires"), status.alias("status"))


def techniques(collection: Collection) -> list[tuple[str, str]]:
    """(rule, technique) of all tags ``attack.tNNNN``."""
    import re

    return [(r.title, t.split(".", 1)[1].upper()) for r in collection.rules for t in r.tags if re.fullmatch(r"attack\.t\d{4}(\.\d{3})?", t.lower())]


def coverage_gaps(covered: DataFrame, targets: DataFrame, column: str = "technique") -> DataFrame:
    """The targets that no rule covers."""
    return targets.select(column).distinct().join(covered.select(column).distinct(), column, "left_anti")


def navigator_layer(collection: Collection, name: str = "coverage") -> dict:
    """The covered techniques as a layer of the public navigator format, scored by number of rules."""
    counts: dict[str, int] = {}
    for _, t in techniques(collection):
        counts[t] = counts.get(t, 0) + 1
    return {"name": name, "domain": "enterprise-attack", "versions": {"layer": "4.5"}, "techniques": [{"techniqueID": t, "score": n} for t, n in sorted(counts.items())]}


def fp_ratio(verdicts: DataFrame, bucket_s: int | None = None, min_total: int = 1, key: str = "dedup_key") -> DataFrame:
    """``rule, [bucket], total, fp_ratio`` of verdicts (``rule, verdict, ts, key``); one verdict per key counts, and
    fewer than ``min_total`` give no ratio."""
    once = verdicts.dropDuplicates(["rule", key])
    by = ["rule"] + ([F.floor(F.col("ts") / bucket_s).cast("long").alias("bucket")] if bucket_s else [])
    false = F.sum((F.col("verdict") == "false_positive").cast("long"))
    total = F.count("*")
    return once.groupBy(*by).agg(total.alias("total"), F.when(total >= min_total, F.round(false / total, 6)).alias("fp_ratio"))


@dataclass
class Limits:
    """Thresholds of the scorecard's verdicts."""

    max_live_fp: float = 0.5
    retire_below: float = 0.2
    keep_from: float = 0.8
    min_volume: int = 1
    max_age_s: int = 90 * 86_400


def scorecard(rules: DataFrame, limits: Limits, now: int) -> DataFrame:
    """Add ``precision`` and ``verdict`` (keep, tune, retire) to rows of ``rule_title, fires, unexpected, live_fp, last_ts,
    sole_coverage``.

    No volume retires; a high live false-positive ratio tunes; precision below the floors retires or tunes; else a rule is
    kept if it fires enough and recently. Without precision only a clean live ratio keeps it. A rule that is the only
    cover of a technique is tuned, not retired.
    """
    fires = F.coalesce("fires", F.lit(0))
    precision = F.when(F.col("unexpected").isNotNull() & (fires > 0), (fires - F.col("unexpected")) / fires)
    recent = F.coalesce(F.lit(now) - F.col("last_ts") <= limits.max_age_s, F.lit(False))
    verdict = (
        F.when(fires == 0, "retire").when(F.col("live_fp") > limits.max_live_fp, "tune")
        .when(precision < limits.retire_below, "retire").when(precision < limits.keep_from, "tune")
        .when(precision.isNull(), F.when(F.col("live_fp").isNotNull() & (fires >= limits.min_volume) & recent, "keep").otherwise("tune"))
        .when((fires >= limits.min_volume) & recent, "keep").otherwise("tune")
    )
    return rules.withColumn("precision", F.round(precision, 6)).withColumn("verdict", F.when((verdict == "retire") & F.coalesce("sole_coverage", F.lit(False)), "tune").otherwise(verdict))


def noisy_limit(fires: DataFrame) -> DataFrame:
    """One row, ``limit``: the median plus three scaled MADs of the fire counts of the rules that fired; null below three rules."""
    fired = fires.where("fires > 0")
    mid = fired.agg(F.percentile("fires", F.lit(0.5)).alias("mid"), F.count("*").alias("rules"))
    spread = fired.join(F.broadcast(mid), F.lit(True))  # one row
    return spread.groupBy("mid", "rules").agg(F.percentile(F.abs(F.col("fires") - F.col("mid")), F.lit(0.5)).alias("mad")).select(F.when(F.col("rules") >= 3, F.col("mid") + 3 * MAD_SCALE * F.col("mad")).alias("limit"))


def hygiene(collection: Collection, fires: DataFrame) -> DataFrame:
    """``rule_title, fires, findings``: silent, noisy, untagged, no_owner, no_status, no_level."""
    spark = fires.sparkSession
    rows = [(r.title, not r.tags, not (r.raw.get("author") or r.attributes.get("owner")), not r.status, not r.level) for r in collection.rules]
    about = spark.createDataFrame(rows, "rule_title string, untagged boolean, no_owner boolean, no_status boolean, no_level boolean")
    limit = noisy_limit(fires)
    joined = about.join(fires.select("rule_title", "fires"), "rule_title", "left").join(F.broadcast(limit), F.lit(True), "left")
    n = F.coalesce("fires", F.lit(0))
    flag = lambda name, c: F.when(c, F.lit(name))
    found = F.filter(F.array(flag("silent", n == 0), flag("noisy", n > F.col("limit")), *[flag(c, F.col(c)) for c in ("untagged", "no_owner", "no_status", "no_level")]), lambda x: x.isNotNull())
    return joined.select("rule_title", n.alias("fires"), found.alias("findings"))


def visibility_score(observed: Column, needed: Column) -> Column:
    """0 to 4 by the share of needed fields that are observed."""
    share = observed / needed
    return F.when(needed == 0, 0).when(share >= 1, 4).when(share >= 0.75, 3).when(share >= 0.5, 2).when(share > 0, 1).otherwise(0)
