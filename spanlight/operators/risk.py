"""Risk: scores of alerts, and incidents of entities whose risk adds up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.operators import scan
from spanlight.operators.correlate import BLOCK_S, SPARE, TIE
from spanlight.session import ship_package

# fixed values: the tactic names of the public ATT&CK matrix, and default scores of levels
TACTICS = [
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation",
    "defense-evasion", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
]
LEVELS = {"informational": 5.0, "low": 20.0, "medium": 40.0, "high": 60.0, "critical": 80.0}


def risk_score(attribute: Column | None, tags: Column, level: Column, tag_scores: dict[str, float] | None = None, combine: str = "max", level_scores: dict[str, float] | None = None, default: float = 0.0) -> Column:
    """The alert's own score attribute, else its tags' scores (summed or the greatest), else its level's, else the default."""
    options = []
    if attribute is not None:
        options.append(attribute.try_cast("double"))
    if tag_scores:
        scores = F.create_map(*[F.lit(x) for pair in tag_scores.items() for x in pair])
        known = F.filter(F.transform(tags, lambda t: F.try_element_at(scores, F.lower(t))), lambda s: s.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda a, s: a + s) if combine == "sum" else F.array_max(known)
        options.append(F.when(F.size(known) > 0, total))
    levels = level_scores or LEVELS
    options.append(F.try_element_at(F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]), F.lower(level)))
    return F.coalesce(*options, F.lit(default))


def risk_objects(entities: dict[str, list[str]]) -> Column:
    """The distinct (type, value) pairs of an alert: for each type, its columns; nulls and blanks are none."""
    pairs = [F.struct(F.lit(t).alias("type"), F.lower(F.trim(F.col(c).cast("string"))).alias("value")) for t, cs in entities.items() for c in cs]
    return F.array_distinct(F.filter(F.array(*pairs), lambda p: p.value.isNotNull() & (p.value != "")))


def tactics_of(tags: Column) -> Column:
    """The tactics among an alert's tags (``attack.defense_evasion`` -> ``defense-evasion``)."""
    slugs = F.transform(tags, lambda t: F.replace(F.regexp_replace(F.lower(t), r"^attack\.", ""), F.lit("_"), F.lit("-")))
    return F.array_distinct(F.filter(slugs, lambda t: t.isin(TACTICS)))


def accumulate(alerts: DataFrame, keys: list[str], window_s: int) -> DataFrame:
    """Each alert with its entity's ``total`` score and ``n_tactics`` over the window ``(ts - window, ts]``, counting
    what had arrived. Needs ``ts``, ``seq``, ``score``, ``tactics``. Hot entities are cut into blocks of time."""
    width = max(window_s, BLOCK_S)
    own = F.floor(F.col("ts") / width).cast("long")
    ranked = alerts.withColumn("__tie", F.row_number().over(Window.partitionBy(*keys, "ts").orderBy("seq")))
    blocks = F.when(F.col("ts") > (own + 1) * width - window_s, F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(True).alias("own"))))
    placed = ranked.withColumn("__x", F.explode(blocks)).withColumn("__place", F.col("ts") * TIE + F.col("__tie"))
    w = Window.partitionBy(*keys, "__x.b").orderBy("__place").rangeBetween(-((window_s - 1) * TIE + SPARE), 0)
    out = placed.withColumn("total", F.sum("score").over(w)).withColumn("n_tactics", F.size(F.array_distinct(F.flatten(F.collect_set("tactics").over(w)))))
    return out.where("__x.own").drop("__x", "__tie", "__place")


def risk_incidents(alerts: DataFrame, keys: list[str], window_s: int, score: float, tactics: int | None = None, cooldown_s: int = 0) -> DataFrame:
    """Alerts at which an entity's risk reaches the score, or its number of tactics the limit; after one, the
    entity is quiet for ``cooldown_s`` seconds. Adds ``total``, ``n_tactics``, ``trigger``."""
    reached = accumulate(alerts, keys, window_s)
    trigger = F.when(F.col("total") >= score, "score")
    if tactics is not None:
        trigger = F.coalesce(trigger, F.when(F.col("n_tactics") >= tactics, F.lit("tactic_count")))
    fires = reached.withColumn("trigger", trigger).where(F.col("trigger").isNotNull())
    if not cooldown_s:
        return fires
    return scan.spaced(fires, keys, "ts", ["seq"], cooldown_s)
