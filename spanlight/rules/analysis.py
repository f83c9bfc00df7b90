"""Work on rules themselves: explanations, checks, drafts from examples, and exceptions from false positives."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlight.rules.compile import compile_detection, condition_column
from spanlight.rules.fields import Resolver, string_leaves
from spanlight.rules.model import Collection, Rule, condition_names, parse_condition

MAX_FIELDS = 200


def explain(events: DataFrame, rule: Rule, keep: list[str], json: set[str] = frozenset()) -> DataFrame:
    """Every selection and item of a rule as a boolean column, none skipped, and ``matched``."""
    resolver, leaves = Resolver(events.schema, set(json)), string_leaves(events.schema, set(json))
    used = set().union(*[condition_names(t, list(rule.detection)) for t in rule.conditions])
    selections = {n: compile_detection(b, resolver, leaves) for n, b in rule.detection.items() if n in used}
    parts = {}
    for n, body in rule.detection.items():
        if n in used and isinstance(body, dict):
            parts.update({f"{n}.{k}": compile_detection({k: v}, resolver, leaves) for k, v in body.items()})
    matched = condition_column(rule.conditions[0], selections)
    for t in rule.conditions[1:]:
        matched = matched | condition_column(t, selections)
    return events.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(n) for n, c in {**selections, **parts}.items()], matched.alias("matched"))


@dataclass
class Finding:
    rule: str
    code: str
    message: str


_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I)
# fixed values: what the public rule format allows
LEVELS = {"informational", "low", "medium", "high", "critical"}
STATUSES = {"stable", "test", "experimental", "deprecated", "unsupported"}
ADS_SECTIONS = ["goal", "categorization", "strategy_abstract", "technical_context", "blind_spots", "false_positives", "validation", "priority", "response"]


def lint(collection: Collection) -> list[Finding]:
    """Problems of form: missing or long titles, ids, levels, statuses, log sources, tags, unused selections, doubles."""
    out: list[Finding] = []
    ids: dict[str, str] = {}
    titles: dict[str, int] = {}
    for r in collection.rules:
        say = lambda code, message, r=r: out.append(Finding(r.title, code, message))
        if not r.title:
            say("missing_title", "the rule has no title")
        elif len(r.title) > 256:
            say("title_too_long", "the title has more than 256 characters")
        if not r.id:
            say("missing_id", "the rule has no id")
        elif not _UUID.match(r.id):
            say("invalid_id", "the id is no UUID")
        elif r.id in ids:
            say("duplicate_id", f"{ids[r.id]!r} has the same id")
        ids.setdefault(r.id or "", r.title)
        titles[r.title] = titles.get(r.title, 0) + 1
        if titles[r.title] == 2:
            say("duplicate_title", "another rule has this title")
        if r.level and r.level not in LEVELS:
            say("invalid_level", f"unknown level {r.level!r}")
        if r.status and r.status not in STATUSES:
            say("invalid_status", f"unknown status {r.status!r}")
        if not r.logsource:
            say("missing_logsource", "the rule has no log source")
        for t in r.tags:
            if not re.fullmatch(r"[a-z0-9_-]+\.[a-z0-9._-]+", t):
                say("invalid_tag", f"tag {t!r}")
        if len(set(r.tags)) < len(r.tags):
            say("duplicate_tags", "a tag is given twice")
        used = set().union(*[condition_names(t, list(r.detection)) for t in r.conditions])
        for n in r.detection:
            if n not in used and not n.startswith("_"):
                say("unused_selection", f"selection {n!r} is not used")
        for n, body in r.detection.items():
            if body in ({}, [], None):
                say("empty_selection", f"selection {n!r} is empty")
    return out


def ads_missing(rule: Rule) -> list[str]:
    """The sections of an alerting and detection strategy that a rule lacks."""
    own = rule.attributes.get("ads") or {}
    return [s for s in ADS_SECTIONS if not own.get(s)]


def profile(events: DataFrame, fields: list[str]) -> DataFrame:
    """``field, value, n, share``: how often each field has each value; values are counted map-side first."""
    if len(fields) > MAX_FIELDS:
        raise ValueError(f"more than {MAX_FIELDS} fields")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]))
    counts = events.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("n"))
    total = events.agg(F.count("*").alias("__total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("field", "value", "n", (F.col("n") / F.col("__total")).alias("share"))


def draft(examples: DataFrame, baseline: DataFrame, fields: list[str], title: str = "draft", stable: float = 0.9, max_fields: int = 5) -> Rule:
    """A rule for examples: the values that at least ``stable`` of them share, those rarest in the baseline first."""
    common = profile(examples, fields).where(F.col("share") >= stable).withColumnRenamed("share", "own").drop("n")
    usual = profile(baseline, fields).select("field", "value", F.col("share").alias("usual"))
    ranked = common.join(usual, ["field", "value"], "left").withColumn("usual", F.coalesce("usual", F.lit(0.0)))
    best = ranked.orderBy("usual", F.desc("own"), "field").limit(max_fields).collect()
    if not best:
        raise ValueError("the examples share no value")
    return Rule(title, {"selection": {r["field"]: r["value"] for r in best}}, [parse_condition("selection")])


def tune(rule: Rule, false_hits: DataFrame, true_hits: DataFrame, fields: list[str], stable: float = 0.9, max_fields: int = 2) -> Rule:
    """The rule with an exception for what its false positives share and none of its true positives has."""
    true_values = profile(true_hits, fields).select("field", "value").withColumn("seen", F.lit(True))
    common = profile(false_hits, fields).where(F.col("share") >= stable).join(true_values, ["field", "value"], "left").where(F.col("seen").isNull())
    best = common.orderBy(F.desc("share"), "field").limit(max_fields).collect()
    if not best:
        raise ValueError("no value sets the false positives apart")
    detection = {**rule.detection, "exception": {r["field"]: r["value"] for r in best}}
    return Rule(rule.title, detection, [("and", [t, ("not", ("name", "exception"))]) for t in rule.conditions], rule.id, rule.name, rule.level, rule.status, rule.tags, rule.logsource, rule.fields, rule.attributes, rule.raw)
