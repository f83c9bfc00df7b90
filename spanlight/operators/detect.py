"""Detection: events against a collection of rules, as one projection."""

from __future__ import annotations

import fnmatch
import json as json_text
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.rules.compile import Compiled, compile_collection
from spanlight.rules.fields import Resolver, string_leaves, text_of
from spanlight.rules.model import Collection, Rule
from spanlight.rules.plain import literal
from spanlight.rules.prefilter import prefilter

GROUP = 16  # rules of like literals that are tried together
PREFILTER = 20  # from so many rules on, their literals are looked for first


def rule_fields(rule: Rule) -> list[str]:
    """The event fields that a rule's selections read."""
    out: dict[str, None] = {}

    def walk(body) -> None:
        if isinstance(body, dict):
            for key, value in body.items():
                name = key.split("|")[0].split("[")[0]
                if name:
                    out[name] = None
                walk(value)
        elif isinstance(body, list):
            for x in body:
                walk(x)

    for body in rule.detection.values():
        walk(body)
    return list(out)


_ROW = "array<struct<field:string,value:string>>"
_SEPARATORS = ("\x01", "\x02")  # between matches, and between a match's rule and selections


def _details(compiled: Compiled, resolver: Resolver) -> Column:
    """The names and values of a rule's fields, those that the event has."""
    fields = []
    for name in rule_fields(compiled.rule):
        found = resolver.find(name)
        if found is not None and not found.many:
            fields.append(F.struct(F.lit(name).alias("field"), text_of(found.column, found.type).alias("value")))
    return F.filter(F.array(*fields), lambda x: x.value.isNotNull()) if fields else F.array().cast(_ROW)


def detect(
    events: DataFrame,
    collection: Collection,
    keep: list[str] | None = None,
    json: set[str] = frozenset(),
    mapping: dict | None = None,
    logsource: dict[str, Column | str] | None = None,
    detail: bool = False,
) -> DataFrame:
    """One row per event and matching rule: the event's columns (``keep``, default all), ``rule_title``,
    ``rule_id``, ``level``, ``tags``, ``matched_selections``, ``matched_fields`` (names and values with ``detail``).

    A narrow projection: rules become boolean columns, common subexpressions are shared, and only events that
    match some rule are expanded. From ``PREFILTER`` rules on, one pass over each field finds the literals of all rules
    in it, and only the groups of rules that one of the found literals belongs to are tried (rules from which no literal
    can be derived always are). Works on streams as well.

    An event's matches are gathered as one text, not as an array that a lambda filters: lambdas make Spark interpret
    everything below them, texts are compiled.
    """
    compiled = compile_collection(collection, events.schema, json, mapping, logsource)
    resolver = Resolver(events.schema, set(json), mapping or {})
    names = keep if keep is not None else events.columns
    kept = [F.col(f"`{c}`") for c in names]
    if not compiled:
        text, texts = (lambda: F.lit(None).cast("string")), (lambda: F.lit(None).cast("array<string>"))
        none = [text().alias("rule_title"), text().alias("rule_id"), text().alias("level"), texts().alias("tags"), texts().alias("matched_selections"), F.array().cast(_ROW).alias("matched_fields")]
        return events.select(*kept, *none).where(F.lit(False))
    between, inside = _SEPARATORS
    def match(i: int, c: Compiled) -> Column | str:
        """The rule's number and its selections that matched, or null; as SQL text if the rule has one."""
        whole = inside.join([str(i), *c.names]) if c.rule.conditions == [("name", *c.names)] else None  # its one selection is what matched
        if c.text is not None and c.source is None:
            chosen = literal(whole) if whole else f"concat_ws('{inside}', '{i}', " + ", ".join(f"CASE WHEN {t} THEN {literal(n)} END" for n, t in c.selection_text.items()) + ")"
            return f"CASE WHEN {c.text} THEN {chosen} END"
        return F.when(c.predicate, F.lit(whole) if whole else F.concat_ws(inside, F.lit(str(i)), *[F.when(test, F.lit(n)) for n, test in c.selections.items()]))

    def gather(parts: list[Column | str]) -> Column:
        texts = [p for p in parts if isinstance(p, str)]
        columns = [p for p in parts if not isinstance(p, str)]
        if texts:
            columns.append(F.expr(f"concat_ws('{between}', {', '.join(texts)})"))
        return columns[0] if len(columns) == 1 and texts else F.concat_ws(between, *columns)

    source = events
    if len(compiled) >= PREFILTER:
        tried = prefilter([c.rule for c in compiled], resolver, string_leaves(events.schema, json), GROUP)
        grouped: dict[int, list[Column | str]] = {}
        for i, c in enumerate(compiled):
            grouped.setdefault(tried.group_of[i], []).append(match(i, c))
        parts = [gather(grouped[-1][i : i + GROUP]) for i in range(0, len(grouped.get(-1, [])), GROUP)]
        if tried.hits is not None:
            source = events.withColumn("__hits", tried.hits)
            parts += [F.when(F.array_contains("__hits", g), gather(own)) for g, own in sorted(grouped.items()) if g >= 0]
        found = F.concat_ws(between, *parts)
    else:
        found = gather([match(i, c) for i, c in enumerate(compiled)])
    # A lambda of its own keeps this projection out of whole-stage code, whose one method would grow too long to be compiled.
    # It becomes the limit of the split, where 0 and -1 mean the same.
    apart = -F.exists(F.array(F.col(f"`{events.columns[0]}`").cast("string")), lambda x: x == "").cast("int")
    found = source.select(*[F.col(f"`{c}`") for c in events.columns], found.alias("__found"), F.coalesce(apart, F.lit(0)).alias("__limit"))
    rows = found.select("*", F.explode(F.when(F.col("__found") != "", F.split("__found", between, F.col("__limit")))).alias("__match")).where(F.col("__match") != "")
    cut = F.split("__match", inside)
    described = json_text.dumps([{"title": c.rule.title, "id": c.rule.id, "level": c.rule.level, "tags": [*c.rule.tags]} for c in compiled])
    of_rule = F.from_json(F.lit(described), "array<struct<title:string,id:string,level:string,tags:array<string>>>")
    number = F.element_at(cut, 1).try_cast("int")
    rule = F.element_at(of_rule, number + 1)
    details = F.array().cast(_ROW)
    if detail:
        for i, c in enumerate(compiled):
            details = F.when(number == i, _details(c, resolver)).otherwise(details)
    return rows.select(
        *kept, rule["title"].alias("rule_title"), rule["id"].alias("rule_id"), rule["level"].alias("level"), rule["tags"].alias("tags"),
        F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))).alias("matched_selections"), details.alias("matched_fields"),
    )


def matching(events: DataFrame, collection: Collection, rule: Rule, json: set[str] = frozenset(), mapping: dict | None = None, logsource: dict | None = None) -> DataFrame:
    """The events that match one rule; the filter reaches the scan."""
    single = Collection([rule], [], collection.filters)
    return events.where(compile_collection(single, events.schema, json, mapping, logsource)[0].predicate)


def emitted(detections: DataFrame, collection: Collection) -> DataFrame:
    """The detections that are reported where correlations stand for their rules: those of rules that some correlation
    without ``generate`` refers to are left out. A rule is named by its id, name or title."""
    named = {name for c in collection.correlations if not c.generate for name in c.rules}
    hidden = [r for r in collection.rules if r.names() & named]
    own = [(F.col("rule_id").eqNullSafe(F.lit(r.id).cast("string"))) & (F.col("rule_title") == r.title) for r in hidden]
    return detections.where(~reduce(lambda a, b: a | b, own)) if own else detections


def subset(collection: Collection, logsource: dict[str, str]) -> Collection:
    """The rules that may match events of a known log source: those whose own log source states nothing that differs. Rules
    of other sources are not even compiled."""
    fits = lambda r: all(
        fnmatch.fnmatchcase(logsource[k].lower(), v.lower()) for k, v in r.logsource.items() if v and logsource.get(k)
    )
    return Collection([r for r in collection.rules if fits(r)], collection.correlations, collection.filters, collection.errors)
