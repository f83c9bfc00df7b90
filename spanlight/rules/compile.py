"""Rules to Columns: selections, conditions, exception filters and log source pruning."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.rules.fields import Resolver, string_leaves
from spanlight.rules.match import all_of, any_of, match_field, match_keywords
from spanlight.rules.plain import plain_rule
from spanlight.rules.model import Collection, Filter, Rule, RuleError, condition_names, selected

_BLOCK = re.compile(r"(.+)\[(any|all|all_or_empty|none)\]\Z")


class Compiled:
    """A rule and its predicate. ``text`` is the predicate as SQL text where the rule is plain enough for that
    (:mod:`spanlight.rules.plain`); Columns are made of it when they are asked for, which is dear for many rules."""

    def __init__(self, rule: Rule, text: str | None = None, selection_text: dict[str, str] | None = None, predicate: Column | None = None, selections: dict[str, Column] | None = None, source: Column | None = None) -> None:
        self.rule, self.text, self.selection_text, self.source = rule, text, selection_text or {}, source
        self._predicate, self._selections = predicate, selections

    @functools.cached_property
    def predicate(self) -> Column:
        own = self._predicate if self._predicate is not None else F.expr(self.text)
        return own if self.source is None else self.source & own

    @functools.cached_property
    def selections(self) -> dict[str, Column]:
        return self._selections if self._selections is not None else {n: F.expr(t) for n, t in self.selection_text.items()}

    @property
    def names(self) -> list[str]:
        return list(self._selections if self._selections is not None else self.selection_text)


def compile_detection(body, resolver: Resolver, leaves: Column) -> Column:
    """A mapping is the AND of its items, a list of mappings their OR, a list of plain values keywords."""
    if isinstance(body, dict):
        return all_of([_item(key, value, resolver, leaves) for key, value in body.items()])
    if isinstance(body, list):
        if all(isinstance(x, (dict, list)) for x in body) and body:
            return any_of([compile_detection(x, resolver, leaves) for x in body])
        if any(isinstance(x, (dict, list)) for x in body):
            raise RuleError("a list mixes mappings and keywords")
        return match_keywords(leaves, body)
    return match_keywords(leaves, [body])


def _item(key: str, value, resolver: Resolver, leaves: Column) -> Column:
    name, *modifiers = key.split("|")
    values = value if isinstance(value, list) else [value]
    if not name:
        return match_keywords(leaves, values, "all" in modifiers)
    block = _BLOCK.match(name)
    if block:
        return _array_block(block[1], block[2], value, modifiers, resolver, leaves)
    return match_field(resolver, name, modifiers, values)


def _array_block(name: str, quantifier: str, body, modifiers: list[str], resolver: Resolver, leaves: Column) -> Column:
    """``any``: a member satisfies the body; ``all``: there are members and all do; ``all_or_empty``: all do,
    or there are none; ``none``: no member does. A single value is an array of one; an absent field has none."""
    found = resolver.find(name)
    if found is None:
        return F.lit(quantifier in ("all_or_empty", "none"))
    members = found.column if found.many else F.when(found.column.isNotNull(), F.array(found.column))

    def test(x: Column) -> Column:
        if isinstance(body, dict) or (isinstance(body, list) and body and isinstance(body[0], dict)):
            inner = resolver.element(found, x) if isinstance(found.type, T.StructType) else Resolver(T.StructType([T.StructField(".", found.type)]), set(), {}, F.struct(x.alias(".")))
            return _element(body, inner, leaves)
        inner = Resolver(T.StructType([T.StructField("value", found.type)]), set(), {}, F.struct(x.alias("value")))
        return match_field(inner, "value", modifiers, body if isinstance(body, list) else [body])

    if quantifier == "any":
        return F.coalesce(F.exists(members, test), F.lit(False))
    if quantifier == "all":
        return F.coalesce((F.size(members) > 0) & F.forall(members, test), F.lit(False))
    if quantifier == "all_or_empty":
        return F.coalesce(F.forall(members, test), F.lit(True))
    return ~F.coalesce(F.exists(members, test), F.lit(False))


def _element(body, inner: Resolver, leaves: Column) -> Column:
    """The body of an array block: fields of the member, or named selections with their own condition."""
    if isinstance(body, dict) and "condition" in body:
        from spanlight.rules.model import parse_condition

        parts = {k: compile_detection(v, inner, leaves) for k, v in body.items() if k != "condition"}
        return condition_column(parse_condition(str(body["condition"])), parts)
    return compile_detection(body, inner, leaves)


def condition_column(tree, selections: dict[str, Column]) -> Column:
    """``all of`` no selection is true, ``1 of`` none false, ``0 of`` true."""
    kind = tree[0]
    if kind == "name":
        return selections[tree[1]]
    if kind == "not":
        return ~condition_column(tree[1], selections)
    if kind == "of":
        parts = [selections[n] for n in selected(list(selections), tree[2])]
        if tree[1] == "all":
            return all_of(parts)
        if tree[1] == 1:
            return any_of(parts)
        return sum((p.cast("int") for p in parts), F.lit(0)) >= tree[1]
    return (all_of if kind == "and" else any_of)([condition_column(x, selections) for x in tree[1]])


def logsource_column(wanted: dict[str, str], of_event: dict[str, Column | str]) -> Column:
    """Only a conflict excludes: a part that both sides state and that differs (``*`` and ``?`` stand for any text)."""
    tests = []
    for part, value in wanted.items():
        own = of_event.get(part)
        if own is None or not value:
            continue
        if isinstance(own, str):
            pattern = re.compile(re.escape(value.lower()).replace(r"\*", ".*").replace(r"\?", ".") + r"\Z")
            tests.append(F.lit(bool(pattern.match(own.lower()))))
        else:
            text = F.nullif(F.lower(F.trim(own)), F.lit(""))
            same = text.rlike("^" + re.escape(value.lower()).replace(r"\*", ".*").replace(r"\?", ".") + r"\z") if "*" in value or "?" in value else text == value.lower()
            tests.append(F.coalesce(same, F.lit(True)))
    return all_of(tests)


def covers(wide: dict[str, str], narrow: dict[str, str]) -> bool:
    """Whether a filter's log source contains a rule's."""
    return all(narrow.get(k, "").lower() == v.lower() for k, v in wide.items() if v)


def filters_for(rule: Rule, filters: list[Filter]) -> list[Filter]:
    return [f for f in filters if (f.rules is None or rule.names() & set(f.rules)) and covers(f.logsource, rule.logsource)]


def compile_rule(rule: Rule, resolver: Resolver, leaves: Column, filters: list[Filter] = (), logsource: dict[str, Column | str] | None = None) -> Compiled:
    """The rule's predicate: its first true condition counts; every applying filter is AND-ed to it."""
    used = set().union(*[condition_names(t, list(rule.detection)) for t in rule.conditions])
    source = logsource_column(rule.logsource, logsource) if logsource and any(rule.logsource.get(k) for k in logsource) else None
    plain = plain_rule(rule, used, filters_for(rule, filters), resolver)
    if plain is not None:
        return Compiled(rule, *plain, source=source)
    selections = {n: compile_detection(body, resolver, leaves) for n, body in rule.detection.items() if n in used}
    predicate = any_of([condition_column(t, selections) for t in rule.conditions])
    for f in filters_for(rule, filters):
        own = {n: compile_detection(body, resolver, leaves) for n, body in f.detection.items()}
        predicate = predicate & any_of([condition_column(t, own) for t in f.conditions])
    return Compiled(rule, predicate=predicate, selections=selections, source=source)


def compile_collection(collection: Collection, schema: T.StructType, json: set[str] = frozenset(), mapping: dict | None = None, logsource: dict | None = None, extend: Callable[[Resolver], Resolver] | None = None) -> list[Compiled]:
    """All usable rules; those that cannot be compiled go to the collection's errors."""
    resolver = Resolver(schema, set(json), mapping or {})
    resolver = extend(resolver) if extend else resolver
    leaves = string_leaves(schema, set(json))
    out = []
    for rule in collection.rules:
        try:
            out.append(compile_rule(rule, resolver, leaves, collection.filters, logsource))
        except RuleError as problem:
            collection.errors.append(f"{rule.title}: {problem}")
    return out


def extract_logsource(schema: T.StructType, fields: dict[str, str], defaults: dict[str, str] | None = None, json: set[str] = frozenset()) -> dict[str, Column]:
    """The log source of each event: part -> its field's value, trimmed; blank or absent ones take the default, if any."""
    resolver, out = Resolver(schema, set(json)), {}
    for part in {**fields, **(defaults or {})}:
        found = resolver.find(fields[part]) if part in fields else None
        own = F.nullif(F.trim(found.column.cast("string")), F.lit("")) if found is not None and not found.many else F.lit(None).cast("string")
        out[part] = F.coalesce(own, F.lit((defaults or {}).get(part)).cast("string"))
    return out
