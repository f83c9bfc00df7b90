"""Rules, correlations and filters as read from YAML, and the condition language."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


class RuleError(ValueError):
    """A rule that cannot be used; collected beside the usable ones."""


@dataclass
class Rule:
    title: str
    detection: dict[str, Any]
    conditions: list
    id: str | None = None
    name: str | None = None
    level: str | None = None
    status: str | None = None
    tags: list[str] = field(default_factory=list)
    logsource: dict[str, str] = field(default_factory=dict)
    fields: list[str] = field(default_factory=list)
    attributes: dict[str, Any] = field(default_factory=dict)
    raw: dict[str, Any] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return self.id or self.name or self.title

    def names(self) -> set[str]:
        return {x for x in (self.id, self.name, self.title) if x}


@dataclass
class Correlation:
    title: str
    type: str
    rules: list[str]
    timespan: int
    group_by: list[str] = field(default_factory=list)
    window: str = "sliding"
    gap: int | None = None
    predicates: list[tuple[str, float]] = field(default_factory=list)
    expression: Any = None
    fields: list[str] = field(default_factory=list)
    percentile: float = 50.0
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)
    id: str | None = None
    name: str | None = None
    level: str | None = None
    tags: list[str] = field(default_factory=list)
    generate: bool = False
    suppress: int | None = None
    action: str = "alert"
    attributes: dict[str, Any] = field(default_factory=dict)

    @property
    def key(self) -> str:
        return self.id or self.name or self.title


@dataclass
class Filter:
    title: str
    rules: list[str] | None  # None = any rule
    detection: dict[str, Any]
    conditions: list
    logsource: dict[str, str] = field(default_factory=dict)


@dataclass
class Collection:
    rules: list[Rule] = field(default_factory=list)
    correlations: list[Correlation] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def rule(self, reference: str) -> Rule:
        """A rule by id, name or title: all three lead to the same rule."""
        for attribute in ("id", "name", "title"):
            for rule in self.rules:
                if getattr(rule, attribute) == reference:
                    return rule
        raise RuleError(f"no rule {reference!r}")


# -- time spans -------------------------------------------------------------------------------------------
# fixed values: seconds of the units (mean months and years)
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "M": 2_629_746, "y": 31_556_952}


def seconds(span: str | int) -> int:
    match = re.fullmatch(r"(\d+)\s*([smhdwMy])?", str(span).strip())
    if not match:
        raise RuleError(f"no time span: {span!r}")
    return int(match[1]) * UNITS[match[2] or "s"]


# -- conditions -------------------------------------------------------------------------------------------
_WORDS = re.compile(r"\(|\)|[^\s()]+")


def parse_condition(text: str):
    """``('and'|'or', [..])``, ``('not', x)``, ``('name', n)`` or ``('of', quantifier, pattern)``.

    NOT binds tighter than AND, AND tighter than OR. Quantifiers: a number, ``any`` (1) and ``all``.
    """
    words = _WORDS.findall(text)
    at = 0

    def peek() -> str | None:
        return words[at].lower() if at < len(words) else None

    def either():
        nonlocal at
        parts = [both()]
        while peek() == "or":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def both():
        nonlocal at
        parts = [single()]
        while peek() == "and":
            at += 1
            parts.append(single())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def single():
        nonlocal at
        word = peek()
        if word is None or word in ("and", "or", ")"):
            raise RuleError(f"incomplete condition: {text!r}")
        at += 1
        if word == "not":
            return ("not", single())
        if word == "(":
            inner = either()
            if peek() != ")":
                raise RuleError(f"unbalanced condition: {text!r}")
            at += 1
            return inner
        if peek() == "of" and (word.isdigit() or word in ("any", "all")):
            at += 1
            if at >= len(words):
                raise RuleError(f"incomplete condition: {text!r}")
            pattern = words[at]
            at += 1
            return ("of", "all" if word == "all" else 1 if word == "any" else int(word), pattern)
        return ("name", words[at - 1])

    tree = either()
    if at != len(words):
        raise RuleError(f"unexpected {words[at]!r} in condition {text!r}")
    return tree


def selected(names: list[str], pattern: str) -> list[str]:
    """The selections a pattern means; ``them`` hides those that start with an underscore."""
    if pattern == "them":
        return [n for n in names if not n.startswith("_")]
    expression = re.compile(re.escape(pattern).replace(r"\*", ".*") + r"\Z")
    return [n for n in names if expression.match(n)]


def condition_names(tree, names: list[str]) -> set[str]:
    """All selections that a condition mentions."""
    kind = tree[0]
    if kind == "name":
        return {tree[1]}
    if kind == "of":
        return set(selected(names, tree[2]))
    if kind == "not":
        return condition_names(tree[1], names)
    return set().union(*[condition_names(x, names) for x in tree[1]])


# -- reading ----------------------------------------------------------------------------------------------
_RULE_KEYS = {"title", "id", "name", "level", "status", "tags", "logsource", "detection", "fields", "description", "author", "date", "modified", "references", "falsepositives", "related", "license", "scope", "taxonomy", "correlation", "filter", "action", "sigma-version", "custom_attributes"}


def _merge(base: dict, over: dict) -> dict:
    out = dict(base)
    for key, value in over.items():
        out[key] = _merge(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def _detection(raw: dict) -> tuple[dict, list]:
    if not isinstance(raw, dict) or "condition" not in raw:
        raise RuleError("a detection needs a condition")
    condition = raw["condition"]
    trees = [parse_condition(str(c)) for c in (condition if isinstance(condition, list) else [condition])]
    parts = {k: v for k, v in raw.items() if k not in ("condition", "timeframe")}
    for tree in trees:
        for name in condition_names(tree, list(parts)):
            if name not in parts:
                raise RuleError(f"the condition mentions an unknown selection: {name}")
    return parts, trees


def _correlation(doc: dict) -> Correlation:
    body = doc["correlation"]
    kind = body.get("type")
    if kind not in ("event_count", "value_count", "value_sum", "value_avg", "value_percentile", "value_median", "temporal", "temporal_ordered"):
        raise RuleError(f"unknown correlation type {kind!r}")
    rules = body.get("rules") or []
    rules = [rules] if isinstance(rules, str) else [str(r) for r in rules]
    if not rules or "timespan" not in body:
        raise RuleError("a correlation needs rules and a timespan")
    condition = body.get("condition")
    predicates, expression, names, percentile = [], None, [], 50.0
    if isinstance(condition, str):
        expression = parse_condition(condition)
    elif isinstance(condition, dict):
        for key, value in condition.items():
            if key == "field":
                names = [value] if isinstance(value, str) else list(value)
            elif key == "percentile":
                percentile = float(value)
            elif key in ("gt", "gte", "lt", "lte", "eq", "neq"):
                predicates.append((key, float(value)))
            else:
                raise RuleError(f"unknown condition key {key!r}")
    if kind.startswith("temporal") and not predicates and expression is None:
        predicates = [("gte", 1.0)]  # without a condition any of the rules fires
    if kind.startswith("value_") and not names:
        raise RuleError(f"{kind} needs a field")
    if kind in ("value_sum", "value_avg", "value_percentile", "value_median") and len(names) > 1:
        raise RuleError(f"{kind} takes one field")
    group = body.get("group-by") or []
    attributes = doc.get("custom_attributes") or {}
    return Correlation(
        doc.get("title") or "", kind, rules, seconds(body["timespan"]), [group] if isinstance(group, str) else list(group),
        body.get("window", "sliding"), seconds(body["gap"]) if "gap" in body else None, predicates, expression, names, percentile,
        body.get("aliases") or {}, doc.get("id"), doc.get("name"), doc.get("level"), doc.get("tags") or [], bool(body.get("generate", False)),
        seconds(attributes["suppress"]) if attributes.get("suppress") else None, attributes.get("action", "alert"), attributes,
    )


def _plain(doc: dict) -> dict:
    """The document with its title, id, name, level, status and tags as text: YAML reads ``id: 1`` as a number."""
    texts = {k: str(doc[k]) for k in ("title", "id", "name", "level", "status") if isinstance(doc.get(k), (bool, int, float, dt.date))}
    tags = doc.get("tags")
    return doc | texts | ({"tags": [str(t) for t in tags]} if isinstance(tags, list) else {"tags": [str(tags)]} if tags else {})


def read_document(doc: dict) -> Rule | Correlation | Filter:
    doc = _plain(doc)
    if "correlation" in doc:
        return _correlation(doc)
    if "filter" in doc:
        body = doc["filter"]
        parts, trees = _detection({k: v for k, v in body.items() if k != "rules"})
        rules = body.get("rules")
        return Filter(doc.get("title") or "", None if rules in (None, "any") else [rules] if isinstance(rules, str) else list(rules), parts, trees, doc.get("logsource") or {})
    if "detection" not in doc:
        raise RuleError("no detection, correlation or filter")
    parts, trees = _detection(doc["detection"])
    return Rule(
        doc.get("title") or "", parts, trees, doc.get("id"), doc.get("name"), doc.get("level"), doc.get("status"), doc.get("tags") or [],
        {k: str(v) for k, v in (doc.get("logsource") or {}).items() if k != "definition"}, doc.get("fields") or [],
        (doc.get("custom_attributes") or {}) | {k: v for k, v in doc.items() if k not in _RULE_KEYS}, doc,
    )


class _Loader(yaml.SafeLoader):
    """YAML in which days stay texts, so that one that does not exist spoils no document."""


_Loader.yaml_implicit_resolvers = {c: [(tag, r) for tag, r in rules if tag != "tag:yaml.org,2002:timestamp"] for c, rules in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def yaml_documents(text: str) -> list:
    return list(yaml.load_all(text, _Loader))  # noqa: S506 - a safe loader


def load_rules(text: str) -> Collection:
    """Read multi-document YAML; ``action: global`` merges into the following documents, ``reset`` ends that,
    ``repeat`` merges into the document before. Documents that cannot be used are collected as errors."""
    out = Collection()
    shared: dict = {}
    last: dict = {}
    try:
        documents = yaml_documents(text)
    except yaml.YAMLError as problem:
        out.errors.append(str(problem))
        return out
    for doc in documents:
        if not isinstance(doc, dict):
            if doc is not None:
                out.errors.append("a document is no mapping")
            continue
        action = doc.get("action")
        doc = {k: v for k, v in doc.items() if k != "action"}
        if action == "global":
            shared = _merge(shared, doc)
            continue
        if action == "reset":
            shared = {}
            if not doc:
                continue
        doc = _merge(last if action == "repeat" else shared, doc)
        last = doc
        try:
            item = read_document(doc)
        except (RuleError, TypeError, AttributeError) as problem:
            out.errors.append(f"{doc.get('title', '?')}: {problem}")
            continue
        (out.rules if isinstance(item, Rule) else out.correlations if isinstance(item, Correlation) else out.filters).append(item)
    return out


def load_folder(path: str) -> Collection:
    """All ``.yml`` and ``.yaml`` files below a folder, or one file."""
    root = Path(path)
    files = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.suffix in (".yml", ".yaml"))
    out = Collection()
    for file in files:
        part = load_rules(file.read_text(encoding="utf-8"))
        out.rules += part.rules
        out.correlations += part.correlations
        out.filters += part.filters
        out.errors += [f"{file.name}: {e}" for e in part.errors]
    return out
