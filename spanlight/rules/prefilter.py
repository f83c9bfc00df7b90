"""Which rules an event can match at all: one pass of all rules' literals over each field.

From every rule a *need* is derived where that is possible: a set of (field, literal) pairs of which at least one must
occur if the rule matches. All literals of a field become one regular expression in the shape of a trie, so that the cost
of a pass grows with the text and not with the number of rules. Rules without a need are always tried.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlight.rules.fields import Resolver, text_of
from spanlight.rules.match import OPERATORS, PARTS, java_quote, tokens
from spanlight.rules.model import Rule, selected

LEAST = 3  # characters of a literal
KEYWORDS = ""  # the field name that stands for all text values of an event
# letters that other characters fold to; a case-insensitive pattern may match those, so literals of patterns stop at them
_SHARED_CASE = re.compile(r"[^\x00-\x7f]|[iksIKS]")
_FOREIGN = re.compile(r"[^\x00-\x7f]")

Need = frozenset[tuple[str, str]]


def _literal(value: str, piecewise: bool) -> str | None:
    """The longest text that a value's match must hold, in lower case."""
    pieces = [p for p in tokens(value) if isinstance(p, str)]
    stop = _SHARED_CASE if piecewise or len(tokens(value)) > 1 else _FOREIGN
    pieces = [x for p in pieces for x in stop.split(p)]
    best = max((p.lower() for p in pieces), key=len, default="")
    return best if len(best) >= LEAST else None


def _union(needs: list[Need | None]) -> Need | None:
    return None if any(n is None for n in needs) else frozenset().union(*needs)


def _best(needs: list[Need | None]) -> Need | None:
    """The need of an AND: that with the longest shortest literal, then the fewest."""
    known = [n for n in needs if n]
    return max(known, key=lambda n: (min(len(t) for _, t in n), -len(n), sorted(n))) if known else None


def _item_need(key: str, value) -> Need | None:
    name, *modifiers = key.split("|")
    values = value if isinstance(value, list) else [value]
    if "[" in name or not values or not all(isinstance(v, str) for v in values):
        return None
    allowed = {"contains", "startswith", "endswith", "all", "cased"}
    if set(modifiers) - allowed or set(modifiers) & (set(PARTS) | (OPERATORS - allowed)):
        return None
    needs = [frozenset([(name, t)]) if (t := _literal(v, not name)) else None for v in values]
    return _best(needs) if "all" in modifiers else _union(needs)


def _body_need(body) -> Need | None:
    if isinstance(body, dict):
        return _best([_item_need(k, v) for k, v in body.items()])
    if isinstance(body, list):
        if body and all(isinstance(x, (dict, list)) for x in body):
            return _union([_body_need(x) for x in body])
        return _item_need("", body)
    return _item_need("", body)


def _condition_need(tree, selections: dict[str, Need | None]) -> Need | None:
    kind = tree[0]
    if kind == "name":
        return selections[tree[1]]
    if kind == "not":
        return None
    if kind == "of":
        parts = [selections[n] for n in selected(list(selections), tree[2])]
        if not parts or tree[1] == 0:
            return None
        return _best(parts) if tree[1] == "all" else _union(parts)
    parts = [_condition_need(x, selections) for x in tree[1]]
    return _best(parts) if kind == "and" else _union(parts)


def rule_need(rule: Rule) -> Need | None:
    """What an event must hold for the rule to match; None if nothing can be said."""
    selections = {n: _body_need(b) for n, b in rule.detection.items()}
    return _union([_condition_need(t, selections) for t in rule.conditions])


def trie_pattern(literals: list[str]) -> str:
    """A regular expression of the longest of the literals at a place, each letter read once."""
    root: dict = {}
    for text in literals:
        node = root
        for c in text:
            node = node.setdefault(c, {})
        node[""] = {}

    out: dict[int, str] = {}
    stack = [(root, False)]
    while stack:  # children before their parents; literals may be long
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack += [(child, False) for c, child in node.items() if c]
            continue
        arms = sorted(java_quote(c) + out[id(child)] for c, child in node.items() if c)
        if not arms:
            out[id(node)] = ""
        elif len(arms) == 1 and "" not in node:
            out[id(node)] = arms[0]
        else:
            out[id(node)] = "(?:" + "|".join(arms) + ")" + ("?" if "" in node else "")
    return out[id(root)]


@dataclass
class Prefilter:
    """``hits``: the event's candidate groups (array<int>, null if there are none); ``group_of``: each rule's group, -1 for
    those that are always tried."""

    hits: Column | None
    group_of: list[int]
    groups: int


def prefilter(rules: list[Rule], resolver: Resolver, leaves: Column, size: int) -> Prefilter:
    """Rules with a need in groups of ``size``, rules of like needs together; an event's candidate groups from the literals in it."""
    needs = [rule_need(r) for r in rules]
    order = sorted((i for i, n in enumerate(needs) if n), key=lambda i: sorted(needs[i]))
    group_of = [-1] * len(rules)
    for place, i in enumerate(order):
        group_of[i] = place // size
    if not order:
        return Prefilter(None, group_of, 0)
    wanted: dict[str, dict[str, set[int]]] = {}
    for i in order:
        for name, literal in needs[i]:
            wanted.setdefault(name, {}).setdefault(literal, set()).add(group_of[i])
    found_groups = []
    for name, literals in sorted(wanted.items()):
        text = F.concat_ws("\n", leaves) if name == KEYWORDS else _field_text(resolver, name)
        if text is None:
            continue
        # the first letters once more as a class: most places of a text are dismissed by one look
        first = "".join(sorted({java_quote(t[0]) for t in literals}))
        pattern = f"(?=[{first}])(?=({trie_pattern(list(literals))}))"
        lookup = {}
        for literal in literals:  # a longer literal at a place hides those that it begins with
            mine = set().union(*[literals[literal[:n]] for n in range(1, len(literal) + 1) if literal[:n] in literals])
            lookup[literal] = sorted(mine)
        pairs = F.from_json(F.lit(json.dumps(lookup)), "map<string,array<int>>")
        matched = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))
        found_groups.append(_looked_up(F.coalesce(matched, F.array().cast("array<string>")), pairs))
    if not found_groups:
        return Prefilter(F.array().cast("array<int>"), group_of, (len(order) + size - 1) // size)
    return Prefilter(F.concat(*found_groups), group_of, (len(order) + size - 1) // size)


def _looked_up(found: Column, pairs: Column) -> Column:
    return F.flatten(F.transform(found, lambda literal: F.element_at(pairs, literal)))


def _field_text(resolver: Resolver, name: str) -> Column | None:
    found = resolver.find(name)
    if found is None:
        return None
    if found.many:
        return F.concat_ws("\n", F.transform(found.column, lambda x: text_of(x, found.type)))
    return text_of(found.column, found.type)
