"""Plain rules as SQL text: those whose items compare text columns with literal values.

The text says exactly what :mod:`spanlight.rules.match` builds from Columns. Building Columns one call at a time is
what takes longest with thousands of rules; a text is parsed in one go. Everything that is not plain gives None.
"""

from __future__ import annotations

from pyspark.sql import types as T

from spanlight.rules.fields import Resolver
from spanlight.rules.match import tokens, wildcard_regex
from spanlight.rules.model import Filter, Rule, selected

PLAIN = {"contains", "startswith", "endswith", "all", "cased"}


def literal(text: str) -> str:
    """A text as SQL literal, whatever the parser makes of backslashes."""
    if "\\" in text or "'" in text:
        return f"decode(X'{text.encode().hex()}', 'UTF-8')"
    return f"'{text}'"


def _column(name: str, resolver: Resolver) -> str | None:
    target = resolver.mapping.get(name, name)
    if resolver.base is not None or not isinstance(target, str) or target not in resolver.schema.fieldNames() or "`" in target:
        return None
    return f"`{target}`" if isinstance(resolver.schema[target].dataType, T.StringType) else None


def _value(op: str, value: str, cased: bool, column: str) -> str:
    parts = tokens(value)
    if op == "contains":
        parts = [p for i, p in enumerate(parts) if p != 0 or 0 < i < len(parts) - 1]
    elif op == "startswith" and parts and parts[-1] == 0:
        parts = parts[:-1]
    elif op == "endswith" and parts and parts[0] == 0:
        parts = parts[1:]
    texts = [p for p in parts if isinstance(p, str)]
    if op == "exact" and len(parts) > 1 and len(texts) == 1 and 1 not in parts and all(isinstance(p, str) or i in (0, len(parts) - 1) for i, p in enumerate(parts)):
        op, parts = ("startswith" if parts[0] != 0 else "endswith" if parts[-1] != 0 else "contains"), texts
    if not parts or parts == [0]:
        return f"{column} IS NOT NULL"
    if len(parts) > 1 or not texts:
        pattern = wildcard_regex(parts, cased, op in ("exact", "startswith"), op in ("exact", "endswith"))
        return f"coalesce(rlike({column}, {literal(pattern)}), false)"
    needle = literal(texts[0] if cased else texts[0].lower())
    text = column if cased else f"lower({column})"
    return f"coalesce({text} = {needle}, false)" if op == "exact" else f"coalesce({op}({text}, {needle}), false)"


def _item(key: str, value, resolver: Resolver) -> str | None:
    name, *modifiers = key.split("|")
    values = value if isinstance(value, list) else [value]
    operators = [m for m in modifiers if m not in ("all", "cased")]
    if not name or "[" in name or set(modifiers) - PLAIN or len(operators) > 1 or not values or not all(isinstance(v, str) for v in values):
        return None
    if "all" in modifiers and len(values) < 2:
        return None
    column = _column(name, resolver)
    if column is None:
        return None
    op, cased = operators[0] if operators else "exact", "cased" in modifiers
    if op == "exact" and "all" not in modifiers and len(values) > 1 and not any(c in v for v in values for c in "*?\\"):
        listed = ", ".join(literal(v if cased else v.lower()) for v in values)
        return f"coalesce({column if cased else f'lower({column})'} IN ({listed}), false)"
    return _joined([_value(op, v, cased, column) for v in values], " AND " if "all" in modifiers else " OR ")


def _joined(parts: list[str], word: str) -> str:
    return parts[0] if len(parts) == 1 else "(" + word.join(parts) + ")"


def _body(body, resolver: Resolver) -> str | None:
    if isinstance(body, dict) and body:
        parts = [_item(k, v, resolver) for k, v in body.items()]
        return None if any(p is None for p in parts) else _joined(parts, " AND ")
    if isinstance(body, list) and body and all(isinstance(x, dict) for x in body):
        parts = [_body(x, resolver) for x in body]
        return None if any(p is None for p in parts) else _joined(parts, " OR ")
    return None


def _condition(tree, selections: dict[str, str]) -> str | None:
    kind = tree[0]
    if kind == "name":
        return selections[tree[1]]
    if kind == "not":
        inner = _condition(tree[1], selections)
        return None if inner is None else f"(NOT {inner})"
    if kind == "of":
        parts = [selections[n] for n in selected(list(selections), tree[2])]
        if not parts or tree[1] not in ("all", 1):
            return None
        return _joined(parts, " AND " if tree[1] == "all" else " OR ")
    parts = [_condition(x, selections) for x in tree[1]]
    return None if any(p is None for p in parts) else _joined(parts, " AND " if kind == "and" else " OR ")


def _whole(detection: dict, conditions: list, used: set[str], resolver: Resolver) -> tuple[str, dict[str, str]] | None:
    selections = {n: _body(b, resolver) for n, b in detection.items() if n in used}
    if not selections or any(t is None for t in selections.values()):
        return None
    parts = [_condition(t, selections) for t in conditions]
    return None if any(p is None for p in parts) else (_joined(parts, " OR "), selections)


def plain_rule(rule: Rule, used: set[str], filters: list[Filter], resolver: Resolver) -> tuple[str, dict[str, str]] | None:
    """The rule's predicate, with its filters, and its selections; None if any of them is not plain."""
    own = _whole(rule.detection, rule.conditions, used, resolver)
    if own is None:
        return None
    parts = [own[0]]
    for f in filters:
        other = _whole(f.detection, f.conditions, set(f.detection), resolver)
        if other is None:
            return None
        parts.append(other[0])
    return _joined(parts, " AND "), own[1]
