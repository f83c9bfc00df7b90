"""Query strings (``field:value AND (a:1 OR NOT b:[1 TO 5])``) as rules, and rules as YAML and SQL text."""

from __future__ import annotations

import re

import yaml

from spanlight.rules.match import tokens
from spanlight.rules.model import Collection, Correlation, Rule, RuleError, load_rules, parse_condition, selected

_WORD = re.compile(r'\s*(?:(?P<par>[()])|(?P<op>AND\b|OR\b|NOT\b|&&|\|\||!)|(?P<field>[\w.@\-]+):(?P<value>\((?:[^()]*)\)|"(?:[^"\\]|\\.)*"|/(?:[^/\\]|\\.)*/|[\[{][^\]}]*[\]}]|(?:>=|<=|>|<)[^\s()]+|[^\s()]+)|(?P<text>"(?:[^"\\]|\\.)*"|[^\s()]+))')


def from_query(text: str, title: str = "query") -> Rule:
    """A rule for a query string: terms, phrases, wildcards, ``/regex/``, ranges, ``_exists_:f``, value groups, and
    AND, OR, NOT with parentheses (terms side by side are OR)."""
    words, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _WORD.match(text, at)
        if not m:
            raise RuleError(f"unexpected text at {at}")
        words.append(m)
        at = m.end()
    selections: dict[str, object] = {}
    at = 0

    def op(i: int) -> str | None:
        if i >= len(words):
            return None
        m = words[i]
        return {"&&": "AND", "||": "OR", "!": "NOT"}.get(m["op"], m["op"]) if m["op"] else m["par"]

    def name(body) -> str:
        key = f"s{len(selections)}"
        selections[key] = body
        return key

    def either() -> str:
        nonlocal at
        parts = [both()]
        while at < len(words) and op(at) != ")":
            if op(at) == "OR":
                at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else "(" + " or ".join(parts) + ")"

    def both() -> str:
        nonlocal at
        parts = [single()]
        while op(at) == "AND":
            at += 1
            parts.append(single())
        return parts[0] if len(parts) == 1 else "(" + " and ".join(parts) + ")"

    def single() -> str:
        nonlocal at
        if at >= len(words):
            raise RuleError("the query ends too early")
        if op(at) == "NOT":
            at += 1
            return f"not {single()}"
        if op(at) == "(":
            at += 1
            inner = either()
            if op(at) != ")":
                raise RuleError("unbalanced query")
            at += 1
            return inner
        m = words[at]
        at += 1
        if m["field"]:
            return name(_term(m["field"], m["value"]))
        if m["op"] or m["par"]:
            raise RuleError(f"unexpected {m[0]!r}")
        return name([m["text"].strip('"')])

    condition = either()
    if at != len(words):
        raise RuleError("unbalanced query")
    raw = {"title": title, "detection": {**selections, "condition": condition}}
    return Rule(title, selections, [parse_condition(condition)], raw=raw)


def _scalar(text: str):
    if text[:1] == '"':
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return int(text) if re.fullmatch(r"-?\d+", text) else float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def _term(field: str, value: str) -> dict:
    if field == "_exists_":
        return {f"{value}|exists": True}
    if value[0] == "(":
        return {field: [_scalar(v) for v in re.findall(r'"(?:[^"\\]|\\.)*"|[^\s]+', value[1:-1]) if v not in ("OR", "||")]}
    if value[0] == "/":
        return {f"{field}|re": value[1:-1]}
    if value[0] in "[{":
        low, _, high = value[1:-1].partition(" TO ")
        out = {}
        if low.strip() != "*":
            out[f"{field}|{'gte' if value[0] == '[' else 'gt'}"] = _scalar(low.strip())
        if high.strip() != "*":
            out[f"{field}|{'lte' if value[-1] == ']' else 'lt'}"] = _scalar(high.strip())
        return out
    if m := re.match(r"(>=|<=|>|<)(.+)", value):
        return {f"{field}|" + {">=": "gte", "<=": "lte", ">": "gt", "<": "lt"}[m[1]]: _scalar(m[2])}
    return {field: _scalar(value)}


def to_yaml(rule: Rule) -> str:
    """A rule as YAML."""
    doc = {k: v for k, v in (("title", rule.title), ("id", rule.id), ("status", rule.status), ("level", rule.level), ("tags", rule.tags or None), ("logsource", rule.logsource or None)) if v is not None}
    conditions = [condition_text(t) for t in rule.conditions]
    doc["detection"] = {**rule.detection, "condition": conditions[0] if len(conditions) == 1 else conditions}
    return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)


def condition_text(tree) -> str:
    kind = tree[0]
    if kind == "name":
        return tree[1]
    if kind == "not":
        return f"not {condition_text(tree[1])}"
    if kind == "of":
        return f"{tree[1]} of {tree[2]}"
    return "(" + f" {kind} ".join(condition_text(x) for x in tree[1]) + ")"


# -- SQL text ---------------------------------------------------------------------------------------------
def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _like(parts: list) -> str:
    return "".join("%" if p == 0 else "_" if p == 1 else re.sub(r"([%_\\])", r"\\\1", p) for p in parts)


def _sql_item(key: str, value) -> str:
    field, *modifiers = key.split("|")
    column = "`" + field.replace("`", "``") + "`" if "." not in field else ".".join(f"`{p}`" for p in field.split("."))
    values = value if isinstance(value, list) else [value]
    parts = [_sql_value(column, modifiers, v) for v in values]
    joined = parts[0] if len(parts) == 1 else "(" + (" AND " if "all" in modifiers else " OR ").join(parts) + ")"
    return f"({column} IS NOT NULL AND NOT coalesce({joined}, false))" if "neq" in modifiers else f"coalesce({joined}, false)"


def _sql_value(column: str, modifiers: list[str], value) -> str:
    compare = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
    for m in modifiers:
        if m in compare:
            return f"try_cast({column} AS double) {compare[m]} {value}"
    if "exists" in modifiers:
        return f"{column} IS {'NOT ' if value else ''}NULL"
    if "re" in modifiers:
        return f"{column} RLIKE {_quote(('(?iu)' if 'i' in modifiers else '') + str(value))}"
    if "fieldref" in modifiers:
        return f"lower({column}) = lower(`{value}`)"
    if value is None:
        return f"{column} IS NULL"
    if isinstance(value, bool):
        return f"lower(CAST({column} AS string)) IN ({', '.join(map(_quote, ['true', '1', 'yes'] if value else ['false', '0', 'no']))})"
    if isinstance(value, (int, float)):
        return f"try_cast({column} AS double) = {value}"
    unknown = set(modifiers) - {"contains", "startswith", "endswith", "cased", "all", "neq"}
    if unknown:
        raise RuleError(f"no SQL text for {sorted(unknown)}")
    parts = tokens(value)
    pattern = ("%" if {"contains", "endswith"} & set(modifiers) else "") + _like(parts) + ("%" if {"contains", "startswith"} & set(modifiers) else "")
    return f"CAST({column} AS string) {'LIKE' if 'cased' in modifiers else 'ILIKE'} {_quote(pattern)}"


def _sql_body(body) -> str:
    if isinstance(body, dict):
        return "(" + " AND ".join(_sql_item(k, v) for k, v in body.items()) + ")"
    if isinstance(body, list) and all(isinstance(x, dict) for x in body):
        return "(" + " OR ".join(_sql_body(x) for x in body) + ")"
    raise RuleError("keywords have no SQL text")


def to_sql(rule: Rule, source: str, select: str = "*", form: str = "default") -> str:
    """A Spark SQL query (or, with ``form`` 'view', a view) equal to the rule."""
    parts = {n: _sql_body(b) for n, b in rule.detection.items()}

    def walk(tree) -> str:
        kind = tree[0]
        if kind == "name":
            return parts[tree[1]]
        if kind == "not":
            return f"NOT {walk(tree[1])}"
        if kind == "of":
            own = [parts[n] for n in selected(list(parts), tree[2])]
            if tree[1] == "all":
                return "(" + (" AND ".join(own) or "true") + ")"
            return "(" + (" + ".join(f"CAST({p} AS int)" for p in own) or "0") + f" >= {tree[1]})"
        return "(" + f" {kind.upper()} ".join(walk(x) for x in tree[1]) + ")"

    columns = ", ".join(rule.fields) if rule.fields and select == "*" else select
    query = f"SELECT {columns} FROM {source} WHERE " + " OR ".join(walk(t) for t in rule.conditions)
    return f"CREATE OR REPLACE TEMPORARY VIEW `{rule.key}` AS {query}" if form == "view" else query


AGGREGATES = {
    "event_count": "count(*){over}", "value_count": "size(collect_set({field}){over})", "value_sum": "coalesce(sum({field}){over}, 0)",
    "value_avg": "coalesce(avg({field}){over}, 0)", "value_percentile": "percentile({field}, {share}){over}", "value_median": "percentile({field}, 0.5){over}",
    "temporal": "size(collect_set(rule_name){over})",
}
SIGNS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "neq": "<>"}


def correlation_to_sql(collection: Collection, correlation: Correlation, source: str | dict[str, str], time: str) -> str:
    """A Spark SQL query for a correlation: the union of its rules' matches, then a range window (sliding), a bucket
    (tumbling), or gap-cut runs (session). ``source`` is a table, or the table of each rule. ``time`` is a timestamp
    column. Temporal correlations give the first and last time seen in buckets and sessions. Unlike the engine it counts events of the same
    second that come later, and a session's cap filters instead of splitting."""
    if correlation.type not in AGGREGATES or correlation.expression is not None:
        raise RuleError(f"no SQL text for {correlation.type}")
    fields = [correlation.aliases.get(g, {}) for g in correlation.group_by]
    legs = []
    for reference in correlation.rules:
        rule = collection.rule(reference)
        keys = [f"`{own.get(reference, g)}` AS `{g}`" for g, own in zip(correlation.group_by, fields, strict=True)]
        value = [f"`{f}`" for f in correlation.fields]
        columns = ", ".join([f"{_quote(reference)} AS rule_name", f"unix_seconds(CAST({time} AS timestamp)) AS ts", *keys, *value])
        legs.append(to_sql(Rule(rule.title, rule.detection, rule.conditions), source if isinstance(source, str) else source[reference], columns))
    by = ", ".join(f"`{g}`" for g in correlation.group_by)
    field = f"`{correlation.fields[0]}`" if correlation.fields else "1"
    span, share = correlation.timespan, correlation.percentile / 100
    test = " AND ".join(f"value {SIGNS[op]} {n:g}" for op, n in correlation.predicates) or "true"
    aggregate = AGGREGATES[correlation.type]
    head = "WITH matched AS (" + " UNION ALL ".join(legs) + ")"
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    if correlation.window == "tumbling":
        value = aggregate.format(over="", field=field, share=share)
        seen = ", min(ts) AS first_seen, max(ts) AS last_seen" if correlation.type == "temporal" else ""
        return f"{head} SELECT * FROM (SELECT {lead}ts div {span} * {span} AS start_s, {value} AS value{seen} FROM matched GROUP BY {lead}ts div {span} * {span}) WHERE {test}"
    if correlation.window == "session":
        gap = correlation.gap if correlation.gap is not None else span
        value = aggregate.format(over="", field=field, share=share)
        return (
            f"{head}, cut AS (SELECT *, CASE WHEN ts - lag(ts) OVER ({part}ORDER BY ts) > {gap} THEN 1 ELSE 0 END AS fresh FROM matched), "
            f"run AS (SELECT *, sum(fresh) OVER ({part}ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM cut) "
            f"SELECT * FROM (SELECT {lead}min(ts) AS start_s, max(ts) AS end_s, {value} AS value FROM run GROUP BY {lead}session) WHERE {test} AND end_s - start_s <= {span}"
        )
    value = aggregate.format(over=f" OVER ({part}ORDER BY ts RANGE BETWEEN {span} PRECEDING AND CURRENT ROW)", field=field, share=share)
    return f"{head} SELECT * FROM (SELECT rule_name, {lead}ts, {value} AS value FROM matched) WHERE {test}"


def convert(collection: Collection, source: str) -> tuple[list[str], list[str]]:
    """SQL of all rules, and what could not be converted."""
    done, failed = [], []
    for rule in collection.rules:
        try:
            done.append(to_sql(rule, source))
        except RuleError as problem:
            failed.append(f"{rule.title}: {problem}")
    return done, failed


def roundtrip(rule: Rule) -> Rule:
    return load_rules(to_yaml(rule)).rules[0]
