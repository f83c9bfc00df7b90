"""Checks of rule documents as they are written: form, metadata, detections, correlations, filters, strategy sections.

The checks work on the YAML documents and not on compiled rules, so that a document that cannot be used is checked as well.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from pathlib import Path

import yaml

from spanlight.rules.analysis import ADS_SECTIONS, LEVELS, STATUSES, Finding
from spanlight.rules.match import MODIFIERS, check_modifiers
from spanlight.rules.model import RuleError, condition_names, parse_condition, seconds, yaml_documents

# fixed values: what the public rule format allows
KEYS = "title id name related taxonomy status description license references author date modified tags level logsource detection fields falsepositives scope correlation filter action sigma-version custom_attributes ads".split()
RELATED = {"derived", "obsolete", "merged", "renamed", "similar", "correlation"}
NAMESPACES = {"attack", "car", "cve", "d3fend", "detection", "stp", "tlp"}
CORRELATIONS = {"event_count", "value_count", "value_sum", "value_avg", "value_percentile", "value_median", "temporal", "temporal_ordered"}
OPERATORS = {"gt", "gte", "lt", "lte", "eq", "neq"}
LONGEST = {"title": 256, "description": 65_535, "name": 256, "taxonomy": 256}
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\Z", re.I)
DATE = re.compile(r"\d{4}[-/]\d{2}[-/]\d{2}\Z")
SPAN = re.compile(r"\d+[smhdwMy]\Z")

Said = Iterator[tuple[str, str]]


def lint_text(text: str) -> list[Finding]:
    """All findings of a multi-document YAML text, in order; a text that is no YAML gives one."""
    try:
        documents = [d for d in yaml_documents(text) if d is not None]
    except yaml.YAMLError as problem:
        return [Finding("", "yaml_parse_error", str(problem).splitlines()[0])]
    out: list[Finding] = []
    names = {str(d[k]) for d in documents if isinstance(d, dict) for k in ("id", "name", "title") if d.get(k) is not None}
    seen: dict[str, str] = {}
    for d in documents:
        if not isinstance(d, dict):
            out.append(Finding("", "not_a_mapping", "a document is no mapping"))
            continue
        title = str(d.get("title") or "")
        kind = _correlation if "correlation" in d else _filter if "filter" in d else _detection_rule
        out += [Finding(title, code, message) for check in (_metadata, kind) for code, message in check(d)]
        if "correlation" in d and isinstance(d["correlation"], dict):
            out += [Finding(title, "unknown_rule_reference", f"no rule {r!r}") for r in _list(d["correlation"].get("rules")) if str(r) not in names]
        own = str(d.get("id") or "")
        if own and own in seen:
            out.append(Finding(title, "duplicate_id", f"{seen[own]!r} has the same id"))
        seen.setdefault(own, title)
    return out


def lint_folder(path: str) -> list[Finding]:
    """All findings of the rule files below a folder; a file that cannot be read is one."""
    out: list[Finding] = []
    for file in sorted(p for p in Path(path).rglob("*") if p.suffix in (".yml", ".yaml")):
        try:
            out += lint_text(file.read_text(encoding="utf-8"))
        except (OSError, UnicodeDecodeError) as problem:
            out.append(Finding(file.name, "file_read_error", str(problem)))
    return out


def _list(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [] if value is None else [value]


def _day(value) -> dt.date | None:
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(str(value).replace("/", "-")) if DATE.match(str(value)) else None
    except ValueError:
        return None


def _metadata(d: dict) -> Said:
    if "title" not in d:
        yield "missing_title", "the rule has no title"
    elif not str(d["title"] or "").strip():
        yield "empty_title", "the title is empty"
    for key, most in LONGEST.items():
        if len(str(d.get(key) or "")) > most:
            yield f"{key}_too_long", f"{key} has more than {most} characters"
    for key in ("description", "author"):
        if not d.get(key):
            yield f"missing_{key}", f"the rule has no {key}"
    if "id" in d and not UUID.match(str(d["id"])):
        yield "invalid_id", "the id is no UUID"
    if "status" in d and d["status"] not in STATUSES:
        yield "invalid_status", f"unknown status {d['status']!r}"
    days = {}
    for key, code in (("date", "invalid_date"), ("modified", "invalid_modified")):
        if key in d:
            days[key] = _day(d[key])
            if days[key] is None:
                yield code, f"{key} {d[key]!r} is no day"
    if days.get("date") and days.get("modified") and days["modified"] < days["date"]:
        yield "modified_before_date", "modified lies before date"
    for key in d:
        if str(key) != str(key).lower():
            yield "non_lowercase_key", f"key {key!r}"
        elif key not in KEYS:
            yield "unknown_key", f"key {key!r}"
    related = d.get("related")
    for item in _list(related):
        if not isinstance(item, dict) or not {"id", "type"} <= set(item):
            yield "related_missing_required", "a related rule needs id and type"
            continue
        if item["type"] not in RELATED:
            yield "invalid_related_type", f"type {item['type']!r}"
        if not UUID.match(str(item["id"])):
            yield "invalid_related_id", f"id {item['id']!r}"
    if d.get("status") == "deprecated" and not related:
        yield "deprecated_without_related", "a deprecated rule names what replaces it"
    for key, code in (("tags", "duplicate_tags"), ("references", "duplicate_references"), ("fields", "duplicate_fields")):
        own = [str(x) for x in _list(d.get(key))]
        if len(set(own)) < len(own):
            yield code, f"{key} holds a value twice"
    for tag in map(str, _list(d.get("tags"))):
        if not re.fullmatch(r"[a-z0-9_-]+\.[a-z0-9._-]+", tag):
            yield "invalid_tag", f"tag {tag!r}"
        elif tag.split(".")[0] not in NAMESPACES:
            yield "unknown_tag_namespace", f"tag {tag!r}"
    for key, code in (("falsepositives", "falsepositive_too_short"), ("scope", "scope_too_short")):
        if any(len(str(x)) < 2 for x in _list(d.get(key))):
            yield code, f"an entry of {key} says nothing"
    version = d.get("sigma-version")
    if version is not None and not re.fullmatch(r"[12](\.\d+)*", str(version)):
        yield "unsupported_sigma_version", f"version {version!r}"
    strategy = d.get("ads") or (d.get("custom_attributes") or {}).get("ads") if isinstance(d.get("custom_attributes") or {}, dict) else None
    if isinstance(strategy, dict):
        for section in ADS_SECTIONS:
            if not strategy.get(section):
                yield f"ads_missing_{section}", f"the strategy has no {section}"


def _detection_rule(d: dict) -> Said:
    if "level" not in d:
        yield "missing_level", "the rule has no level"
    elif d["level"] not in LEVELS:
        yield "invalid_level", f"unknown level {d['level']!r}"
    yield from _logsource(d, "missing_logsource")
    if "detection" not in d:
        yield "missing_detection", "the rule detects nothing"
        return
    body = d["detection"]
    if not isinstance(body, dict):
        yield "schema_violation", "detection is no mapping"
        return
    yield from _detection(body, "missing_condition", "empty_detection", d)


def _logsource(d: dict, code: str) -> Said:
    source = d.get("logsource")
    if not source:
        yield code, "there is no log source"
    elif not isinstance(source, dict):
        yield "schema_violation", "logsource is no mapping"
    else:
        for key in ("category", "product", "service"):
            if str(source.get(key) or "") != str(source.get(key) or "").lower():
                yield "logsource_value_not_lowercase", f"{key} {source[key]!r}"


def _detection(body: dict, no_condition: str, empty: str, d: dict) -> Said:
    selections = {k: v for k, v in body.items() if k not in ("condition", "timeframe", "rules")}
    if "condition" not in body:
        yield no_condition, "there is no condition"
    if not selections:
        yield empty, "there is no selection"
    used: set[str] = set()
    for text in map(str, _list(body.get("condition"))):
        if "|" in text:
            yield "deprecated_aggregation_syntax", "an aggregation belongs into a correlation"
            continue
        try:
            used |= condition_names(parse_condition(text), list(selections))
        except RuleError:
            yield "schema_violation", f"the condition {text!r} cannot be read"
            continue
        except KeyError:
            used |= set(selections)
    for name in sorted(used - set(selections)):
        yield "condition_references_unknown", f"no selection {name!r}"
    for name in selections:
        if used and name not in used and not str(name).startswith("_"):
            yield "unused_selection", f"selection {name!r} is not used"
    for name, part in selections.items():
        if part in ({}, [], None):
            yield "empty_selection", f"selection {name!r} is empty"
        yield from _items(part, d)


def _items(part, d: dict) -> Said:
    if isinstance(part, list):
        for x in part:
            yield from _items(x, d)
        return
    if not isinstance(part, dict):
        return
    for key, value in part.items():
        name, *modifiers = str(key).split("|")
        if re.search(r"\[(any|all|all_or_empty|none)\]\Z", name):
            version = str(d.get("sigma-version") or "")
            if not version:
                yield "array_matching_without_version", f"item {key!r} needs a version"
            elif version.startswith("1"):
                yield "sigma_version_mismatch", f"item {key!r} needs version 2"
        if isinstance(value, dict) or (isinstance(value, list) and any(isinstance(x, dict) for x in value)):
            yield from _items(value, d)
            continue
        values = _list(value)
        if isinstance(value, list) and not value:
            yield "empty_value_list", f"item {key!r}"
        if isinstance(value, list) and len(value) > 1 and None in value:
            yield "null_in_value_list", f"item {key!r}"
        if "all" in modifiers and len(values) < 2:
            yield "single_value_all_modifier", f"item {key!r}"
        if "all" in modifiers and "re" in modifiers:
            yield "all_with_re", f"item {key!r}"
        if any(isinstance(x, str) and x and not x.strip("*") for x in values):
            yield "wildcard_only_value", f"item {key!r}: use exists"
        if set(modifiers) <= MODIFIERS:
            try:
                check_modifiers(modifiers)
            except RuleError as problem:
                yield "incompatible_modifiers", f"item {key!r}: {problem}"
        else:
            yield "unknown_modifier", f"item {key!r}"


def _span(value) -> bool:
    try:
        return bool(SPAN.match(str(value))) and seconds(value) > 0
    except (RuleError, ValueError):
        return False


def _correlation(d: dict) -> Said:
    body = d["correlation"]
    if not isinstance(body, dict):
        yield "missing_correlation", "correlation is no mapping"
        return
    if any(k in d for k in ("type", "rules", "timespan", "group-by")):
        yield "flattened_array_correlation", "the correlation's parts belong below correlation"
    kind = body.get("type")
    if kind is None:
        yield "missing_correlation_type", "there is no type"
    elif kind not in CORRELATIONS:
        yield "invalid_correlation_type", f"type {kind!r}"
    if "rules" not in body:
        yield "missing_correlation_rules", "there are no rules"
    elif not body["rules"]:
        yield "empty_correlation_rules", "the list of rules is empty"
    if "timespan" not in body:
        yield "missing_correlation_timespan", "there is no timespan"
    elif not _span(body["timespan"]):
        yield "invalid_timespan_format", f"timespan {body['timespan']!r}"
    window = body.get("window", "sliding")
    if window not in ("sliding", "tumbling", "session"):
        yield "invalid_window_mode", f"window {window!r}"
    if window == "session" and "gap" not in body:
        yield "missing_session_gap", "a session needs a gap"
    if "gap" in body and window != "session":
        yield "gap_without_session", "only sessions have a gap"
    if "gap" in body and not _span(body["gap"]):
        yield "invalid_gap_format", f"gap {body['gap']!r}"
    if "group-by" not in body:
        yield "missing_group_by", "there is no group-by"
    if "generate" in body and not isinstance(body["generate"], bool):
        yield "generate_not_boolean", "generate is true or false"
    condition = body.get("condition")
    if condition is None:
        if not str(kind).startswith("temporal"):
            yield "missing_correlation_condition", "there is no condition"
    elif isinstance(condition, dict):
        if str(kind).startswith("value_") and "field" not in condition:
            yield "missing_condition_field", f"{kind} needs a field"
        for key, value in condition.items():
            if key in OPERATORS and (isinstance(value, bool) or not isinstance(value, (int, float))):
                yield "condition_value_not_numeric", f"{key}: {value!r}"
            elif key not in OPERATORS | {"field", "percentile"}:
                yield "invalid_condition_operator", f"{key!r}"
    if "level" in d and d["level"] not in LEVELS:
        yield "invalid_level", f"unknown level {d['level']!r}"


def _filter(d: dict) -> Said:
    body = d["filter"]
    if not isinstance(body, dict):
        yield "missing_filter", "filter is no mapping"
        return
    if "rules" not in body:
        yield "missing_filter_rules", "there are no rules"
    elif not body["rules"]:
        yield "empty_filter_rules", "the list of rules is empty"
    yield from _detection(body, "missing_filter_condition", "missing_filter_selection", d)
    for key in ("level", "status"):
        if key in d:
            yield f"filter_has_{key}", f"a filter has no {key}"
    yield from _logsource(d, "missing_filter_logsource")
