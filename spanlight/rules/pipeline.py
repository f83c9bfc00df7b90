"""Processing pipelines: rewrites of rules before they are compiled, described in YAML.

All of it is work on rules, which are few; it runs on the driver.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import yaml

from spanlight.rules.model import Correlation, Rule, RuleError


class Dropped(Exception):
    """A detection item that a pipeline removes."""


@dataclass
class State:
    """What the steps of a pipeline know: variables, state set by earlier steps, ids of steps already applied."""

    vars: dict[str, Any] = field(default_factory=dict)
    values: dict[str, Any] = field(default_factory=dict)
    applied: set[str] = field(default_factory=set)


@dataclass
class Step:
    type: str
    options: dict[str, Any]
    id: str | None = None
    rule_conditions: list[dict] = field(default_factory=list)
    rule_linking: str = "and"
    rule_negated: bool = False
    item_conditions: list[dict] = field(default_factory=list)
    field_conditions: list[dict] = field(default_factory=list)


@dataclass
class Pipeline:
    name: str
    priority: int = 0
    steps: list[Step] = field(default_factory=list)
    vars: dict[str, Any] = field(default_factory=dict)
    finalizers: list[dict] = field(default_factory=list)


RULE_STEPS = {"add_condition", "change_logsource", "rule_failure", "set_state", "add_field", "remove_field", "set_field", "set_custom_attribute", "nest", "include"}
ITEM_STEPS = {
    "field_name_mapping", "field_name_prefix_mapping", "field_name_prefix", "field_name_suffix", "field_name_transform", "drop_detection_item", "replace_string",
    "value_placeholders", "wildcard_placeholders", "query_expression_placeholders", "detection_item_failure", "hashes_fields", "map_string", "set_value",
    "convert_type", "regex", "case_transformation",
}


def load_pipeline(text: str, expand: Callable[[Any], Any] = lambda x: x) -> Pipeline:
    """``expand`` replaces references to side inputs before the steps are read."""
    doc = expand(yaml.safe_load(text))
    steps = [_step(t) for t in doc.get("transformations") or []]
    return Pipeline(doc.get("name", ""), int(doc.get("priority", 0)), steps, doc.get("vars") or {}, doc.get("finalizers") or [])


def _step(raw: dict) -> Step:
    known = {"type", "id", "rule_conditions", "rule_cond_op", "rule_cond_not", "detection_item_conditions", "field_name_conditions"}
    kind = raw["type"]
    if kind not in RULE_STEPS | ITEM_STEPS:
        raise RuleError(f"unknown transformation {kind!r}")
    return Step(kind, {k: v for k, v in raw.items() if k not in known}, raw.get("id"), raw.get("rule_conditions") or [], raw.get("rule_cond_op", "and"), bool(raw.get("rule_cond_not")), raw.get("detection_item_conditions") or [], raw.get("field_name_conditions") or [])


def builtin(name: str) -> Pipeline:
    """``sysmon``, ``ecs_windows`` and ``fibratus_windows``: log sources and field names of common event formats."""
    # fixed values: event numbers of the public event source, and public field names
    events = {"process_creation": 1, "file_change": 2, "network_connection": 3, "driver_load": 6, "image_load": 7, "create_remote_thread": 8, "raw_access_thread": 9, "process_access": 10, "file_event": 11, "registry_event": 12, "create_stream_hash": 15, "pipe_created": 17, "dns_query": 22, "file_delete": 23}
    ecs = {"Image": "process.executable", "CommandLine": "process.command_line", "ParentImage": "process.parent.executable", "ParentCommandLine": "process.parent.command_line", "User": "user.name", "TargetFilename": "file.path", "QueryName": "dns.question.name", "DestinationIp": "destination.ip", "DestinationPort": "destination.port", "SourceIp": "source.ip", "SourcePort": "source.port", "ComputerName": "host.name", "EventID": "winlog.event_id"}
    fibratus = {"Image": "ps.exe", "CommandLine": "ps.cmdline", "ParentImage": "ps.parent.exe", "ParentCommandLine": "ps.parent.cmdline", "User": "ps.username", "TargetFilename": "file.path", "DestinationIp": "net.dip", "DestinationPort": "net.dport", "SourceIp": "net.sip"}
    if name == "sysmon":
        return Pipeline(name, 10, [Step("add_condition", {"conditions": {"EventID": n}}, f"sysmon_{c}", [{"type": "logsource", "category": c, "product": "windows"}]) for c, n in events.items()])
    if name in ("ecs_windows", "fibratus_windows"):
        return Pipeline(name, 20, [Step("field_name_mapping", {"mapping": ecs if name == "ecs_windows" else fibratus}, name, [{"type": "logsource", "product": "windows"}])])
    raise RuleError(f"no pipeline {name!r}")


# -- conditions -------------------------------------------------------------------------------------------
def items(body) -> list[tuple[dict, str]]:
    """All detection items: the mapping they lie in, and their key."""
    out = []
    if isinstance(body, dict):
        for key, value in body.items():
            out.append((body, key))
            if isinstance(value, dict) or (isinstance(value, list) and any(isinstance(v, dict) for v in value)):
                out += items(value)
    elif isinstance(body, list):
        for x in body:
            out += items(x)
    return out


def _rule_condition(c: dict, rule: Rule | Correlation, state: State) -> bool:
    kind = c["type"]
    if kind == "is_sigma_rule":
        return isinstance(rule, Rule)
    if kind == "is_sigma_correlation_rule":
        return isinstance(rule, Correlation)
    if kind == "processing_item_applied":
        return c["processing_item_id"] in state.applied
    if kind == "processing_state":
        return state.values.get(c["key"]) == c["val"]
    if kind == "tag":
        return c["tag"] in rule.tags
    if kind == "rule_attribute":
        value = getattr(rule, c["attribute"], None)
        if value is None:
            value = rule.attributes.get(c["attribute"])
        return {"eq": lambda: str(value) == str(c["value"]), "neq": lambda: str(value) != str(c["value"]), "in": lambda: value in c["value"]}[c.get("op", "eq")]()
    if not isinstance(rule, Rule):
        return False
    if kind == "logsource":
        return all(rule.logsource.get(k, "").lower() == str(c[k]).lower() for k in ("category", "product", "service") if c.get(k))
    if kind == "contains_detection_item":
        return any(key.split("|")[0] == c["field"] and (c.get("value") is None or c["value"] in (body[key] if isinstance(body[key], list) else [body[key]])) for part in rule.detection.values() for body, key in items(part))
    raise RuleError(f"unknown rule condition {kind!r}")


def _item_condition(c: dict, values: list) -> bool:
    kind = c["type"]
    if kind == "match_string":
        test = [isinstance(v, str) and re.search(c["pattern"], v) is not None for v in values]
        hit = all(test) if c.get("cond") == "all" else any(test)
        return not hit if c.get("negate") else hit
    if kind == "is_null":
        return any(v is None for v in values)
    raise RuleError(f"unknown detection item condition {kind!r}")


def _field_condition(c: dict, name: str) -> bool:
    if c.get("match_type") == "regex" or c.get("mode") == "re":
        hit = any(re.search(f, name) for f in c["fields"])
    else:
        hit = name in c["fields"]
    if c["type"] == "include_fields":
        return hit
    if c["type"] == "exclude_fields":
        return not hit
    raise RuleError(f"unknown field name condition {c['type']!r}")


def applies(step: Step, rule: Rule | Correlation, state: State) -> bool:
    tests = [_rule_condition(c, rule, state) for c in step.rule_conditions]
    hit = (all(tests) if step.rule_linking == "and" else any(tests)) if tests else True
    return not hit if step.rule_negated else hit


# -- application ------------------------------------------------------------------------------------------
def apply_pipelines(rule: Rule | Correlation, pipelines: list[Pipeline]) -> Rule | Correlation:
    """The rule after all pipelines, lowest priority number first; the rule given stays as it is."""
    rule = copy.deepcopy(rule)
    for pipeline in sorted(pipelines, key=lambda p: p.priority):
        state = State(dict(pipeline.vars))
        for step in pipeline.steps:
            _apply(step, rule, state)
    return rule


def _apply(step: Step, rule: Rule | Correlation, state: State) -> None:
    if not applies(step, rule, state):
        return
    o = step.options
    if step.type == "nest":
        for inner in o.get("items") or o.get("transformations") or []:
            _apply(_step(inner), rule, state)
    elif step.type == "include":
        for inner in builtin(o["name"]).steps:
            _apply(inner, rule, state)
    elif step.type == "set_state":
        state.values[o["key"]] = o["val"]
    elif step.type == "rule_failure":
        raise RuleError(o.get("message", "a pipeline refuses the rule"))
    elif step.type == "set_custom_attribute":
        rule.attributes[o["attribute"]] = o["value"]
    elif isinstance(rule, Correlation):
        if step.type == "field_name_mapping":
            rule.group_by = [_first(o["mapping"].get(g, g)) for g in rule.group_by]
            rule.fields = [_first(o["mapping"].get(f, f)) for f in rule.fields]
            rule.aliases = {a: {r: _first(o["mapping"].get(f, f)) for r, f in by.items()} for a, by in rule.aliases.items()}
    elif step.type == "change_logsource":
        rule.logsource = {**rule.logsource, **{k: str(v) for k, v in o.items() if k in ("category", "product", "service")}}
    elif step.type == "add_field":
        rule.fields += [f for f in _many(o["field"]) if f not in rule.fields]
    elif step.type == "remove_field":
        rule.fields = [f for f in rule.fields if f not in _many(o["field"])]
    elif step.type == "set_field":
        rule.fields = list(o["fields"])
    elif step.type == "add_condition":
        name = o.get("name") or f"_added_{sum(n.startswith('_added_') for n in rule.detection)}"
        body = {k: [re.sub(r"\$(\w+)", lambda m: rule.logsource.get(m[1], m[0]), x) if isinstance(x, str) else x for x in _many(v)] for k, v in o["conditions"].items()}
        rule.detection[name] = body
        own = ("not", ("name", name)) if o.get("negated") else ("name", name)
        rule.conditions = [("and", [own, t] if not o.get("prepend", True) is False else [t, own]) for t in rule.conditions]
    else:
        rule.detection = {n: _rewrite(body, step, rule, state) for n, body in rule.detection.items()}
        rule.detection = {n: b for n, b in rule.detection.items()}
    if step.id:
        state.applied.add(step.id)


def _many(value) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


def _first(value):
    return value[0] if isinstance(value, list) else value


def _rewrite(body, step: Step, rule: Rule, state: State):
    if isinstance(body, list):
        if body and all(not isinstance(x, (dict, list)) for x in body):
            return _values(body, step, state) if step.type in VALUE_STEPS and not step.field_conditions else body
        return [_rewrite(x, step, rule, state) for x in body]
    if not isinstance(body, dict):
        return body
    variants: list[dict] = [{}]
    for key, value in body.items():
        name, *modifiers = key.split("|")
        if isinstance(value, dict) or (isinstance(value, list) and any(isinstance(v, dict) for v in value)):
            for v in variants:
                v[key] = _rewrite(value, step, rule, state)
            continue
        if (step.field_conditions and not all(_field_condition(c, name) for c in step.field_conditions)) or (step.item_conditions and not all(_item_condition(c, _many(value)) for c in step.item_conditions)):
            for v in variants:
                v[key] = value
            continue
        try:
            options = _item(name, modifiers, value, step, state)
        except Dropped:
            continue
        variants = [{**v, **option} for v in variants for option in options]
    return variants[0] if len(variants) == 1 else variants


VALUE_STEPS = {"replace_string", "value_placeholders", "wildcard_placeholders", "query_expression_placeholders", "map_string", "set_value", "convert_type", "case_transformation", "regex"}


def _item(name: str, modifiers: list[str], value, step: Step, state: State) -> list[dict]:
    """The detection items that one becomes; several are alternatives."""
    o = step.options
    key = lambda n, m=modifiers: "|".join([n, *m])
    kind = step.type
    if kind == "field_name_mapping":
        return [{key(n): value} for n in _many(o["mapping"].get(name, name))]
    if kind == "field_name_prefix_mapping":
        for prefix, new in o["mapping"].items():
            if name.startswith(prefix):
                return [{key(n + name[len(prefix):]): value} for n in _many(new)]
        return [{key(name): value}]
    if kind == "field_name_prefix":
        return [{key(o["prefix"] + name if name else name): value}]
    if kind == "field_name_suffix":
        return [{key(name + o["suffix"] if name else name): value}]
    if kind == "field_name_transform":
        change = {"lower": str.lower, "upper": str.upper, "title": str.title, "snake_case": lambda s: re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", s).replace("-", "_").replace(" ", "_").lower()}[o.get("transform_func") or o.get("function") or "lower"]
        return [{key(o.get("mapping", {}).get(name, change(name))): value}]
    if kind == "drop_detection_item":
        raise Dropped
    if kind == "detection_item_failure":
        raise RuleError(o.get("message", f"a pipeline refuses the item {name!r}"))
    if kind == "hashes_fields":
        if name not in ("Hashes", "Hash"):
            return [{key(name): value}]
        options = []
        for v in _many(value):
            algorithm, _, digest = str(v).strip("*").rpartition("=")
            algorithm = algorithm or {32: "MD5", 40: "SHA1", 64: "SHA256"}.get(len(digest), "")
            if algorithm.upper() in [a.upper() for a in o.get("valid_hash_algos", ["MD5", "SHA1", "SHA256", "IMPHASH"])]:
                options.append({o.get("field_prefix", "") + (algorithm if not o.get("drop_algo_prefix") else "Hash"): digest})
        if not options:
            raise RuleError("no usable hash")
        return options
    new = _values(_many(value), step, state)
    extra = ["re"] if kind == "regex" and "re" not in modifiers and o.get("method") else []
    return [{key(name, modifiers + extra): new if isinstance(value, list) or len(new) != 1 else new[0]}]


def _values(values: list, step: Step, state: State) -> list:
    o, kind = step.options, step.type
    out: list = []
    for v in values:
        if kind == "set_value":
            out.append(o["value"])
        elif kind == "convert_type":
            target = o.get("target_type", "str")
            try:
                out.append(str(v) if target in ("str", "string") else float(v) if "." in str(v) else int(v))
            except (TypeError, ValueError):
                out.append(v)
        elif not isinstance(v, str):
            out.append(v)
        elif kind == "replace_string":
            out.append(re.sub(o["regex"], o["replacement"], v))
        elif kind == "map_string":
            out += _many(o["mapping"].get(v, v))
        elif kind == "case_transformation":
            out.append({"lower": v.lower, "upper": v.upper}.get(o.get("method", "lower"), lambda v=v: re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", v).lower())())
        elif kind in ("value_placeholders", "query_expression_placeholders"):
            spots = [p for p in re.findall(r"%(\w+)%", v) if p in state.vars and (not o.get("include") or p in o["include"]) and p not in (o.get("exclude") or [])]
            made = [v]
            for p in spots:
                made = [m.replace(f"%{p}%", str(x)) for m in made for x in _many(state.vars[p])]
            out += made
        elif kind == "wildcard_placeholders":
            out.append(re.sub(r"%(\w+)%", lambda m: "*" if (not o.get("include") or m[1] in o["include"]) and m[1] not in (o.get("exclude") or []) else m[0], v))
        else:
            out.append(v)
    return out


def finalize(queries: list[str], finalizers: list[dict]) -> str | list[str]:
    """``concat`` (prefix, separator, suffix), ``json`` and ``template`` (``{queries}``) over finished queries."""
    out: str | list[str] = queries
    for f in finalizers:
        rows = out if isinstance(out, list) else [out]
        if f["type"] == "concat":
            out = f.get("prefix", "") + f.get("separator", "\n").join(rows) + f.get("suffix", "")
        elif f["type"] == "json":
            out = json.dumps(rows, indent=f.get("indent"))
        elif f["type"] == "template":
            out = f["template"].replace("{queries}", "\n".join(rows))
        else:
            raise RuleError(f"unknown finalizer {f['type']!r}")
    return out
