"""Schema recognition: signatures, routing, discovery of shapes, and coverage of fields by rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlight.operators.detect import rule_fields
from spanlight.rules.fields import Resolver, text_of
from spanlight.rules.match import java_regex
from spanlight.rules.model import Collection

MAX_SHAPES = 10_000


@dataclass
class Signature:
    """A named schema: predicates that must all hold. ``specificity`` decides between several."""

    name: str
    predicates: list[dict]
    specificity: int = 0
    logsource: dict[str, str] = field(default_factory=dict)


def builtin_signatures() -> list[Signature]:
    """Signatures of common public event shapes, most by the fields that only they have."""
    shapes = [  # fixed values: field names of public event formats
        ("ecs_windows", 90, [{"present": "winlog.event_id"}], {"product": "windows"}), ("sysmon", 85, [{"equals": ["Channel", "Microsoft-Windows-Sysmon/Operational"]}], {"product": "windows", "service": "sysmon"}),
        ("windows_event", 70, [{"present": "EventID"}, {"any_of": ["Channel", "Provider_Name"]}], {"product": "windows"}), ("aws_cloudtrail", 90, [{"present": "eventSource"}, {"present": "eventName"}, {"present": "userIdentity"}], {"product": "aws", "service": "cloudtrail"}),
        ("aws_vpcflow", 90, [{"present": "srcaddr"}, {"present": "dstaddr"}, {"present": "log_status"}], {"product": "aws", "service": "vpcflow"}), ("azure_signin", 90, [{"present": "correlationId"}, {"present": "tenantId"}, {"present": "properties"}], {"product": "azure", "service": "signinlogs"}),
        ("gcp_audit", 90, [{"present": "protoPayload"}], {"product": "gcp", "service": "gcp.audit"}), ("kubernetes_audit", 90, [{"present": "objectRef"}, {"present": "verb"}], {"product": "kubernetes", "service": "audit"}),
        ("okta", 80, [{"present": "eventType"}, {"present": "actor"}, {"present": "target"}], {"product": "okta", "service": "okta"}), ("github_audit", 80, [{"present": "_document_id"}, {"present": "action"}], {"product": "github", "service": "audit"}),
        ("cef", 60, [{"present": "deviceVendor"}, {"present": "deviceEventClassId"}], {}), ("syslog", 40, [{"present": "facility"}, {"present": "hostname"}], {"product": "linux"}), ("generic_json", 1, [{"has_any_field": True}], {}),
    ]
    return [Signature(n, p, s, ls) for n, s, p, ls in shapes]


def predicate(p: dict, resolver: Resolver) -> Column:
    """One of ``present, absent, any_of, equals, matches, compare, in, same, not, any, all, has_any_field``."""
    (kind, value), = p.items()

    def text(name: str) -> Column | None:
        found = resolver.find(name)
        return None if found is None or found.many else text_of(found.column, found.type)

    def there(name: str) -> Column:
        found = resolver.find(name)
        return F.lit(False) if found is None else found.column.isNotNull()

    def test(name: str, make) -> Column:
        column = text(name)
        return F.lit(False) if column is None else F.coalesce(make(column), F.lit(False))

    if kind == "present":
        return there(value)
    if kind == "absent":
        return ~there(value)
    if kind == "any_of":
        return reduce(lambda a, b: a | b, [there(v) for v in value])
    if kind == "equals":
        return test(value[0], lambda c: F.lower(c) == str(value[1]).lower())
    if kind == "matches":
        return test(value[0], lambda c: c.rlike(java_regex(value[1], [])))
    if kind == "in":
        return test(value[0], lambda c: F.lower(c).isin([str(v).lower() for v in value[1]]))
    if kind == "compare":
        ops = {">": lambda c: c > value[2], ">=": lambda c: c >= value[2], "<": lambda c: c < value[2], "<=": lambda c: c <= value[2], "==": lambda c: c == value[2]}
        return test(value[0], lambda c: ops[value[1]](c.try_cast("double")))
    if kind == "same":
        other = text(value[1])
        return F.lit(False) if other is None else test(value[0], lambda c: F.lower(c) == F.lower(other))
    if kind == "not":
        return ~predicate(value, resolver)
    if kind in ("any", "all"):
        parts = [predicate(v, resolver) for v in value]
        return reduce((lambda a, b: a | b) if kind == "any" else (lambda a, b: a & b), parts)
    if kind == "has_any_field":
        return reduce(lambda a, b: a | b, [F.col(f"`{n}`").isNotNull() for n in resolver.schema.fieldNames()])
    raise ValueError(f"unknown predicate {kind!r}")


def classify(rows: DataFrame, signatures: list[Signature], json: set[str] = frozenset()) -> DataFrame:
    """Add ``schema`` (the most specific that fits, then the first by name; null if none), ``schemas`` (all that fit)
    and ``ambiguous`` (two fit with the same, greatest specificity)."""
    resolver = Resolver(rows.schema, set(json))
    ordered = sorted(signatures, key=lambda s: (-s.specificity, s.name))
    fits = [F.when(reduce(lambda a, b: a & b, [predicate(p, resolver) for p in s.predicates]), F.struct(F.lit(s.name).alias("name"), F.lit(s.specificity).alias("specificity"))) for s in ordered]
    out = rows.withColumn("__fit", F.filter(F.array(*fits), lambda x: x.isNotNull()))
    first = F.try_element_at("__fit", F.lit(1))
    second = F.try_element_at("__fit", F.lit(2))
    return out.withColumns({
        "schema": first.getField("name"), "schemas": F.transform("__fit", lambda x: x.getField("name")),
        "ambiguous": F.coalesce(first.getField("specificity") == second.getField("specificity"), F.lit(False)),
    }).drop("__fit")


def implied_logsource(schema: Column, signatures: list[Signature], part: str) -> Column:
    pairs = {s.name: s.logsource[part] for s in signatures if part in s.logsource}
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), schema) if pairs else F.lit(None).cast("string")


def route(classified: DataFrame, on_unknown: str = "warn") -> DataFrame:
    """What becomes of rows without a schema: kept (``warn``, ``passthrough``), dropped or an error."""
    if on_unknown == "drop":
        return classified.where(F.col("schema").isNotNull())
    if on_unknown == "error":
        return classified.withColumn("schema", F.coalesce("schema", F.raise_error(F.lit("a row of unknown schema")).cast("string")))
    if on_unknown not in ("warn", "passthrough"):
        raise ValueError(on_unknown)
    return classified


def shapes(rows: DataFrame, body: str) -> DataFrame:
    """The sets of top-level keys of JSON objects, with their numbers; most frequent first by count, then text."""
    keys = F.array_sort(F.json_object_keys(F.col(body)))
    return rows.where(F.json_object_keys(F.col(body)).isNotNull()).groupBy(keys.alias("keys")).agg(F.count("*").alias("n"))


def discover(shape_counts: list[tuple[list[str], int]], similarity: float = 0.6, core: float = 0.9, max_candidates: int = 10, max_predicates: int = 6) -> list[dict]:
    """Cluster shapes greedily (Jaccard of keys to the cluster's first shape) and propose a signature for each cluster:
    its core fields, rarest over all rows first. A driver step on distinct shapes, of which there are few."""
    if len(shape_counts) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} shapes")
    clusters: list[dict] = []
    total: dict[str, int] = {}
    for keys, n in sorted(shape_counts, key=lambda x: (-x[1], x[0])):
        for k in keys:
            total[k] = total.get(k, 0) + n
        own = set(keys)
        for c in clusters:
            if len(own & c["lead"]) >= similarity * len(own | c["lead"]):
                break
        else:
            c = {"lead": own, "n": 0, "fields": {}}
            clusters.append(c)
        c["n"] += n
        for k in keys:
            c["fields"][k] = c["fields"].get(k, 0) + n
    out = []
    for c in sorted(clusters, key=lambda c: (-c["n"], sorted(c["lead"])))[:max_candidates]:
        fields = [k for k, n in c["fields"].items() if n >= core * c["n"]]
        fields.sort(key=lambda k: (total[k] / c["fields"][k], k))
        out.append({"n": c["n"], "core": sorted(fields), "predicates": fields[:max_predicates]})
    return out


def field_counts(rows: DataFrame, json_columns: list[str] = ()) -> DataFrame:
    """How many rows have each field: ``field, n``; top-level members of JSON columns as ``column.member``."""
    plain = [F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in rows.columns]
    inner = [_prefixed(c) for c in json_columns]
    names = F.concat(F.filter(F.array(*plain), lambda x: x.isNotNull()), *inner)
    return rows.select(F.explode(names).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def _prefixed(column: str) -> Column:
    return F.transform(F.coalesce(F.json_object_keys(F.col(column)), F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{column}."), k))


def field_coverage(counts: DataFrame, collection: Collection) -> DataFrame:
    """``field, n, status``: ``covered`` (events and rules have it), ``unknown`` (no rule reads it), ``missing``
    (rules read it, no event has it)."""
    spark = counts.sparkSession
    read = sorted({re.sub(r"\[-?\d+\]", "", f) for r in collection.rules for f in rule_fields(r)})
    rules = spark.createDataFrame([(f,) for f in read], "field string").withColumn("ruled", F.lit(True))
    both = counts.join(F.broadcast(rules), "field", "full")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("ruled").isNull(), "unknown").otherwise("covered")
    return both.select("field", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def field_report(counts: DataFrame) -> DataFrame:
    """``place, field, n``: the fields in the order of a report, most frequent first, then by name.

    The fields of all events are few (they are counted already), so one task orders them."""
    return counts.select(F.row_number().over(Window.orderBy(F.desc("n"), "field")).alias("place"), "field", "n")
