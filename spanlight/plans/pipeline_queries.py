"""Contract queries of the alert pipeline, rule rewriting step by step, sources and sinks; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators import alert_pipeline as P
from spanlight.operators import alerts as A
from spanlight.operators import detect as D
from spanlight.operators import schemas
from spanlight.plans.alert_queries import DAY, RULES, SQL_ALERTS, SQL_ISLANDS, alerts
from spanlight.rules import pipeline
from spanlight.rules.model import Collection, load_rules
from spanlight.session import table
from spanlight.sources import sinks, stix

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        function.__name__ = name
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


# -- the alert pipeline -----------------------------------------------------------------------------------
m = A.Matcher.parse
PIPELINE = P.AlertPipeline(
    levels=["high", "low"], inhibitions=[P.Inhibition([m("rule_title=errors")], [m("rule_title=signups")], ["user_id"], DAY)],
    silences=[([m("user_id=3")], 0, 1706000000)], dedup_by=["rule_title", "user_id"], dedup_resolve_s=DAY, group_by=["user_id"], group_resolve_s=2 * DAY, strip=["value"],
)
SQL_PIPELINE = f"""WITH {SQL_ALERTS.replace('a AS (', 'every AS (', 1)},
inside AS (SELECT * FROM every WHERE level IN ('high', 'low')),
heard AS (SELECT * FROM inside t WHERE NOT (rule_title = 'signups' AND EXISTS (SELECT 1 FROM inside s WHERE s.rule_title = 'errors' AND s.user_id = t.user_id
  AND (s.ts < t.ts OR (s.ts = t.ts AND s.seq < t.seq)) AND t.ts - s.ts < {DAY})) AND NOT (user_id = 3 AND ts >= 0 AND ts < 1706000000)),
g1 AS (SELECT *, ts - lag(ts) OVER (PARTITION BY rule_title, user_id ORDER BY ts, seq) AS since FROM heard),
kept AS (SELECT * EXCLUDE (since) FROM g1 WHERE since IS NULL OR since > {DAY}),
g2 AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) > {2 * DAY} THEN 1 ELSE 0 END AS cut FROM kept),
g3 AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM g2),
g4 AS (SELECT *, min(ts) OVER (PARTITION BY user_id, island) AS start_ts FROM g3)"""


@_query("alert_pipeline", f"""{SQL_PIPELINE}
SELECT seq, rule_title, sha256(CAST(user_id AS VARCHAR) || chr(31) || CAST(start_ts AS VARCHAR)) AS incident_id FROM g4
UNION ALL SELECT seq, rule_title, NULL FROM every WHERE level NOT IN ('high', 'low')""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return P.run(alerts(spark, sf), PIPELINE).select("seq", "rule_title", "incident_id")


WAIT, INTERVAL, REPEAT, RESOLVE = 600, 7200, 30_000, 86_400


@_query("incident_timers", f"""WITH RECURSIVE {SQL_ALERTS}, {SQL_ISLANDS.format(by='user_id', gap=RESOLVE)},
c AS (SELECT user_id, island, list(ts ORDER BY ts) AS times FROM i GROUP BY 1, 2),
step AS (
  SELECT user_id, island, times, times[1] + {WAIT} AS at_ts, 'group_wait' AS trigger FROM c
  UNION ALL
  SELECT user_id, island, times, least(dirty, again, ended) AS at_ts,
    CASE WHEN ended <= least(dirty, again) THEN 'resolved' WHEN dirty <= again THEN 'group_interval' ELSE 'repeat' END FROM (
      SELECT *, CASE WHEN times[len(times)] > at_ts THEN greatest(list_min(list_filter(times, lambda x: x > at_ts)), at_ts + {INTERVAL}) ELSE 1152921504606846976 END AS dirty, at_ts + {REPEAT} AS again,
        greatest(times[len(times)] + {RESOLVE}, at_ts + 1) AS ended FROM step WHERE trigger <> 'resolved'))
SELECT user_id, times[1] AS first_ts, at_ts, trigger, len(list_filter(times, lambda x: x <= at_ts)) AS n_alerts FROM step""")
def _(spark, sf):
    return P.incident_timers(alerts(spark, sf), ["user_id"], WAIT, INTERVAL, REPEAT, RESOLVE)


CORRELATED = load_rules("""
title: errors
id: r1
detection: {s: {event_type: error}, condition: s}
---
title: costly
id: r2
detection: {s: {value|gte: 80}, condition: s}
---
title: many errors
correlation: {type: event_count, rules: [r1], group-by: [user_id], timespan: 1h, condition: {gte: 3}}
---
title: many costly
correlation: {type: event_count, rules: [costly], generate: true, timespan: 1h, condition: {gte: 3}}
""")


@_query("corr_generate", "SELECT event_id, 'costly' AS rule_title FROM events WHERE value >= 80")
def _(spark, sf):
    return D.emitted(D.detect(table(spark, sf, "events"), CORRELATED, ["event_id"]), CORRELATED).select("event_id", "rule_title")


BY_SOURCE = load_rules("""
title: dns
logsource: {category: dns, product: windows}
detection: {s: {action: blocked}, condition: s}
---
title: any
logsource: {product: windows}
detection: {s: {severity|gte: 4}, condition: s}
---
title: linux
logsource: {product: linux}
detection: {s: {action: allowed}, condition: s}
""")


@_query("detect_logsource_subset", "SELECT rule_title, count(*) AS n FROM (SELECT 'dns' AS rule_title FROM security_events WHERE lower(action) = 'blocked' UNION ALL SELECT 'any' FROM security_events WHERE severity >= 4) GROUP BY 1")
def _(spark, sf):
    rules = D.subset(BY_SOURCE, {"category": "dns", "product": "windows"})
    return D.detect(table(spark, sf, "security_events"), rules, []).groupBy("rule_title").agg(F.count("*").alias("n"))


@_query("result_selectors", f"""WITH {SQL_ALERTS} SELECT seq, 'r' || CASE rule_title WHEN 'errors' THEN '1' WHEN 'costly' THEN '2' ELSE '3' END AS rule, level,
  CAST(user_id AS VARCHAR) AS "event.user_id", CASE WHEN rule_title = 'errors' THEN 'error' WHEN rule_title = 'signups' THEN 'signup' END AS "match.event_type" FROM a""")
def _(spark, sf):
    found = D.detect(table(spark, sf, "events"), RULES, detail=True)
    number = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(RULES.rules, 1) for x in (r.title, i)]), F.col("rule_title"))
    rows = found.withColumn("seq", F.col("event_id") * 10 + number)
    names = ["rule", "event.user_id", "match.event_type"]
    return P.select_values(rows, names).select("seq", "rule", P.selector("level", rows.columns).alias("level"), *[F.col(f"`{n}`") for n in names[1:]])


@_query("keywords_in_json", """SELECT rec_no FROM stix_objects WHERE json_valid(body) AND contains(lower(body), 'vendor-db')""")
def _(spark, sf):
    rules = load_rules("title: k\ndetection: {k: ['vendor-db'], condition: k}")
    rows = table(spark, sf, "stix_objects").select("rec_no", "body")
    return D.matching(rows, rules, rules.rules[0], json={"body"}).select("rec_no")


@_query("field_report", "SELECT row_number() OVER (ORDER BY n DESC, field) AS place, field, n FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS field, unnest([count(event_id), count(ts), count(user_id), count(event_type), count(value), count(props)]) AS n FROM events)")
def _(spark, sf):
    return schemas.field_report(schemas.field_counts(table(spark, sf, "events")))


# -- rewriting rules, one step each -----------------------------------------------------------------------
BASE = """
title: base
id: 11111111-2222-3333-4444-555555555555
tags: [attack.t1059]
logsource: {{category: web, product: windows}}
fields: [event_id]
detection:
  s: {{{item}}}
  condition: s
"""
E = "event_type = 'error'"
#: name -> (item of the base rule, steps, the WHERE of the rewritten rule)
STEPS: dict[str, tuple[str, str, str]] = {
    "field_name_mapping": ("kind: error", "{type: field_name_mapping, mapping: {kind: event_type}}", E),
    "field_name_mapping_many": ("kind: error", "{type: field_name_mapping, mapping: {kind: [event_type, props]}}", f"{E} OR lower(props) = 'error'"),
    "field_name_prefix_mapping": ("ev.type: error", "{type: field_name_prefix_mapping, mapping: {ev.: event_}}", E),
    "field_name_prefix": ("type: error", "{type: field_name_prefix, prefix: event_}", E),
    "field_name_suffix": ("event: error", "{type: field_name_suffix, suffix: _type}", E),
    "field_name_transform": ("EventType: error", "{type: field_name_transform, transform_func: snake_case}", E),
    "drop_detection_item": ("event_type: error, user_id: 1", "{type: drop_detection_item, field_name_conditions: [{type: include_fields, fields: [user_id]}]}", E),
    "add_condition": ("event_type: error", "{type: add_condition, conditions: {user_id: 7}}", f"{E} AND user_id = 7"),
    "add_condition_negated": ("event_type: error", "{type: add_condition, conditions: {user_id: 7}, negated: true}", f"{E} AND NOT coalesce(user_id = 7, false)"),
    "change_logsource": ("event_type: error", "{type: change_logsource, category: error}, {type: add_condition, conditions: {event_type: $category}}", E),
    "replace_string": ("event_type: err-or", "{type: replace_string, regex: '-', replacement: ''}", E),
    "value_placeholders": ("event_type: '%kinds%'", "{type: value_placeholders}", "event_type IN ('error', 'view')"),
    "wildcard_placeholders": ("event_type: 'e%rest%'", "{type: wildcard_placeholders}", "event_type LIKE 'e%'"),
    "query_expression_placeholders": ("event_type: '%kinds%'", "{type: query_expression_placeholders, include: [kinds]}", "event_type IN ('error', 'view')"),
    "set_state": ("kind: error", "{type: set_state, key: index, val: main}, {type: field_name_mapping, mapping: {kind: event_type}, rule_conditions: [{type: processing_state, key: index, val: main}]}", E),
    "hashes_fields": ("Hashes: 'MD5=aa,', event_type: error", "{type: drop_detection_item, field_name_conditions: [{type: include_fields, fields: [Hashes]}]}", E),
    "map_string": ("event_type: bad", "{type: map_string, mapping: {bad: [error, view]}}", "event_type IN ('error', 'view')"),
    "set_value": ("event_type: anything", "{type: set_value, value: error}", E),
    "convert_type": ("user_id: '7'", "{type: convert_type, target_type: num}", "user_id = 7"),
    "regex": ("event_type|re: '^e.*r$'", "{type: regex, method: plain}", E),
    "case_transformation": ("event_type|cased: ERROR", "{type: case_transformation, method: lower}", E),
    "nest": ("kind: ERROR", "{type: nest, items: [{type: field_name_mapping, mapping: {kind: event_type}}, {type: case_transformation, method: lower}]}", E),
    "rule_condition_tag": ("kind: error", "{type: field_name_mapping, mapping: {kind: event_type}, rule_conditions: [{type: tag, tag: attack.t1059}]}", E),
    "item_condition": ("event_type: [err, view]", "{type: replace_string, regex: '^err$', replacement: error, detection_item_conditions: [{type: match_string, cond: any, pattern: '^err$'}]}", "event_type IN ('error', 'view')"),
    "field_condition": ("event_type: error, props: x", "{type: drop_detection_item, field_name_conditions: [{type: exclude_fields, fields: [event_type]}]}", E),
}


def _step(name: str, item: str, steps: str, where: str) -> None:
    rules = load_rules(BASE.format(item=item))
    if rules.errors:
        raise ValueError((name, rules.errors))
    own = pipeline.load_pipeline(f"name: {name}\npriority: 1\nvars: {{kinds: [error, view]}}\ntransformations: [{steps}]")

    @_query(f"pipe_{name}", f"SELECT event_id FROM events WHERE {where}")
    def _(spark, sf):
        rule = pipeline.apply_pipelines(rules.rules[0], [own])
        return D.matching(table(spark, sf, "events"), Collection([rule]), rule).select("event_id")


for _name, _parts in STEPS.items():
    _step(_name, *_parts)


@_query("pipe_rule_attributes", "SELECT * FROM (VALUES ('fields', 'event_id,user_id'), ('attribute', 'blue'), ('priority', 'low first'), ('refused', 'true'), ('item refused', 'true')) v(what, value)")
def _(spark, sf):
    """What steps do to a rule beside its detection: fields, attributes, refusals, the order of pipelines."""
    rule = load_rules(BASE.format(item="event_type: error")).rules[0]
    make = lambda steps, priority=1: pipeline.load_pipeline(f"name: x\npriority: {priority}\ntransformations: [{steps}]")

    def refused(steps: str) -> str:
        try:
            pipeline.apply_pipelines(rule, [make(steps)])
        except ValueError:
            return "true"
        return "false"

    fields = pipeline.apply_pipelines(rule, [make("{type: set_field, fields: [event_id, ts]}, {type: add_field, field: user_id}, {type: remove_field, field: ts}")]).fields
    attribute = pipeline.apply_pipelines(rule, [make("{type: set_custom_attribute, attribute: team, value: blue}")]).attributes["team"]
    late, early = make("{type: set_custom_attribute, attribute: order, value: low first}", 9), make("{type: set_custom_attribute, attribute: order, value: high first}", 2)
    order = pipeline.apply_pipelines(rule, [late, early]).attributes["order"]
    rows = [("fields", ",".join(fields)), ("attribute", attribute), ("priority", order), ("refused", refused("{type: rule_failure, message: no}")), ("item refused", refused("{type: detection_item_failure, message: no}"))]
    return spark.createDataFrame(rows, "what string, value string")


# -- sources and sinks ------------------------------------------------------------------------------------
@_query("stix_bundle", """SELECT rec_no, k AS place, CASE k WHEN 0 THEN lower(trim(type)) ELSE 'note' END AS type, CASE k WHEN 0 THEN id ELSE 'note--1' END AS id
FROM stix_objects, (VALUES (0), (1)) v(k) WHERE id IS NOT NULL AND type IS NOT NULL""")
def _(spark, sf):
    rows = table(spark, sf, "stix_objects").where("id is not null and type is not null")
    member = F.to_json(F.struct("id", F.lower(F.trim("type")).alias("type"), "spec_version"))
    text = F.concat(F.lit('{"type": "bundle", "id": "bundle--1", "objects": ['), member, F.lit(', {"type": "note", "id": "note--1"}, {"id": "typeless"}]}'))
    return stix.bundle_objects(rows.select("rec_no", text.alias("value")), "value").select("rec_no", "place", "type", "id")


@_query("sink_otlp", f"WITH {SQL_ALERTS} SELECT seq, upper(level) AS severity, rule_title AS message, CAST(user_id AS VARCHAR) AS user_id FROM a")
def _(spark, sf):
    """Results as OTLP records, read again by the OTLP reader."""
    from spanlight.sources import formats

    sent = alerts(spark, sf).select("ts", "level", "rule_title", "seq", "user_id")
    got = formats.otlp_events(sent.select(sinks.otlp_record(sent).alias("value")))
    return got.select(F.element_at("attributes", F.lit("seq")).cast("bigint").alias("seq"), "severity", "message", F.element_at("attributes", F.lit("user_id")).alias("user_id"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
