"""Contract queries of rule rewriting, translation and analysis, and of streams; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators import correlate as C
from spanlight.operators.detect import matching
from spanlight.rules import analysis, lint, lucene, pipeline
from spanlight.rules.model import Collection, load_rules
from spanlight.session import scratch, table
from spanlight.streaming import detect as streams

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


RULE = load_rules("""
title: shells
id: 11111111-2222-3333-4444-555555555555
logsource: {category: process, product: windows}
detection:
  s: {Image|endswith: '%shell%', Severity|gte: 2}
  condition: s
""").rules[0]
PIPELINE = pipeline.load_pipeline("""
name: landing table
priority: 5
vars: {shell: [cmd.exe, powershell.exe]}
transformations:
  - {id: map, type: field_name_mapping, mapping: {Image: process_file_path, Severity: severity}, rule_conditions: [{type: logsource, product: windows}]}
  - {type: value_placeholders}
  - {type: add_condition, conditions: {category: $category}, rule_conditions: [{type: processing_item_applied, processing_item_id: map}]}
  - {type: drop_detection_item, field_name_conditions: [{type: include_fields, fields: [nothing]}]}
""")


@_query("pipeline_detect", "SELECT event_id, received_at FROM security_events WHERE (ends_with(lower(process_file_path), 'cmd.exe') OR ends_with(lower(process_file_path), 'powershell.exe')) AND severity >= 2 AND lower(category) = 'process'")
def _(spark: SparkSession, sf: str) -> DataFrame:
    rule = pipeline.apply_pipelines(RULE, [PIPELINE])
    return matching(table(spark, sf, "security_events"), Collection([rule]), rule).select("event_id", "received_at")


QUERY_TEXT = "(event_type:error OR event_type:pur*) AND value:[20 TO 90} AND NOT user_id:(1 2 3) AND _exists_:props"
SQL_QUERY = "SELECT event_id FROM events WHERE (event_type = 'error' OR event_type LIKE 'pur%') AND value >= 20 AND value < 90 AND NOT coalesce(user_id IN (1, 2, 3), false) AND props IS NOT NULL"


@_query("reverse_query_string", SQL_QUERY)
def _(spark, sf):
    rule = lucene.roundtrip(lucene.from_query(QUERY_TEXT))
    return matching(table(spark, sf, "events"), Collection([rule]), rule).select("event_id")


@_query("export_sql", SQL_QUERY)
def _(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("spanlight_events")
    return spark.sql(lucene.to_sql(lucene.from_query(QUERY_TEXT), "spanlight_events", "event_id"))


@_query("rule_explain", "SELECT event_id, coalesce(event_type = 'error', false) AS a, coalesce(value > 50, false) AS b, coalesce(event_type = 'error', false) AND NOT coalesce(value > 50, false) AS matched FROM events")
def _(spark, sf):
    rule = load_rules("title: x\ndetection: {a: {event_type: error}, b: {value|gt: 50}, condition: a and not b}").rules[0]
    return analysis.explain(table(spark, sf, "events"), rule, ["event_id"]).select("event_id", "a", "b", "matched")


@_query("rule_profile", "SELECT 'event_type' AS field, event_type AS value, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 2")
def _(spark, sf):
    return analysis.profile(table(spark, sf, "events"), ["event_type"])


@_query("rule_draft", "SELECT event_id FROM security_events WHERE lower(category) = 'dns' AND lower(event_type) = 'dns_query'")
def _(spark, sf):
    events = table(spark, sf, "security_events")
    rule = analysis.draft(events.where("event_type = 'dns_query'"), events, ["category", "event_type", "action", "network_protocol"], stable=0.99)
    return matching(events, Collection([rule]), rule).select("event_id")


@_query("rule_tune", "SELECT event_id FROM events WHERE value > 100 AND event_type <> 'view'")
def _(spark, sf):
    events = table(spark, sf, "events")
    rule = load_rules("title: x\ndetection: {a: {value|gt: 100}, condition: a}").rules[0]
    hits = matching(events, Collection([rule]), rule)
    tuned = analysis.tune(rule, hits.where("event_type = 'view'"), hits.where("event_type <> 'view'"), ["event_type"])
    return matching(events, Collection([tuned]), tuned).select("event_id")


LINTED = """
title: ''
status: odd
date: 2024-13-40
modified: 2024-01-02
Author: x
tags: [A, attack.t1059, attack.t1059, foo.bar]
level: odd
logsource: {category: DNS}
detection: {s: {x|all: 1, y: [], z: '**', 'q|contains|endswith': a, 'k[any]': b}, t: {}, condition: s and u}
---
title: second
id: 1
description: d
author: a
date: 2024/02/01
modified: 2024/01/01
status: deprecated
related: [{id: 1, type: other}, {id: 2}]
detection: {s: [{a: [b, null]}], condition: 's | count() > 3'}
---
title: c
id: 1
correlation: {type: value_sum, rules: [second, nobody], timespan: 5x, window: session, condition: {gte: many, near: 2}, generate: 'yes'}
---
title: f
level: low
filter: {rules: [], condition: s}
---
- no mapping
---
title: clean
id: 11111111-2222-3333-4444-555555555555
description: says what it finds
author: somebody
status: test
level: low
logsource: {category: web}
detection: {s: {a: b}, condition: s}
"""
FINDINGS = {
    "": "array_matching_without_version condition_references_unknown duplicate_tags empty_selection empty_title empty_value_list incompatible_modifiers invalid_date invalid_level invalid_status invalid_tag "
        "logsource_value_not_lowercase missing_author missing_description non_lowercase_key not_a_mapping single_value_all_modifier unknown_tag_namespace unused_selection wildcard_only_value",
    "second": "deprecated_aggregation_syntax invalid_id invalid_related_id invalid_related_type missing_level missing_logsource modified_before_date null_in_value_list related_missing_required",
    "c": "condition_value_not_numeric duplicate_id generate_not_boolean invalid_condition_operator invalid_id invalid_timespan_format missing_author missing_condition_field missing_description missing_group_by missing_session_gap unknown_rule_reference",
    "f": "condition_references_unknown empty_filter_rules filter_has_level missing_author missing_description missing_filter_logsource missing_filter_selection",
}


@_query("rule_lint", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, codes in FINDINGS.items() for c in codes.split()) + ") v(rule, code)")
def _(spark, sf):
    return spark.createDataFrame([(f.rule, f.code) for f in lint.lint_text(LINTED)], "rule string, code string").distinct()


@_query("rule_lint_compiled", "SELECT * FROM (VALUES ('a', 'missing_id'), ('a', 'invalid_level'), ('a', 'unused_selection'), ('a', 'duplicate_title'), ('a', 'invalid_id'), ('a', 'missing_logsource'), ('a', 'invalid_tag')) v(rule, code)")
def _(spark, sf):
    found = analysis.lint(load_rules("title: a\nlevel: odd\ndetection: {s: {x: 1}, t: {y: 1}, condition: s}\n---\ntitle: a\nid: 1\ntags: [A]\ndetection: {s: {x: 1}, condition: s}"))
    return spark.createDataFrame([(f.rule, f.code) for f in found], "rule string, code string").distinct()


def _correlation_sql(name: str, body: str, sql: str, columns: list[str]) -> None:
    rules = load_rules("title: errors\nname: errors\ndetection: {s: {event_type: error}, condition: s}\n---\ntitle: c\ncorrelation: " + body)

    @_query(name, sql)
    def _(spark, sf):
        table(spark, sf, "events").createOrReplaceTempView("spanlight_events")
        return spark.sql(lucene.correlation_to_sql(rules, rules.correlations[0], "spanlight_events", "ts")).selectExpr(*columns)


SECONDS = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"
_correlation_sql("export_sql_tumbling", "{type: event_count, rules: [errors], group-by: [user_id], timespan: 1d, window: tumbling, condition: {gte: 2}}", f"SELECT user_id, {SECONDS} // 86400 * 86400 AS start_s, count(*) AS value FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2", ["user_id", "start_s", "value"])
_correlation_sql("export_sql_sliding", "{type: value_sum, rules: [errors], group-by: [user_id], timespan: 1d, condition: {gt: 200, field: value}}", f"SELECT user_id, ts, round(value, 4) AS value FROM (SELECT user_id, {SECONDS} AS ts, sum(value) OVER (PARTITION BY user_id ORDER BY {SECONDS} RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS value FROM events WHERE event_type = 'error') WHERE value > 200", ["user_id", "ts", "round(value, 4) AS value"])
_correlation_sql("export_sql_session", "{type: event_count, rules: [errors], group-by: [user_id], timespan: 10d, window: session, gap: 1d, condition: {gte: 2}}", f"""WITH m AS (SELECT user_id, {SECONDS} AS t FROM events WHERE event_type = 'error'), c AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 86400 THEN 1 ELSE 0 END AS f FROM m),
r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM c) SELECT user_id, min(t) AS start_s, max(t) AS end_s, count(*) AS value FROM r GROUP BY user_id, s HAVING count(*) >= 2 AND max(t) - min(t) <= 864000""", ["user_id", "start_s", "end_s", "value"])


@_query("export_sql_temporal_tables", f"""WITH m AS (SELECT 'errors' AS r, {SECONDS} AS t FROM events WHERE event_type = 'error' UNION ALL SELECT 'big', CAST(floor(epoch_us(o_orderdate::TIMESTAMP) / 1000000) AS BIGINT) FROM orders WHERE o_totalprice >= 250000)
SELECT t // 86400 * 86400 AS start_s, count(DISTINCT r) AS value, min(t) AS first_seen, max(t) AS last_seen FROM m GROUP BY 1 HAVING count(DISTINCT r) >= 1""")
def _(spark, sf):
    """A temporal correlation whose rules read different tables."""
    rules = load_rules("""
title: errors
name: errors
detection: {s: {event_type: error}, condition: s}
---
title: big
name: big
detection: {s: {o_totalprice|gte: 250000}, condition: s}
---
title: c
correlation: {type: temporal, rules: [errors, big], timespan: 1d, window: tumbling}
""")
    table(spark, sf, "events").createOrReplaceTempView("spanlight_events")
    table(spark, sf, "orders").withColumnRenamed("o_orderdate", "ts").createOrReplaceTempView("spanlight_orders")
    return spark.sql(lucene.correlation_to_sql(rules, rules.correlations[0], {"errors": "spanlight_events", "big": "spanlight_orders"}, "ts")).selectExpr("start_s", "CAST(value AS bigint) AS value", "first_seen", "last_seen")


@_query("logsource_extract", "SELECT coalesce(nullif(trim(category), ''), 'none') AS category, 'lab' AS product, count(*) AS n FROM security_events GROUP BY 1")
def _(spark, sf):
    from spanlight.rules.compile import extract_logsource

    events = table(spark, sf, "security_events")
    parts = extract_logsource(events.schema, {"category": "category"}, {"category": "none", "product": "lab"})
    return events.select(*[c.alias(n) for n, c in parts.items()]).groupBy("category", "product").agg(F.count("*").alias("n"))


# -- streams ----------------------------------------------------------------------------------------------
ERRORS = load_rules("""
title: errors
name: errors
detection: {s: {event_type: error}, condition: s}
---
title: many errors
correlation: {type: event_count, rules: [errors], group-by: [user_id], timespan: 2d, condition: {gte: 3}}
---
title: errors a day
correlation: {type: event_count, rules: [errors], group-by: [user_id], timespan: 1d, window: tumbling, condition: {gte: 2}}
""")


def _run_stream(spark: SparkSession, sf: str, build) -> DataFrame:
    """The whole table as a stream that ends, written to a table in the shared folder."""
    base = scratch(spark, "stream")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    query = build(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@_query("stream_detect", "SELECT event_id, 'errors' AS rule_title FROM events WHERE event_type = 'error'")
def _(spark, sf):
    return _run_stream(spark, sf, lambda s: streams.detections(s, ERRORS, keep=["event_id"]).select("event_id", "rule_title"))


TS = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


@_query("stream_correlation", f"""
WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, {TS} AS t FROM events WHERE event_type = 'error')
SELECT a.event_id, a.user_id, CAST(count(*) AS DOUBLE) AS value FROM m a JOIN m b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 172800 AND a.t AND (b.t < a.t OR b.event_id <= a.event_id)
GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(spark, sf):
    out = _run_stream(spark, sf, lambda s: streams.sliding_correlation(s, ERRORS, ERRORS.correlations[0], "ts", "event_id"))
    return out.select(F.col("seq").alias("event_id"), F.col("k0").alias("user_id"), "value")


@_query("batch_correlation_tumbling_totals", f"SELECT CAST(user_id AS VARCHAR) AS user_id, {TS} // 86400 * 86400 AS start_s, CAST(count(*) AS DOUBLE) AS value FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2")
def _(spark, sf):
    rows = C.matches(table(spark, sf, "events"), ERRORS, ERRORS.correlations[1], "ts", "event_id")
    return rows.groupBy(F.col("k0").alias("user_id"), (F.floor(F.col("ts") / 86400) * 86400).alias("start_s")).agg(F.count("*").cast("double").alias("value")).where("value >= 2")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
