"""Contract queries of alert handling, risk, enrichment, schemas, reports and input formats, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators import alerts as A
from spanlight.operators import enrich, reports, risk, schemas
from spanlight.operators.detect import detect
from spanlight.rules.model import load_rules
from spanlight.session import table
from spanlight.sources import formats, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = 86_400


def _query(name: str, sql: str | None = None):
    def add(function):
        function.__name__ = name
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


RULES = load_rules("""
title: errors
id: r1
level: high
tags: [attack.execution, attack.t1059]
detection: {s: {event_type: error}, condition: s}
---
title: costly
id: r2
level: medium
tags: [attack.exfiltration, attack.t1041]
detection: {s: {value|gte: 80}, condition: s}
---
title: signups
id: r3
level: low
tags: [attack.persistence]
detection: {s: {event_type: signup}, condition: s}
""")
SQL_ALERTS = """a AS (
  SELECT event_id * 10 + r.i AS seq, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS ts, user_id, event_type, value, r.title AS rule_title, r.level, r.score, r.tactic
  FROM events JOIN (VALUES (1, 'errors', 'high', 60.0, 'execution'), (2, 'costly', 'medium', 40.0, 'exfiltration'), (3, 'signups', 'low', 20.0, 'persistence')) r(i, title, level, score, tactic)
  ON (r.i = 1 AND event_type = 'error') OR (r.i = 2 AND value >= 80) OR (r.i = 3 AND event_type = 'signup'))"""


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Detections as alerts: ``seq, ts, user_id, event_type, value`` and the rule's columns."""
    found = detect(table(spark, sf, "events"), RULES)
    number = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(RULES.rules, 1) for x in (r.title, i)]), F.col("rule_title"))
    return found.select((F.col("event_id") * 10 + number).alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("ts"), "user_id", "event_type", "value", "rule_title", "rule_id", "level", "tags")


@_query("alert_scope", f"WITH {SQL_ALERTS} SELECT seq, rule_title FROM a WHERE rule_title IN ('errors', 'costly') AND level = 'high'")
def _(spark, sf):
    return A.in_scope(alerts(spark, sf), ["err*", "r2"], ["attack.e"], ["HIGH"]).select("seq", "rule_title")


@_query("alert_inhibit", f"""WITH {SQL_ALERTS}
SELECT seq, rule_title FROM a t WHERE NOT (rule_title = 'signups' AND EXISTS (
  SELECT 1 FROM a s WHERE s.rule_title = 'errors' AND s.user_id = t.user_id AND (s.ts < t.ts OR (s.ts = t.ts AND s.seq < t.seq)) AND t.ts - s.ts < {DAY}))""")
def _(spark, sf):
    m = A.Matcher.parse
    return A.inhibit(alerts(spark, sf), [m("rule_title=errors")], [m("rule_title=signups")], ["user_id"], DAY).select("seq", "rule_title")


@_query("alert_silence", f"""WITH {SQL_ALERTS} SELECT seq FROM a
WHERE NOT (regexp_full_match(rule_title, 'err.*|sign.*') AND level <> 'low' AND ts >= 1704500000 AND ts < 1705500000) AND NOT (user_id = 3 AND ts >= 0 AND ts < 1706000000)""")
def _(spark, sf):
    m = A.Matcher.parse
    return A.silence(alerts(spark, sf), [([m("rule_title=~err.*|sign.*"), m("level!=low")], 1704500000, 1705500000), ([m("user_id=3")], 0, 1706000000)]).select("seq")


SQL_ISLANDS = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {by} ORDER BY ts, seq) > {gap} THEN 1 ELSE 0 END AS cut FROM a),
i AS (SELECT *, sum(cut) OVER (PARTITION BY {by} ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS island FROM g)"""


@_query("alert_dedup", f"""WITH {SQL_ALERTS}, {SQL_ISLANDS.format(by='rule_title, user_id', gap=DAY)}
SELECT rule_title, user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, arg_min(seq, (ts, seq)) AS first_seq, max(ts) + {DAY} AS resolved_ts FROM i GROUP BY rule_title, user_id, island""")
def _(spark, sf):
    return A.dedup(alerts(spark, sf), ["rule_title", "user_id"], DAY).drop("fingerprint")


_BYTES = "list_concat(list_transform(string_split(rule_title, ''), lambda c: ascii(c)), [0], list_transform(string_split(CAST(user_id AS VARCHAR), ''), lambda c: ascii(c)), [0])"


@_query("alert_fingerprint", f"""WITH {SQL_ALERTS}, d AS (SELECT DISTINCT rule_title, user_id FROM a)
SELECT rule_title, user_id, lower(lpad(to_hex(CAST(list_reduce(list_prepend({A.FNV_START}::UHUGEINT, list_transform({_BYTES}, lambda x: x::UHUGEINT)),
  lambda h, b: (xor(h, b) * {A.FNV_PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT) AS UBIGINT)), 16, '0')) AS fingerprint FROM d""")
def _(spark, sf):
    return A.dedup(alerts(spark, sf), ["rule_title", "user_id"], DAY).select("rule_title", "user_id", "fingerprint").distinct()


@_query("alert_repeats", f"""WITH {SQL_ALERTS}, {SQL_ISLANDS.format(by='rule_title, user_id', gap=DAY)},
s AS (SELECT *, (ts - min(ts) OVER (PARTITION BY rule_title, user_id, island)) // 43200 AS step FROM i)
SELECT seq, ts FROM s QUALIFY row_number() OVER (PARTITION BY rule_title, user_id, island, step ORDER BY ts, seq) = 1""")
def _(spark, sf):
    return A.repeats(alerts(spark, sf), ["rule_title", "user_id"], DAY, 43_200).select("seq", "ts")


@_query("incident_group_by", f"""WITH {SQL_ALERTS}, {SQL_ISLANDS.format(by='user_id', gap=DAY)}
SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_alerts, count(DISTINCT rule_title) AS n_rules FROM i GROUP BY user_id, island""")
def _(spark, sf):
    return A.incidents(alerts(spark, sf), ["user_id"], DAY).select("user_id", "start_ts", "end_ts", "n_alerts", "n_rules")


@_query("incident_entity_graph", f"""WITH RECURSIVE {SQL_ALERTS},
v AS (SELECT seq, 'b' || CAST(ts // 3600 AS VARCHAR) AS value FROM a UNION SELECT seq, 'c' || CAST(CAST(round_even(value * 100, 0) AS BIGINT) AS VARCHAR) FROM a WHERE round_even(value * 100, 0) <> 0),
n AS (SELECT row_number() OVER (ORDER BY value) AS id, value FROM (SELECT value FROM v GROUP BY 1 HAVING count(*) > 1)),
e AS (SELECT v.seq, n.id FROM v JOIN n USING (value)), link AS (SELECT DISTINCT x.id AS p, y.id AS q FROM e x JOIN e y USING (seq) WHERE x.id <> y.id),
reach AS (SELECT id AS p, id AS q FROM n UNION SELECT r.p, link.q FROM reach r JOIN link ON link.p = r.q),
least AS (SELECT r.p, min(e.seq) AS low FROM reach r JOIN e ON e.id = r.q GROUP BY 1)
SELECT a.seq, coalesce(min(least.low), a.seq) AS incident FROM a LEFT JOIN e ON e.seq = a.seq LEFT JOIN least ON least.p = e.id GROUP BY a.seq""")
def _(spark, sf):
    a = alerts(spark, sf).withColumns({"bucket": F.floor(F.col("ts") / 3600), "cents": F.round(F.col("value") * 100).cast("long")})
    return A.entity_incidents(a, A.EntityGraph(["bucket", "cents"], stop_values=["0"]))


@_query("risk_score", f"WITH {SQL_ALERTS} SELECT seq, CASE WHEN rule_title = 'costly' THEN 95.0::DOUBLE ELSE score::DOUBLE END AS score FROM a")
def _(spark, sf):
    return alerts(spark, sf).select("seq", risk.risk_score(None, F.col("tags"), F.col("level"), {"attack.t1041": 95.0, "attack.exfiltration": 10.0}).alias("score"))


@_query("risk_objects", """SELECT event_id, t.type AS type, t.value AS value FROM (
  SELECT event_id, unnest([{type: 'user', value: lower(trim(actor_user_name))}, {type: 'host', value: lower(trim(src_hostname))}, {type: 'host', value: lower(trim(dst_hostname))}]) AS t FROM security_events)
WHERE t.value IS NOT NULL AND t.value <> '' GROUP BY ALL""")
def _(spark, sf):
    rows = table(spark, sf, "security_events")
    return rows.select("event_id", F.explode(risk.risk_objects({"user": ["actor_user_name"], "host": ["src_hostname", "dst_hostname"]})).alias("o")).select("event_id", "o.type", "o.value").distinct()


def _scored(spark, sf):
    a = alerts(spark, sf)
    return a.select("seq", "ts", "user_id", risk.risk_score(None, F.col("tags"), F.col("level")).alias("score"), risk.tactics_of(F.col("tags")).alias("tactics"))


SQL_RISK = f"""WITH {SQL_ALERTS},
w AS (SELECT x.seq, x.ts, x.user_id, sum(y.score)::DOUBLE AS total, count(DISTINCT y.tactic) AS n_tactics FROM a x JOIN a y
  ON x.user_id = y.user_id AND y.ts > x.ts - {DAY} AND y.ts <= x.ts AND (y.ts < x.ts OR y.seq <= x.seq) GROUP BY 1, 2, 3)"""


@_query("risk_accumulate", f"{SQL_RISK} SELECT seq, user_id, total, n_tactics::BIGINT AS n_tactics FROM w")
def _(spark, sf):
    return risk.accumulate(_scored(spark, sf), ["user_id"], DAY).select("seq", "user_id", "total", F.col("n_tactics").cast("long").alias("n_tactics"))


@_query("risk_incident_triggers", f"{SQL_RISK} SELECT seq, user_id, total, CASE WHEN total >= 160 THEN 'score' ELSE 'tactic_count' END AS trigger FROM w WHERE total >= 160 OR n_tactics >= 3")
def _(spark, sf):
    return risk.risk_incidents(_scored(spark, sf), ["user_id"], DAY, 160.0, 3).select("seq", "user_id", "total", "trigger")


@_query("risk_incident_cooldown", f"""{SQL_RISK.replace('WITH', 'WITH RECURSIVE', 1)},
c AS (SELECT user_id, list({{seq: seq, ts: ts, total: total, n: n_tactics}} ORDER BY ts, seq) AS x FROM w WHERE total >= 100 OR n_tactics >= 3 GROUP BY 1),
s AS (SELECT user_id, x, x[1] AS cur FROM c UNION ALL
  SELECT user_id, x, list_filter(x, lambda y: y.ts >= cur.ts + {2 * DAY})[1] FROM s WHERE len(list_filter(x, lambda y: y.ts >= cur.ts + {2 * DAY})) > 0)
SELECT cur.seq AS seq, cur.ts AS ts, user_id, cur.total AS total, CASE WHEN cur.total >= 100 THEN 'score' ELSE 'tactic_count' END AS trigger FROM s""")
def _(spark, sf):
    return risk.risk_incidents(_scored(spark, sf), ["user_id"], DAY, 100.0, 3, cooldown_s=2 * DAY).select("seq", "ts", "user_id", "total", "trigger")


@_query("enrich_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 10) ON c_nationkey = n_nationkey WHERE n_name IS NOT NULL UNION ALL SELECT c_custkey, 'unknown' FROM customer WHERE c_nationkey >= 10 OR c_nationkey IS NULL")
def _(spark, sf):
    side = table(spark, sf, "nation").where("n_nationkey < 10")
    return enrich.lookup(table(spark, sf, "customer"), side, "c_nationkey", "n_nationkey", {"n_name": "unknown"}).select("c_custkey", "n_name")


@_query("enrich_template", f"WITH {SQL_ALERTS} SELECT seq, rule_title || ' by ' || CAST(user_id AS VARCHAR) || ' ()' AS summary FROM a")
def _(spark, sf):
    return alerts(spark, sf).withColumn("none", F.lit(None).cast("string")).select("seq", enrich.template("${rule_title} by ${user_id} (${none})").alias("summary"))


@_query("field_counts", "SELECT 'received_at' AS field, count(received_at) AS n FROM security_events UNION ALL SELECT 'dst_port', count(dst_port) FROM security_events UNION ALL SELECT 'metadata', count(metadata) FROM security_events UNION ALL SELECT 'metadata.sensor', count(*) FROM security_events WHERE json_exists(metadata, '$.sensor')")
def _(spark, sf):
    return schemas.field_counts(table(spark, sf, "security_events").select("received_at", "dst_port", "metadata"), ["metadata"]).where(F.col("field").isin("received_at", "dst_port", "metadata", "metadata.sensor"))


@_query("field_coverage", "SELECT * FROM (VALUES ('event_type', 'covered'), ('value', 'covered'), ('event_id', 'unknown'), ('ts', 'unknown'), ('user_id', 'unknown'), ('props', 'unknown')) v(field, status)")
def _(spark, sf):
    return schemas.field_coverage(schemas.field_counts(table(spark, sf, "events")), RULES).select("field", "status")


SIGNATURES = [
    schemas.Signature("lookup", [{"present": "dns_query_name"}], 50, {"category": "dns"}),
    schemas.Signature("process", [{"any_of": ["process_pid", "process_file_path"]}, {"not": {"equals": ["action", "blocked"]}}], 50, {"category": "process"}),
    schemas.Signature("login", [{"present": "auth_logon_type"}], 70), schemas.Signature("any", [{"has_any_field": True}], 1),
    schemas.Signature("web", [{"compare": ["dst_port", "==", 443]}, {"in": ["network_protocol", ["tcp", "udp"]]}], 60, {"category": "network"}),
]


@_query("schema_classify", """SELECT schema, count(*) AS n, sum(ambiguous::INT) AS n_ambiguous FROM (SELECT CASE WHEN auth_logon_type IS NOT NULL THEN 'login'
  WHEN dst_port = 443 AND lower(network_protocol) IN ('tcp', 'udp') THEN 'web' WHEN dns_query_name IS NOT NULL THEN 'lookup'
  WHEN (process_pid IS NOT NULL OR process_file_path IS NOT NULL) AND NOT coalesce(lower(action) = 'blocked', false) THEN 'process' ELSE 'any' END AS schema,
  (auth_logon_type IS NULL AND NOT coalesce(dst_port = 443 AND lower(network_protocol) IN ('tcp', 'udp'), false) AND dns_query_name IS NOT NULL
   AND (process_pid IS NOT NULL OR process_file_path IS NOT NULL) AND NOT coalesce(lower(action) = 'blocked', false)) AS ambiguous FROM security_events) GROUP BY 1""")
def _(spark, sf):
    out = schemas.route(schemas.classify(table(spark, sf, "security_events"), SIGNATURES))
    return out.groupBy("schema").agg(F.count("*").alias("n"), F.sum(F.col("ambiguous").cast("int")).alias("n_ambiguous"))


@_query("schema_shapes", "SELECT keys, count(*) AS n FROM (SELECT array_to_string(list_sort(json_keys(body)), ',') AS keys FROM stix_objects) GROUP BY 1")
def _(spark, sf):
    return schemas.shapes(table(spark, sf, "stix_objects"), "body").select(F.array_join("keys", ",").alias("keys"), "n")


@_query("schema_discover")
def _(spark, sf):
    found = schemas.shapes(table(spark, sf, "stix_objects"), "body")
    clusters = schemas.discover([(r["keys"], r["n"]) for r in found.limit(schemas.MAX_SHAPES + 1).collect()])
    return spark.createDataFrame([(i, c["n"], ",".join(c["core"]), ",".join(c["predicates"])) for i, c in enumerate(clusters)], "cluster int, n long, core string, predicates string")


@_query("triage_fp_ratio", "SELECT source AS rule, count(*) AS total, CASE WHEN count(*) >= 3 THEN round(avg((toxic = 0)::INT), 6) END AS fp_ratio FROM (SELECT d.source, l.doc_id, min(l.toxic) AS toxic FROM doc_labels l JOIN documents d USING (doc_id) WHERE toxic IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def _(spark, sf):
    labels = table(spark, sf, "doc_labels").where("toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    verdicts = labels.join(table(spark, sf, "documents").where("source is not null"), "doc_id").select(F.col("source").alias("rule"), F.when(F.col("toxic") == 0, "false_positive").otherwise("true_positive").alias("verdict"), F.col("doc_id").alias("dedup_key"), F.lit(0).alias("ts"))
    return reports.fp_ratio(verdicts, min_total=3)


@_query("backtest_expectations", f"WITH {SQL_ALERTS}, f AS (SELECT rule_title, count(*) AS fires FROM a GROUP BY 1) SELECT coalesce(f.rule_title, e.rule) AS rule_title, coalesce(fires, 0) AS fires, CASE WHEN e.rule IS NULL THEN 'unexpected' WHEN coalesce(fires, 0) < lo OR coalesce(fires, 0) > hi THEN 'failed' ELSE 'passed' END AS status FROM f FULL JOIN (VALUES ('errors', 1, 1000000000), ('costly', 0, 5), ('never', 1, 1000000000)) e(rule, lo, hi) ON f.rule_title = e.rule")
def _(spark, sf):
    fires = reports.fire_counts(alerts(spark, sf))
    return reports.backtest(fires, [{"rule": "errors", "at_least": 1}, {"rule": "costly", "at_most": 5}, {"rule": "never", "at_least": 1}])


@_query("hygiene_noisy_mad", "WITH f AS (SELECT rule_name AS r, count(*) AS n FROM security_events WHERE rule_name IS NOT NULL GROUP BY 1), m AS (SELECT median(n) AS mid FROM f) SELECT round(any_value(mid) + 3 * 1.4826 * median(abs(n - mid)), 6) AS noisy_limit FROM f, m")
def _(spark, sf):
    fires = table(spark, sf, "security_events").where("rule_name is not null").groupBy(F.col("rule_name").alias("rule_title")).agg(F.count("*").alias("fires"))
    return reports.noisy_limit(fires).select(F.round("limit", 6).alias("noisy_limit"))


@_query("hygiene", f"WITH {SQL_ALERTS} SELECT rule_title, count(*) AS fires, CASE WHEN rule_title = 'none' THEN '' ELSE 'no_owner,no_status' END AS findings FROM a GROUP BY 1")
def _(spark, sf):
    return reports.hygiene(RULES, reports.fire_counts(alerts(spark, sf))).select("rule_title", "fires", F.array_join(F.filter("findings", lambda x: x != "noisy"), ",").alias("findings"))


@_query("coverage_gaps", "SELECT t AS technique FROM (VALUES ('T1003'), ('T1486')) v(t)")
def _(spark, sf):
    covered = spark.createDataFrame(reports.techniques(RULES), "rule string, technique string")
    return reports.coverage_gaps(covered, spark.createDataFrame([("T1003",), ("T1059",), ("T1486",), ("T1041",)], "technique string"))


@_query("scorecard_verdict", f"""WITH {SQL_ALERTS}, f AS (SELECT rule_title, count(*) AS fires, count(*) FILTER (user_id % 4 = 0) AS unexpected, max(ts) AS last_ts FROM a GROUP BY 1)
SELECT rule_title, round((fires - unexpected) / fires, 6) AS precision, CASE WHEN (fires - unexpected) / fires < 0.2 THEN 'retire' WHEN (fires - unexpected) / fires < 0.8 THEN 'tune' WHEN 1706745600 - last_ts <= 7776000 THEN 'keep' ELSE 'tune' END AS verdict FROM f""")
def _(spark, sf):
    fires = alerts(spark, sf).groupBy("rule_title").agg(F.count("*").alias("fires"), F.sum((F.col("user_id") % 4 == 0).cast("long")).alias("unexpected"), F.max("ts").alias("last_ts"))
    rows = fires.withColumns({"live_fp": F.lit(None).cast("double"), "sole_coverage": F.lit(False)})
    return reports.scorecard(rows, reports.Limits(), 1706745600).select("rule_title", "precision", "verdict")


@_query("visibility", "SELECT event_type, CASE WHEN s >= 1 THEN 4 WHEN s >= 0.75 THEN 3 WHEN s >= 0.5 THEN 2 WHEN s > 0 THEN 1 ELSE 0 END AS visibility FROM (SELECT event_type, ((count(src_ip) > 0)::INT + (count(dst_port) > 0)::INT + (count(process_pid) > 0)::INT + (count(auth_logon_type) > 0)::INT) / 4 AS s FROM security_events GROUP BY 1)")
def _(spark, sf):
    seen = [(F.count(c) > 0).cast("int") for c in ("src_ip", "dst_port", "process_pid", "auth_logon_type")]
    return table(spark, sf, "security_events").groupBy("event_type").agg(sum(seen[1:], seen[0]).alias("n")).select("event_type", reports.visibility_score(F.col("n"), F.lit(4)).alias("visibility"))


# -- formats ----------------------------------------------------------------------------------------------
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "value"))


SQL_LINES = "l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS value FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS lines, unnest(generate_series(1, len(string_split_regex(text, '\\r?\\n')))) AS i FROM documents WHERE text IS NOT NULL))"
SYSLOG_RE = "^<([0-9]{1,3})>([0-9]{4}-[0-9]{2}-[0-9]{2}T[^ ]+) ([^ ]+) ([^:\\[ ]+): ?(.*)$"


@_query("format_auto", f"WITH {SQL_LINES} SELECT format, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(ltrim(value), '^[\\{{\\[]') AND json_valid(value) THEN 'json' WHEN regexp_matches(value, '{SYSLOG_RE}') THEN 'syslog' ELSE 'plain' END AS format FROM l WHERE NOT regexp_full_match(value, ' *')) GROUP BY 1")
def _(spark, sf):
    return formats.parse_lines(log_lines(spark, sf)).groupBy("format").agg(F.count("*").alias("n"))


@_query("format_syslog", f"WITH {SQL_LINES} SELECT doc_id, line_no, (regexp_extract(value, '{SYSLOG_RE}', 1)::INT // 8)::VARCHAR AS facility, regexp_extract(value, '{SYSLOG_RE}', 3) AS hostname, regexp_extract(value, '{SYSLOG_RE}', 4) AS appname, regexp_extract(value, '{SYSLOG_RE}', 5) AS message FROM l WHERE regexp_matches(value, '{SYSLOG_RE}')")
def _(spark, sf):
    parsed = formats.parse_lines(log_lines(spark, sf), "syslog").where(F.element_at("body", F.lit("facility")).isNotNull())
    return parsed.select("doc_id", "line_no", *[F.element_at("body", F.lit(c)).alias(c) for c in ("facility", "hostname", "appname", "message")])


@_query("format_cef", f"WITH {SQL_LINES} SELECT doc_id, line_no, regexp_extract(value, 'CEF:[0-9]+\\|([^|]*)\\|', 1) AS vendor, regexp_extract(value, 'src=([^ ]+)', 1) AS src FROM l WHERE regexp_matches(value, 'CEF:[0-9]+\\|[^|]*\\|[^|]*\\|[^|]*\\|[^|]*\\|[^|]*\\|[^|]*\\|') AND contains(value, ' dst=')")
def _(spark, sf):
    parsed = formats.parse_lines(log_lines(spark, sf), "cef").where(F.map_contains_key("body", F.lit("dst")))
    return parsed.select("doc_id", "line_no", F.element_at("body", F.lit("deviceVendor")).alias("vendor"), F.element_at("body", F.lit("src")).alias("src"))


@_query("format_logfmt", f"WITH {SQL_LINES} SELECT doc_id, line_no, regexp_extract(value, 'msg=\"([^\"]*)\"', 1) AS msg, regexp_extract(value, 'duration=([^ ]+)', 1) AS duration FROM l WHERE regexp_matches(value, ' level=[a-z]+ msg=\"[^\"]*\" ') AND contains(value, 'duration=')")
def _(spark, sf):
    lines = log_lines(spark, sf).where(F.col("value").rlike(' level=[a-z]+ msg="[^"]*" ') & F.contains("value", F.lit("duration=")))
    return formats.parse_lines(lines, "logfmt").select("doc_id", "line_no", F.element_at("body", F.lit("msg")).alias("msg"), F.element_at("body", F.lit("duration")).alias("duration"))


@_query("format_json", f"WITH {SQL_LINES} SELECT doc_id, line_no, value->>'$.EventType' AS event_type, value->>'$.User' AS who FROM l WHERE regexp_matches(ltrim(value), '^[\\{{]') AND json_valid(value)")
def _(spark, sf):
    parsed = formats.parse_lines(log_lines(spark, sf), "json")
    return parsed.select("doc_id", "line_no", F.try_element_at("body", F.lit("EventType")).alias("event_type"), F.try_element_at("body", F.lit("User")).alias("who"))


@_query("event_filter", "SELECT rec_no, count(*) AS n FROM (SELECT rec_no, unnest(CASE WHEN json_type(body, '$.external_references') = 'ARRAY' THEN json_extract(body, '$.external_references[*]') ELSE [json_extract(body, '$.external_references')] END) AS x FROM stix_objects WHERE json_type(body, '$.external_references') NOT IN ('NULL')) GROUP BY 1")
def _(spark, sf):
    return formats.explode_path(table(spark, sf, "stix_objects").select("rec_no", "body"), "body", "$.external_references").groupBy("rec_no").agg(F.count("*").alias("n"))


@_query("sink_finding", f"WITH {SQL_ALERTS} SELECT seq, 2004 AS class_uid, CASE level WHEN 'high' THEN 4 WHEN 'medium' THEN 3 ELSE 2 END AS severity_id, rule_title AS title FROM a")
def _(spark, sf):
    out = alerts(spark, sf).select("seq", sinks.finding(alerts(spark, sf)).alias("j"))
    return out.select("seq", F.get_json_object("j", "$.class_uid").cast("int").alias("class_uid"), F.get_json_object("j", "$.severity_id").cast("int").alias("severity_id"), F.get_json_object("j", "$.finding_info.title").alias("title"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
