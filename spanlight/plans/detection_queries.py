"""Contract queries of detection and correlation, and the SQL they must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators import correlate as C
from spanlight.operators.detect import detect, matching
from spanlight.rules.model import Collection, load_rules
from spanlight.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _rule(yaml: str) -> Collection:
    out = load_rules(yaml)
    if out.errors:
        raise ValueError(out.errors)
    return out


def _simple(name: str, source: str, keep: list[str], detection: str, sql: str, json: set[str] = frozenset(), version: str = "") -> None:
    """Register a query for one rule: the kept columns of the matching rows of ``source``."""
    rules = _rule(f"title: {name}\n{version}detection:\n{detection}")

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return matching(table(spark, sf, source), rules, rules.rules[0], json).select(*keep)

    query.__name__ = name
    QUERIES[name] = query
    ORACLES[name] = f"SELECT {', '.join(keep)} FROM {source} WHERE {sql}"


SE = ["event_id", "received_at"]
_simple("detect_exact", "security_events", SE, "  s: {event_type: DNS_Query}\n  condition: s", "lower(event_type) = 'dns_query'")
_simple("detect_value_list", "events", ["event_id"], "  s: {event_type: [error, Click]}\n  condition: s", "lower(event_type) IN ('error', 'click')")
_simple("detect_contains", "security_events", SE, "  s: {process_command_line|contains: PowerShell}\n  condition: s", "contains(lower(process_command_line), 'powershell')")
_simple("detect_startswith", "security_events", SE, "  s: {src_hostname|startswith: 'SRV-'}\n  condition: s", "starts_with(lower(src_hostname), 'srv-')")
_simple("detect_endswith", "security_events", SE, "  s: {process_file_path|endswith: '\\cmd.exe'}\n  condition: s", "ends_with(lower(process_file_path), '\\cmd.exe')")
_simple("detect_wildcard", "security_events", SE, "  s: {dns_query_name: 's*.example'}\n  condition: s", "regexp_matches(dns_query_name, '(?is)^s.*\\.example$')")
_simple("detect_single_wildcard", "part", ["p_partkey"], "  s: {p_brand: 'brand#?3'}\n  condition: s", "regexp_matches(p_brand, '(?is)^brand#.3$')")
_simple("detect_regex", "documents", ["doc_id"], "  s: {text|re: 'OPS-[0-9]{4}7'}\n  condition: s", "regexp_matches(text, 'OPS-[0-9]{4}7')")
_simple("detect_regex_ignorecase", "documents", ["doc_id"], "  s: {text|re|i: 'rule [a-z]+ (dns|pipe)'}\n  condition: s", "regexp_matches(text, '(?i)rule [a-z]+ (dns|pipe)')")
_simple("detect_cased", "security_events", SE, "  s: {actor_user_domain|cased: LAB}\n  condition: s", "actor_user_domain = 'LAB'")
_simple("detect_all_modifier", "documents", ["doc_id"], "  s: {text|contains|all: [beacon, 'the ']}\n  condition: s", "contains(lower(text), 'beacon') AND contains(lower(text), 'the ')")
_simple("detect_numeric_range", "orders", ["o_orderkey"], "  s: {o_totalprice|gte: 100000}\n  t: {o_totalprice|lt: 200000}\n  condition: s and t", "o_totalprice >= 100000 AND o_totalprice < 200000")
_simple("detect_numeric_equal", "lineitem", ["l_orderkey", "l_linenumber"], "  s: {l_quantity: 17}\n  condition: s", "abs(l_quantity - 17) < 2.220446049250313e-16")
_simple("detect_neq", "security_events", SE, "  s: {action|neq: allowed}\n  condition: s", "action IS NOT NULL AND lower(action) <> 'allowed'")
_simple("detect_exists", "security_events", SE, "  s: {dst_port|exists: true}\n  t: {rule_id|exists: false}\n  condition: s and t", "dst_port IS NOT NULL AND rule_id IS NULL")
_simple("detect_null", "security_events", SE, "  s: {rule_name: null}\n  condition: not s", "rule_name IS NOT NULL")
_simple("detect_bool", "stix_objects", ["rec_no"], "  s: {revoked: true}\n  condition: s", "revoked")
_simple("detect_json_field", "events", ["event_id"], "  s: {props.k|gte: 80}\n  condition: s", "try_cast(props->>'$.k' AS DOUBLE) >= 80", {"props"})
_simple("detect_fieldref", "lineitem", ["l_orderkey", "l_linenumber"], "  s: {l_quantity|fieldref: l_linenumber}\n  condition: s", "l_quantity = l_linenumber")
_simple("detect_expand", "nation", ["n_nationkey"], "  s: {n_name|expand: '%n_name%'}\n  condition: s", "n_name IS NOT NULL")
_simple("detect_timestamp_parts", "orders", ["o_orderkey"], "  s: {o_orderdate|month: 3}\n  t: {o_orderdate|week: 10}\n  condition: s or t", "month(o_orderdate) = 3 OR week(o_orderdate) = 10")
_simple("detect_cidr", "security_events", SE, "  s: {src_ip|cidr: 10.128.0.0/9}\n  condition: s", "regexp_matches(src_ip, '^10\\.(12[89]|1[3-9][0-9]|2[0-4][0-9]|25[0-5])\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')")
_simple("detect_cidr6", "security_events", SE, "  s: {src_ip|cidr: '2001:db8::/32'}\n  condition: s", "regexp_matches(lower(src_ip), '^2001:0?db8:[0-9a-f:]+$')")
_simple("detect_windash", "security_events", SE, "  s: {process_command_line|windash|contains: ' -c '}\n  condition: s", "regexp_matches(lower(process_command_line), ' [-/–—―]c ')")
_simple("detect_base64", "documents", ["doc_id"], "  s: {text|base64offset|contains: ab}\n  condition: s", "contains(lower(text), 'ywi') OR contains(lower(text), 'fi') OR contains(lower(text), 'hyg')")
_simple("detect_keywords", "documents", ["doc_id"], "  k: [mutex, 'hidden window']\n  condition: k", "contains(lower(coalesce(text,'')), 'mutex') OR contains(lower(coalesce(text,'')), 'hidden window') OR contains(lower(coalesce(source,'')), 'mutex') OR contains(lower(coalesce(source,'')), 'hidden window') OR contains(lower(coalesce(lang,'')), 'mutex') OR contains(lower(coalesce(doc_kind,'')), 'mutex')")
_simple("detect_selector_n_of", "security_events", SE, "  x_a: {category: dns}\n  x_b: {action: blocked}\n  x_c: {severity|gte: 2}\n  condition: 2 of x_*", "coalesce(lower(category) = 'dns', false)::INT + coalesce(lower(action) = 'blocked', false)::INT + coalesce(severity >= 2, false)::INT >= 2")
_simple("detect_selector_all_of", "events", ["event_id"], "  a: {event_type: purchase}\n  b: {value|gt: 50}\n  _c: {user_id: 1}\n  condition: all of them", "event_type = 'purchase' AND value > 50")
_simple("detect_list_of_maps", "events", ["event_id"], "  s:\n    - {event_type: error, value|gt: 100}\n    - {event_type: view}\n  condition: s", "(event_type = 'error' AND value > 100) OR event_type = 'view'")
_simple("detect_many_substrings", "documents", ["doc_id"], "  s: {text|contains: [certutil, rundll32, mshta, wscript, cscript, regsvr32, bitsadmin, powershell, python3]}\n  condition: s", "regexp_matches(text, '(?i)certutil|rundll32|mshta|wscript|cscript|regsvr32|bitsadmin|powershell|python3')")
_simple("detect_array_any", "stix_reports", ["id", "added_at"], "  s:\n    'object_refs[any]': '*malware--*'\n  condition: s", "coalesce(len(list_filter(object_refs, lambda x: contains(lower(x), 'malware--'))) > 0, false)")
_simple("detect_array_all", "risk_incidents", ["risk_incident_id", "emitted_at"], "  s:\n    'tactics[all]': ['*execution*', '*stealth*']\n  condition: s", "coalesce(len(tactics) > 0 AND len(list_filter(tactics, lambda x: contains(lower(x), 'execution') OR contains(lower(x), 'stealth'))) = len(tactics), false)")
_simple("detect_array_none", "risk_incidents", ["risk_incident_id", "emitted_at"], "  s:\n    'tactics[none]': execution\n  condition: s", "coalesce(len(list_filter(tactics, lambda x: lower(x) = 'execution')), 0) = 0")
_simple("detect_array_member", "embeddings", ["vec_id"], "  s: {embedding|gt: 0.3}\n  condition: s", "len(list_filter(embedding, lambda x: x > 0.3)) > 0")
_simple("detect_array_index", "embeddings", ["vec_id"], "  s: {'embedding[0]|gt': 0.1, 'embedding[-1]|lt': 0}\n  condition: s", "embedding[1] > 0.1 AND embedding[-1] < 0")


def _query(name: str, sql: str | None = None):
    def add(function):
        function.__name__ = name
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


FILTERED = _rule("""
title: errors
id: r-errors
detection: {s: {event_type: error}, condition: s}
---
title: not for service users
filter:
  rules: [r-errors]
  f: {user_id|lt: 5}
  condition: not f
""")


@_query("detect_filter_rule", "SELECT event_id, 'errors' AS rule_title FROM events WHERE event_type = 'error' AND NOT (user_id < 5)")
def _(spark, sf):
    return detect(table(spark, sf, "events"), FILTERED, ["event_id"]).select("event_id", "rule_title")


MANY = _rule("\n---\n".join(
    f"title: {t}\nlevel: {lvl}\nlogsource: {{category: {cat}}}\ndetection: {{s: {s}, condition: s}}"
    for t, lvl, cat, s in [
        ("dns lookups", "low", "dns", "{event_type: dns_query}"), ("blocked", "medium", "'*'", "{action: blocked}"),
        ("shells", "high", "process", "{process_file_path|endswith: [cmd.exe, bash]}"), ("wide", "low", "network", "{event_id|gte: 0}"),
    ]
))


@_query("detect_logsource_prune", """
SELECT rule_title, count(*) AS n FROM (
  SELECT 'dns lookups' AS rule_title FROM security_events WHERE event_type = 'dns_query' AND coalesce(lower(nullif(trim(category), '')) = 'dns', true)
  UNION ALL SELECT 'blocked' FROM security_events WHERE action = 'blocked'
  UNION ALL SELECT 'shells' FROM security_events WHERE (lower(process_file_path) = 'cmd.exe' OR ends_with(lower(process_file_path), 'cmd.exe') OR ends_with(lower(process_file_path), 'bash')) AND coalesce(lower(nullif(trim(category), '')) = 'process', true)
  UNION ALL SELECT 'wide' FROM security_events WHERE event_id >= 0 AND coalesce(lower(nullif(trim(category), '')) = 'network', true)
) GROUP BY 1""")
def _(spark, sf):
    found = detect(table(spark, sf, "security_events"), MANY, ["event_id"], logsource={"category": F.col("category")})
    return found.groupBy("rule_title").agg(F.count("*").alias("n"))


def many_rules(n: int) -> tuple[Collection, str]:
    """``n`` rules over five fields, of six forms, and the same as SQL: a table of (rule, test) alternatives."""
    tools = ["certutil", "powershell", "bash", "ssh", "python3", "curl", "rundll32", "wscript"]
    rules, legs = [], []
    for i in range(n):
        tool, end = tools[i % len(tools)], f"{i:03d}"
        if i % 6 == 0:
            body, test = f"{{s: {{process_command_line|contains: 'cdn{i}.'}}, condition: s}}", f"contains(lower(process_command_line), 'cdn{i}.')"
        elif i % 6 == 1:
            body, test = f"{{s: {{src_hostname|endswith: '-00{end}', category: dns}}, t: {{action: blocked}}, condition: s and not t}}", f"ends_with(lower(src_hostname), '-00{end}') AND coalesce(lower(category) = 'dns', false) AND NOT coalesce(lower(action) = 'blocked', false)"
        elif i % 6 == 2:
            body, test = f"{{s: {{process_command_line|contains|all: ['{tool}', '{i} ']}}, condition: s}}", f"contains(lower(process_command_line), '{tool}') AND contains(lower(process_command_line), '{i} ')"
        elif i % 6 == 3:
            body, test = f"{{s: {{dns_query_name|startswith: ['ines{i % 40}.', 'cdn{i % 40}.'], src_hostname|contains: '-{end[1:]}'}}, condition: s}}", f"(starts_with(lower(dns_query_name), 'ines{i % 40}.') OR starts_with(lower(dns_query_name), 'cdn{i % 40}.')) AND contains(lower(src_hostname), '-{end[1:]}')"
        elif i % 6 == 4:
            body, test = f"{{s: {{process_file_path|endswith: '{tool}*'}}, t: {{src_ip|startswith: '10.{i % 256}.'}}, condition: all of them}}", f"regexp_matches(lower(process_file_path), '{tool}.*$') AND starts_with(lower(src_ip), '10.{i % 256}.')"
        else:
            body, test = f"{{s: [{{src_hostname: 'lt-oslo-00{end}'}}, {{dst_hostname: 'fs-pune-00{end}'}}], condition: s}}", f"coalesce(lower(src_hostname) = 'lt-oslo-00{end}', false) OR coalesce(lower(dst_hostname) = 'fs-pune-00{end}', false)"
        rules.append(f"title: rule {i:04d}\ndetection: {body}")
        legs.append(f"SELECT 'rule {i:04d}' AS rule_title, count(*) AS n FROM security_events WHERE {test} HAVING count(*) > 0")
    return load_rules("\n---\n".join(rules)), " UNION ALL ".join(legs)


def _many(name: str, n: int) -> None:
    collection, sql = many_rules(n)

    @_query(name, sql)
    def _(spark, sf):
        return detect(table(spark, sf, "security_events"), collection, []).groupBy("rule_title").agg(F.count("*").alias("n"))


_many("detect_100_rules", 100)
_many("detect_1000_rules", 1000)


@_query("detect_matched_selections", "SELECT event_id, CASE WHEN event_type = 'error' AND value > 100 THEN 'big,err' WHEN event_type = 'error' THEN 'err' ELSE 'big' END AS selections FROM events WHERE event_type = 'error' OR value > 100")
def _(spark, sf):
    rules = _rule("title: t\ndetection: {big: {value|gt: 100}, err: {event_type: error}, condition: 1 of them}")
    return detect(table(spark, sf, "events"), rules, ["event_id"]).select("event_id", F.array_join("matched_selections", ",").alias("selections"))


# -- correlations -----------------------------------------------------------------------------------------
BASE = """
title: errors
name: errors
detection: {s: {event_type: error}, condition: s}
---
title: purchases
name: purchases
detection: {s: {event_type: purchase}, condition: s}
---
title: all
name: all
detection: {s: {event_id|gte: 0}, condition: s}
"""
TS = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


def _correlation(body: str) -> tuple:
    rules = _rule(BASE + "---\ntitle: corr\ncorrelation:\n" + body)
    return rules, rules.correlations[0]


def _corr(name: str, body: str, sql: str | None) -> None:
    rules, correlation = _correlation(body)

    @_query(name, sql)
    def _(spark, sf):
        out = C.correlate(table(spark, sf, "events"), rules, correlation, "ts", "event_id", {"props"})
        keys = [F.col(f"k{i}").alias(g) for i, g in enumerate(correlation.group_by)]
        return out.select(F.col("seq").alias("event_id"), *keys, F.round("value", 4).alias("value"))


def _earlier(where: str, value: str, condition: str, span: int) -> str:
    """Every event with what arrived before it in the closed window, by a self-join."""
    return f"""
WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, value, {TS} AS t FROM events WHERE {where})
SELECT a.event_id, a.user_id, round(CAST({value} AS DOUBLE), 4) AS value
FROM m a JOIN m b ON a.user_id IS NOT DISTINCT FROM b.user_id AND b.t BETWEEN a.t - {span} AND a.t AND (b.t < a.t OR b.event_id <= a.event_id)
GROUP BY a.event_id, a.user_id HAVING {condition}"""


_corr("corr_event_count_sliding", "  {type: event_count, rules: [errors], group-by: [user_id], timespan: 2d, condition: {gte: 3}}", _earlier("event_type = 'error'", "count(*)", "count(*) >= 3", 172800))
_corr("corr_value_count", "  {type: value_count, rules: [all], group-by: [user_id], timespan: 1d, condition: {gte: 3, field: event_type}}", _earlier("true", "count(DISTINCT b.event_type)", "count(DISTINCT b.event_type) >= 3", 86400))
_corr("corr_value_sum", "  {type: value_sum, rules: [purchases], group-by: [user_id], timespan: 3d, condition: {gt: 150, field: value}}", _earlier("event_type = 'purchase'", "sum(b.value)", "sum(b.value) > 150", 259200))
_corr("corr_value_avg", "  {type: value_avg, rules: [purchases], group-by: [user_id], timespan: 3d, condition: {gt: 60, field: value}}", _earlier("event_type = 'purchase'", "avg(b.value)", "avg(b.value) > 60", 259200))
_corr("corr_value_median", "  {type: value_median, rules: [all], group-by: [user_id], timespan: 1d, condition: {gt: 60, field: value}}", _earlier("true", "quantile_cont(b.value, 0.5)", "quantile_cont(b.value, 0.5) > 60", 86400))
_corr("corr_value_percentile", "  {type: value_percentile, rules: [all], group-by: [user_id], timespan: 1d, condition: {gt: 90, field: value, percentile: 90}}", _earlier("true", "quantile_cont(b.value, 0.9)", "quantile_cont(b.value, 0.9) > 90", 86400))
_corr("corr_temporal", "  {type: temporal, rules: [errors, purchases], group-by: [user_id], timespan: 6h, condition: {gte: 2}}", _earlier("event_type IN ('error', 'purchase')", "count(DISTINCT b.event_type)", "count(DISTINCT b.event_type) >= 2", 21600))
_corr("corr_temporal_expression", "  {type: temporal, rules: [errors, purchases], group-by: [user_id], timespan: 6h, condition: errors and not purchases}", _earlier("event_type IN ('error', 'purchase')", "count(DISTINCT b.event_type)", "bool_or(b.event_type = 'error') AND NOT bool_or(b.event_type = 'purchase')", 21600))
_corr("corr_temporal_ordered", "  {type: temporal_ordered, rules: [errors, purchases], group-by: [user_id], timespan: 6h, condition: {gte: 2}}", f"""
WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, {TS} AS t FROM events WHERE event_type IN ('error', 'purchase')),
w AS (SELECT a.event_id, a.user_id, b.event_type, b.t FROM m a JOIN m b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 21600 AND a.t AND (b.t < a.t OR b.event_id <= a.event_id))
SELECT event_id, user_id, CAST(2 AS DOUBLE) AS value FROM w GROUP BY 1, 2
HAVING min(t) FILTER (event_type = 'error') <= max(t) FILTER (event_type = 'purchase')""")
_corr("corr_event_count_tumbling", "  {type: event_count, rules: [errors], group-by: [user_id], timespan: 1d, window: tumbling, condition: {gte: 2}}", f"""
WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, {TS} AS t FROM events WHERE event_type = 'error')
SELECT event_id, user_id, value FROM (
  SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id, t // 86400 ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value FROM m) WHERE value >= 2""")
_corr("corr_event_count_session", "  {type: event_count, rules: [all], group-by: [user_id], timespan: 1000d, window: session, gap: 8h, condition: {gte: 3}}", f"""
WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, {TS} AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 28800 THEN 1 ELSE 0 END AS cut FROM m),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT event_id, user_id, value FROM (
  SELECT event_id, user_id, CAST(count(*) OVER (PARTITION BY user_id, sid ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value FROM s) WHERE value >= 3""")
_corr("corr_session_cap", "  {type: event_count, rules: [all], group-by: [user_id], timespan: 12h, window: session, gap: 8h, condition: {gte: 3}}", None)
_corr("corr_aliases", "  {type: temporal, rules: [errors, purchases], group-by: [who], aliases: {who: {errors: user_id, purchases: user_id}}, timespan: 6h, condition: {gte: 2}}", None)
ORACLES["corr_aliases"] = _earlier("event_type IN ('error', 'purchase')", "count(DISTINCT b.event_type)", "count(DISTINCT b.event_type) >= 2", 21600).replace("a.event_id, a.user_id, round", "a.event_id, a.user_id AS who, round")


def _folded(name: str, extra: str, sql: str | None = None) -> None:
    rules = _rule(BASE + f"---\ntitle: corr\ncorrelation: {{type: event_count, rules: [errors], group-by: [user_id], timespan: 2d, condition: {{gte: 2}}}}\ncustom_attributes: {{{extra}}}")

    @_query(name, sql)
    def _(spark, sf):
        out = C.correlate(table(spark, sf, "events"), rules, rules.correlations[0], "ts", "event_id")
        return out.select(F.col("seq").alias("event_id"), F.col("k0").alias("user_id"), "value")


# what is let through is found step by step, from each firing to the first one that is no longer muted
_folded("corr_suppress", "suppress: 5d", f"""
WITH RECURSIVE m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, {TS} AS t FROM events WHERE event_type = 'error'),
f AS (SELECT a.event_id, a.user_id, a.t, count(*) AS n FROM m a JOIN m b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 172800 AND a.t AND (b.t < a.t OR b.event_id <= a.event_id) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM f),
p AS (SELECT o.user_id, o.i, (SELECT min(x.i) FROM o x WHERE x.user_id = o.user_id AND x.i > o.i AND x.t - o.t >= 432000) AS next FROM o),
r AS (SELECT user_id, CAST(1 AS BIGINT) AS i FROM o WHERE i = 1 UNION ALL SELECT p.user_id, p.next FROM r JOIN p ON p.user_id = r.user_id AND p.i = r.i WHERE p.next IS NOT NULL)
SELECT o.event_id, o.user_id, CAST(o.n AS DOUBLE) AS value FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i""")
LISTED = f"WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS user_id, list({{{{id: event_id, t: {TS}}}}} ORDER BY {TS}, event_id) AS x FROM events{{where}} GROUP BY 1)"
# one step per event: the event that waits for a second one, until that fires or comes too late
_folded("corr_reset", "action: reset", LISTED.format(where=" WHERE event_type = 'error'") + """,
s AS (SELECT user_id, x, 1 AS i, false AS fires, x[1].t AS waits FROM c
  UNION ALL SELECT user_id, x, i + 1, coalesce(x[i + 1].t - waits <= 172800, false), CASE WHEN coalesce(x[i + 1].t - waits <= 172800, false) THEN NULL ELSE x[i + 1].t END FROM s WHERE i < len(x))
SELECT x[i].id AS event_id, user_id, 2.0::DOUBLE AS value FROM s WHERE fires""")
# one step per event: its session's start and its place in it
ORACLES["corr_session_cap"] = LISTED.format(where="") + """,
s AS (SELECT user_id, x, 1 AS i, x[1].t AS began, 1 AS n FROM c
  UNION ALL SELECT user_id, x, i + 1, CASE WHEN x[i + 1].t - x[i].t > 28800 OR x[i + 1].t - began > 43200 THEN x[i + 1].t ELSE began END,
    CASE WHEN x[i + 1].t - x[i].t > 28800 OR x[i + 1].t - began > 43200 THEN 1 ELSE n + 1 END FROM s WHERE i < len(x))
SELECT x[i].id AS event_id, user_id, n::DOUBLE AS value FROM s WHERE n >= 3"""


NEWEST = """WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, value, {ts} AS t FROM events),
p AS (SELECT a.event_id, a.user_id, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY b.t DESC, b.event_id DESC) AS back FROM m a JOIN m b
  ON a.user_id = b.user_id AND b.t BETWEEN a.t - 864000 AND a.t AND (b.t < a.t OR b.event_id <= a.event_id))
SELECT event_id, user_id, {value} AS value FROM p WHERE back <= 3 GROUP BY 1, 2 HAVING {value} >= {least}"""


def _newest(name: str, condition: str, value: str, least: float) -> None:
    rules = _rule(BASE + f"---\ntitle: corr\ncorrelation: {{{condition}, rules: [all], group-by: [user_id], timespan: 10d}}\ncustom_attributes: {{max_group_entries: 3}}")

    @_query(name, NEWEST.format(ts=TS, value=value, least=least))
    def _(spark, sf):
        out = C.correlate(table(spark, sf, "events"), rules, rules.correlations[0], "ts", "event_id")
        return out.select(F.col("seq").alias("event_id"), F.col("k0").alias("user_id"), F.round("value", 4).alias("value"))


_newest("corr_newest_entries_count", "type: event_count, condition: {gte: 2}", "count(*)::DOUBLE", 2)
_newest("corr_newest_entries_sum", "type: value_sum, condition: {gte: 150, field: value}", "round(coalesce(sum(value), 0), 4)", 150)


@_query("corr_all", f"""
WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, {TS} AS t FROM events WHERE event_type = 'error'),
f AS (SELECT a.event_id, a.user_id, a.t, count(*) AS n FROM m a JOIN m b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 172800 AND a.t AND (b.t < a.t OR b.event_id <= a.event_id) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
g AS (SELECT a.event_id, a.user_id, count(*) AS n FROM f a JOIN f b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 432000 AND a.t AND (b.t < a.t OR b.event_id <= a.event_id) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT 'inner' AS correlation, event_id, user_id, n::DOUBLE AS value FROM f UNION ALL SELECT 'outer', event_id, user_id, n::DOUBLE FROM g""")
def _(spark, sf):
    rules = _rule(BASE + """---
title: outer
correlation: {type: event_count, rules: [inner], group-by: [user_id], timespan: 5d, condition: {gte: 2}}
---
title: inner
correlation: {type: event_count, rules: [errors], group-by: [user_id], timespan: 2d, condition: {gte: 2}}
""")
    fired = C.correlate_all(table(spark, sf, "events"), rules, "ts", "event_id")
    return reduce(DataFrame.unionByName, fired.values()).select("correlation", F.col("seq").alias("event_id"), F.col("k0").alias("user_id"), "value")


@_query("corr_chain", f"""
WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, {TS} AS t FROM events WHERE event_type = 'error'),
f AS (SELECT a.event_id, a.user_id, a.t FROM m a JOIN m b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 172800 AND a.t AND (b.t < a.t OR b.event_id <= a.event_id) GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT a.event_id, a.user_id, CAST(count(*) AS DOUBLE) AS value FROM f a JOIN f b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 432000 AND a.t AND (b.t < a.t OR b.event_id <= a.event_id) GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, sf):
    rules, inner = _correlation("  {type: event_count, rules: [errors], group-by: [user_id], timespan: 2d, condition: {gte: 2}}")
    outer = _rule("title: outer\ncorrelation: {type: event_count, rules: [corr], group-by: [user_id], timespan: 5d, condition: {gte: 2}}").correlations[0]
    fired = C.correlate(table(spark, sf, "events"), rules, inner, "ts", "event_id")
    return C.chain([("corr", fired)], outer).select(F.col("seq").alias("event_id"), F.col("k0").alias("user_id"), "value")


@_query("corr_event_refs", f"""
WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, {TS} AS t FROM events WHERE event_type = 'error')
SELECT a.event_id, a.user_id, CAST(count(*) AS DOUBLE) AS value, CAST(least(count(*), 3) AS BIGINT) AS n_refs
FROM m a JOIN m b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 172800 AND a.t AND (b.t < a.t OR b.event_id <= a.event_id)
GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, sf):
    rules, c = _correlation("  {type: event_count, rules: [errors], group-by: [user_id], timespan: 2d, condition: {gte: 2}}")
    rows = C.matches(table(spark, sf, "events"), rules, c, "ts", "event_id")
    return C.last_events(rows, c, 3).select(F.col("seq").alias("event_id"), F.col("k0").alias("user_id"), "value", F.size("event_refs").cast("long").alias("n_refs"))


@_query("corr_introspect", f"""
WITH m AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, {TS} AS t FROM events WHERE event_type = 'error'),
l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) = 1)
SELECT l.user_id, l.t AS ts, CAST(count(*) AS DOUBLE) AS value, CAST(3 - count(*) AS DOUBLE) AS missing FROM l JOIN m b ON l.user_id = b.user_id AND b.t BETWEEN l.t - 172800 AND l.t GROUP BY 1, 2""")
def _(spark, sf):
    rules, c = _correlation("  {type: event_count, rules: [errors], group-by: [user_id], timespan: 2d, condition: {gte: 3}}")
    rows = C.matches(table(spark, sf, "events"), rules, c, "ts", "event_id")
    return C.current_state(rows, c).select(F.col("k0").alias("user_id"), "ts", "value", "missing")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
