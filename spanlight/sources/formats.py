"""Input formats: lines of text to one envelope, ``format, body (map of texts), raw``.

JSON lines become the map of their leaves (dotted names); syslog, CEF and logfmt lines the map of their fields.
All parsing is regular expressions and map functions in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = r"[A-Za-z0-9_.\-\[\]@]+"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _map(pairs: Column) -> Column:
    """A map of (key, value) pairs; the last of equal keys counts."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p.key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p.key == k), -1).value))


def is_json(line: Column) -> Column:
    return F.coalesce(F.ltrim(line).rlike(r"^[\{\[]") & F.try_parse_json(line).isNotNull(), F.lit(False))


def json_map(line: Column) -> Column:
    """The top-level members of a JSON object as texts."""
    return F.from_json(line, "map<string,string>")


SYSLOG_5424 = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\]|\\.)*\])+) ?(.*)$"
SYSLOG_3164 = r"^<(\d{1,3})>(?:([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2})|(\d{4}-\d{2}-\d{2}T\S+)) (\S+) ([^:\[ ]+)(?:\[(\d+)\])?: ?(.*)$"


def syslog_map(line: Column) -> Column:
    """Fields of an RFC 5424 or 3164 line; null if it is neither. Structured data become ``id.name``; a JSON
    object as the message adds its members."""
    new = lambda i: F.regexp_extract(line, SYSLOG_5424, i)
    old = lambda i: F.regexp_extract(line, SYSLOG_3164, i)
    is_new, is_old = line.rlike(SYSLOG_5424), line.rlike(SYSLOG_3164)
    text = F.regexp_replace(F.when(is_new, new(8)).otherwise(old(7)), "^﻿", "")
    priority = F.when(is_new, new(1)).otherwise(old(1)).cast("int")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    gone = lambda c: F.nullif(F.nullif(c, F.lit("-")), F.lit(""))
    base = F.array(
        pair("facility", F.floor(priority / 8).cast("string")), pair("severity", (priority % 8).cast("string")),
        pair("timestamp", F.when(is_new, gone(new(2))).otherwise(F.coalesce(gone(old(2)), gone(old(3))))),
        pair("hostname", F.when(is_new, gone(new(3))).otherwise(old(4))), pair("appname", F.when(is_new, gone(new(4))).otherwise(old(5))),
        pair("procid", F.when(is_new, gone(new(5))).otherwise(gone(old(6)))), pair("msgid", F.when(is_new, gone(new(6)))), pair("message", text),
    )
    blocks = F.regexp_extract_all(F.when(is_new, new(7)).otherwise(""), F.lit(r"\[((?:[^\]\\]|\\.)*)\]"), 1)
    sd = F.flatten(F.transform(blocks, lambda b: F.transform(
        F.regexp_extract_all(b, F.lit(r'(\S+="(?:[^"\\]|\\.)*")'), 1),
        lambda p: F.struct(
            F.concat(F.substring_index(b, " ", 1), F.lit("."), F.substring_index(p, "=", 1)).alias("key"),
            F.regexp_replace(F.regexp_extract(p, r'^[^=]+="(.*)"$', 1), r'\\(["\\\]])', "$1").alias("value"),
        ),
    )))
    inner = F.when(is_json(text), F.map_entries(json_map(text)))
    all_pairs = F.concat(base, F.coalesce(sd, F.array().cast("array<struct<key:string,value:string>>")), F.coalesce(inner, F.array().cast("array<struct<key:string,value:string>>")))
    return F.when(is_new | is_old, _map(F.filter(all_pairs, lambda p: p.value.isNotNull())))


CEF = r"CEF:(\d+)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|((?:[^|\\]|\\.)*)\|(.*)$"


def cef_map(line: Column) -> Column:
    """The seven header fields and the extension of a CEF record anywhere in a line; null without one."""
    names = ["cefVersion", "deviceVendor", "deviceProduct", "deviceVersion", "deviceEventClassId", "name", "severity"]
    head = F.array(*[F.struct(F.lit(n).alias("key"), F.regexp_replace(F.regexp_extract(line, CEF, i + 1), r"\\([|\\])", "$1").alias("value")) for i, n in enumerate(names)])
    extension = F.regexp_extract(line, CEF, 8)
    # a value goes on until the next ` key=`
    marked = F.regexp_replace(extension, rf"(^|\s)({KEY})=", "\u0001$2\u0002")
    pairs = F.transform(
        F.filter(F.split(marked, "\u0001"), lambda x: F.instr(x, "\u0002") > 0),
        lambda x: F.struct(
            F.substring_index(x, "\u0002", 1).alias("key"),
            F.regexp_replace(F.regexp_replace(F.regexp_replace(F.rtrim(F.substring_index(x, "\u0002", -1)), r"\\n", "\n"), r"\\r", "\r"), r"\\([=\\|])", "$1").alias("value"),
        ),
    )
    return F.when(line.rlike(CEF), _map(F.concat(head, pairs)))


LOGFMT = r'([^\s="]+(?:=(?:"(?:[^"\\]|\\.)*"|[^\s"]*))?)'


def logfmt_map(line: Column) -> Column:
    """``key=value`` pairs; a bare key is ``true``, ``key=`` the empty text; quoted values may hold escapes."""
    parts = F.regexp_extract_all(line, F.lit(LOGFMT), 1)
    value = lambda p: F.when(F.instr(p, "=") == 0, F.lit("true")).otherwise(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^[^=]+=", ""), r'^"([\s\S]*)"$', "$1"), r'\\(["\\])', "$1")
    )
    return F.when(F.size(parts) > 0, _map(F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), value(p).alias("value")))))


def detect_format(line: Column) -> Column:
    """JSON if it starts like it and parses, syslog if it has fields, else plain; logfmt and CEF are never guessed."""
    return F.when(is_json(line), "json").when(F.ltrim(line).rlike("^<") & syslog_map(line).isNotNull(), "syslog").otherwise("plain")


def parse_lines(lines: DataFrame, kind: str = "auto", column: str = "value") -> DataFrame:
    """``format, body, raw`` for each line; blank lines have no row, nor have lines that are no JSON or CEF where
    that format was asked for."""
    raw = F.col(column)
    out = lines.where(raw.isNotNull() & (F.trim(raw) != ""))
    found = detect_format(raw) if kind == "auto" else F.lit(kind)
    out = out.withColumn("format", found)
    f = F.col("format")
    plain = F.create_map(F.lit("_raw"), raw)
    body = (
        F.when(f == "json", json_map(raw)).when(f == "syslog", F.coalesce(syslog_map(raw), plain))
        .when(f == "cef", cef_map(raw)).when(f == "logfmt", F.coalesce(logfmt_map(raw), plain)).otherwise(plain)
    )
    out = out.withColumn("body", body)
    if kind in ("json", "cef"):
        out = out.where(F.col("body").isNotNull())
    return out.select(*[c for c in lines.columns if c != column], "format", "body", raw.alias("raw"))


OTLP_SCHEMA = """resourceLogs array<struct<resource:struct<attributes:array<struct<key:string,value:map<string,string>>>>,
scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<struct<timeUnixNano:string,severityText:string,body:map<string,string>,
attributes:array<struct<key:string,value:map<string,string>>>>>>>>>"""


def otlp_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log records of OTLP/JSON requests: one row each, resource and record attributes as maps, time as a timestamp."""
    attributes = lambda c: F.map_from_entries(F.transform(F.coalesce(c, F.array().cast("array<struct<key:string,value:map<string,string>>>")), lambda a: F.struct(a.key.alias("key"), F.element_at(F.map_values(a.value), 1).alias("value"))))
    parsed = lines.select(F.from_json(F.col(column), OTLP_SCHEMA).alias("o"))
    records = parsed.select(F.explode("o.resourceLogs").alias("r")).select("r.resource", F.explode("r.scopeLogs").alias("s")).select("resource", "s.scope", F.explode("s.logRecords").alias("l"))
    return records.select(
        F.timestamp_micros(F.floor(F.col("l.timeUnixNano").try_cast("decimal(20,0)") / 1000).cast("bigint")).alias("time"),
        F.col("l.severityText").alias("severity"), F.element_at(F.map_values("l.body"), 1).alias("message"), F.col("scope.name").alias("scope"),
        attributes(F.col("resource.attributes")).alias("resource"), attributes(F.col("l.attributes")).alias("attributes"),
    )


def explode_path(rows: DataFrame, column: str, path: str) -> DataFrame:
    """An event filter: the members of a JSON array at ``path`` (``$.a.b``) as rows of their own; a value that is no
    array gives one row, an absent one none."""
    value = F.get_json_object(F.col(column), path)
    members = F.when(F.ltrim(value).startswith("["), F.transform(F.from_json(value, "array<variant>"), lambda v: F.to_json(v))).when(value.isNotNull(), F.array(value))
    return rows.withColumn(column, F.explode(members))
