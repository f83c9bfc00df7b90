"""Where results go: files, tables of failed rows, and the public finding format."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import socket
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

# fixed values: severity numbers of the finding class
SEVERITIES = {"informational": 1, "low": 2, "medium": 3, "high": 4, "critical": 5}


def write_ndjson(results: DataFrame, path: str, mode: str = "append") -> None:
    results.write.mode(mode).json(path)


def write_table(results: DataFrame, path: str, kind: str = "csv", mode: str = "append") -> None:
    """``csv`` or ``tsv`` with a header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in results.dtypes]
    results.select(*flat).write.mode(mode).option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)


def finding(results: DataFrame, time: str = "ts", product: str = "spanlight") -> Column:
    """Each detection as a Detection Finding (class 2004) in JSON."""
    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SEVERITIES.items() for x in p]), F.lower("level")), F.lit(0))
    techniques = F.filter("tags", lambda t: F.lower(t).rlike(r"^attack\.t\d{4}(\.\d{3})?$"))
    return F.to_json(F.struct(
        F.lit(2004).alias("class_uid"), F.lit(2).alias("category_uid"), F.lit(1).alias("activity_id"), F.lit(200401).alias("type_uid"),
        severity.alias("severity_id"), (F.col(time).cast("long") * 1000).alias("time"),
        F.struct(F.lit("1.3.0").alias("version"), F.struct(F.lit(product).alias("name")).alias("product")).alias("metadata"),
        F.struct(
            F.col("rule_title").alias("title"), F.coalesce("rule_id", "rule_title").alias("uid"),
            F.struct(F.lit(1).alias("type_id"), F.col("rule_title").alias("name"), F.col("rule_id").alias("uid")).alias("analytic"),
            F.transform(techniques, lambda t: F.struct(F.struct(F.upper(F.regexp_replace(t, "(?i)^attack\\.", "")).alias("uid")).alias("technique"))).alias("attacks"),
        ).alias("finding_info"),
    ))


def deliver(batch: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], dead_letters: str, retries: int = 3, backoff_s: float = 0.1, pause: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Hand one batch to each sink, again up to ``retries`` times, waiting twice as long each time; what a sink cannot take
    goes to ``dead_letters``."""
    said = {}
    for name, sink in sinks.items():
        problem = None
        for attempt in range(retries + 1):
            try:
                sink(batch)
                problem = None
                break
            except Exception as error:  # noqa: BLE001 - a sink's failure is handled here
                problem = error
                pause(min(backoff_s * 2**attempt, 30.0))
        if problem is None:
            said[name] = "delivered"
        else:
            batch.select(F.lit(name).alias("sink"), F.lit(str(problem)[:500]).alias("error"), F.to_json(F.struct("*")).alias("payload")).write.mode("append").json(dead_letters)
            said[name] = "dead letters"
    return said


def signature(secret: bytes, body: bytes) -> str:
    """The HMAC-SHA256 signature of a delivery."""
    return "sha256=" + hmac.new(secret, body, hashlib.sha256).hexdigest()


def otlp_record(results: DataFrame, time: str = "ts", scope: str = "spanlight") -> Column:
    """Each result as an OTLP/JSON request of one log record: level as severity, title as body, the rest as attributes."""
    number = {"informational": 9, "low": 10, "medium": 13, "high": 17, "critical": 21}  # fixed values: severity numbers
    severity = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in number.items() for x in p]), F.lower("level")), F.lit(9))
    text = lambda c: F.struct(c.cast("string").alias("stringValue"))
    others = [c for c, t in results.dtypes if c not in (time, "level", "rule_title") and not t.startswith(("array", "struct", "map"))]
    attributes = F.filter(F.array(*[F.struct(F.lit(c).alias("key"), text(F.col(c)).alias("value")) for c in others]), lambda a: a.value.stringValue.isNotNull())
    record = F.struct(
        F.concat(F.col(time).cast("long").cast("string"), F.lit("000000000")).alias("timeUnixNano"), severity.alias("severityNumber"),
        F.upper("level").alias("severityText"), text(F.col("rule_title")).alias("body"), attributes.alias("attributes"),
    )
    own = F.array(F.struct(F.lit("service.name").alias("key"), text(F.lit(scope)).alias("value")))
    return F.to_json(F.struct(F.array(F.struct(F.struct(own.alias("attributes")).alias("resource"), F.array(F.struct(F.struct(F.lit(scope).alias("name")).alias("scope"), F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))


def webhook(send: Callable[[bytes, dict[str, str]], None], body: str, secret: bytes | None = None, a_second: float = 0.0) -> Callable[[DataFrame], None]:
    """A sink that posts each row: ``body`` is a template of ``${column}``s, whose values are put in as JSON text; with a
    secret the delivery is signed. ``send`` (body, headers) makes the call, on the executors; ``a_second`` limits each task."""
    def post(rows: Iterator[Row]) -> None:
        for row in rows:
            own = row.asDict()
            text = re.sub(r"\$\{(\w+)\}", lambda m: json.dumps(own.get(m[1]), default=str)[1:-1] if isinstance(own.get(m[1]), str) else json.dumps(own.get(m[1]), default=str), body).encode()
            headers = {"Content-Type": "application/json"} | ({"X-Signature": signature(secret, text)} if secret else {})
            send(text, headers)
            if a_second:
                time.sleep(1 / a_second)

    return lambda batch: batch.foreachPartition(post)


def unix_socket(path: str) -> Callable[[DataFrame], None]:
    """A sink that writes each row as a JSON line to a Unix socket (of the executor's machine)."""
    def write(rows: Iterator[Row]) -> None:
        link = None
        for row in rows:
            if link is None:
                link = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
                link.connect(path)
            link.sendall(row[0].encode() + b"\n")
        if link is not None:
            link.close()

    return lambda batch: batch.select(F.to_json(F.struct("*"))).foreachPartition(write)


def topic(servers: str, name: str, key: str | None = None) -> Callable[[DataFrame], None]:
    """A sink that sends each row as JSON to a broker's topic. Needs Spark's connector on the class path."""
    def write(batch: DataFrame) -> None:
        columns = [F.to_json(F.struct("*")).alias("value")] + ([F.col(key).cast("string").alias("key")] if key else [])
        batch.select(*columns).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).save()

    return write


def console(lines: Callable[[str], None] = print, at_most: int = 1000) -> Callable[[DataFrame], None]:
    """A sink that prints rows as JSON lines, for looking at: up to ``at_most`` of a batch."""
    def write(batch: DataFrame) -> None:
        for row in batch.select(F.to_json(F.struct("*"))).limit(at_most).collect():
            lines(row[0])

    return write
