"""The pN_ queries of the general problems, each over its whole tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators import flatten, intervals, orphans, sessions, timestamps
from spanlight.session import table

SESSION_GAP_US = 1_800_000_000
REFERRING = {
    "stix_objects": ["created_by_ref"],
    "observed_data": ["created_by_ref", "object_refs"],
    "sightings": ["created_by_ref", "sighting_of_ref", "observed_data_refs"],
    "stix_reports": ["created_by_ref", "object_refs"],
}
PARENTS = [*REFERRING, "identities"]
CLOUD_PATHS = ["location.geolocation.lat", "properties.appDisplayName"]
STIX_PATHS = ["external_references.external_id"]


# -- 1: references to records that do not exist -----------------------------------------------------------
def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    refs = orphans.references([orphans.Referring(n, table(spark, sf, n), f) for n, f in REFERRING.items()])
    parents = orphans.lifetimes([table(spark, sf, n) for n in PARENTS])
    return orphans.find_orphans(refs, parents)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    period = F.date_format(F.timestamp_micros("at_us"), "yyyy-MM")
    return _orphans(spark, sf).select("src_table", "record_id", "ref_field", "target_id", "reason", period.alias("period")).distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, sf))


# -- 2: sessions ------------------------------------------------------------------------------------------
def timed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every event once: ``event_id, entity_kind, entity, us``.

    A copy delivered again counts with the earliest instant and, among equal ones, the least entity.
    """
    rows = table(spark, sf, "security_events").select("event_id", "time", "tz_name", "actor_user_name", "src_hostname")
    named = lambda c: F.lower(F.trim(c, F.lit(timestamps.BLANKS)))
    user, host = F.nullif(F.nullif(named(F.col("actor_user_name")), F.lit("")), F.lit("-")), F.nullif(named(F.col("src_hostname")), F.lit(""))
    rows = rows.withColumn("entity_kind", F.when(user.isNotNull(), "user").otherwise("device")).withColumn("entity", F.coalesce(user, host))
    timed = timestamps.normalise_times(rows.select("event_id", "time", "tz_name", "entity_kind", "entity"), "time", "tz_name", "outcome", "us")
    usable = timed.where((F.col("outcome") == "instant") & F.col("entity").isNotNull())
    once = usable.groupBy("event_id").agg(F.min(F.struct("us", "entity_kind", "entity")).alias("e"))
    return once.select("event_id", "e.entity_kind", "e.entity", "e.us")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sessionise(timed_events(spark, sf), ["entity_kind", "entity"], "us", SESSION_GAP_US)


def p2_durations(spark: SparkSession, sf: str) -> DataFrame:
    s = p2_found(spark, sf)
    length = (F.col("end_us") - F.col("start_us")) / 1e6
    return s.groupBy("entity_kind").agg(
        F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_events"), F.max("n_events").alias("most_events"),
        F.round(F.max(length), 3).alias("longest_s"), F.sum((F.col("n_events") == 1).cast("long")).alias("n_single"),
    )


# -- 3: nested records ------------------------------------------------------------------------------------
def _nested_values(triples: DataFrame, src_table: str, parent: str, paths: list[str]) -> DataFrame:
    """The values at ``paths``, taken from the flat tables of the groups that they fall into."""
    groups = flatten.pivot_groups(triples, paths)
    values = F.explode(F.array(*[F.struct(F.lit(p).alias("field_path"), F.col(f"leaf{i}").alias("text")) for i, p in enumerate(paths)]))
    return groups.select(F.lit(src_table).alias("src_table"), F.col(parent).alias("parent_key"), "ordinal", values.alias("v")).select("src_table", "parent_key", "v.field_path", "ordinal", "v.text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    cloud = flatten.parse_triples(table(spark, sf, "cloud_audit"), "line_no", "body", CLOUD_PATHS)
    stix = flatten.parse_triples(table(spark, sf, "stix_objects"), "rec_no", "body", STIX_PATHS, wrapper=None)
    rows = _nested_values(cloud, "cloud_audit", "record_id", CLOUD_PATHS).unionByName(_nested_values(stix, "stix_objects", "source_key", STIX_PATHS))
    text = F.trim("text", F.lit(timestamps.BLANKS))
    micro = F.round(text.try_cast("decimal(30,15)") * F.lit(1_000_000), 0).try_cast("bigint").cast("string")
    val = F.when(F.col("field_path") == CLOUD_PATHS[0], micro).otherwise(text)
    return rows.withColumn("val", val).where(F.col("val").isNotNull() & (F.col("val") != "")).select("src_table", "parent_key", "field_path", "ordinal", "val").distinct()


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The flat tables that the two JSON columns fall into, and how full their columns are."""
    cloud = flatten.group_sizes(flatten.parse_triples(table(spark, sf, "cloud_audit"), "line_no", "body"))
    stix = flatten.group_sizes(flatten.parse_triples(table(spark, sf, "stix_objects"), "rec_no", "body", wrapper=None))
    return cloud.withColumn("src_table", F.lit("cloud_audit")).unionByName(stix.withColumn("src_table", F.lit("stix_objects")))


def p3_external_references(spark: SparkSession, sf: str) -> DataFrame:
    """The table of external references, one row each, with parent record and position."""
    triples = flatten.parse_triples(table(spark, sf, "stix_objects"), "rec_no", "body", wrapper=None)
    return flatten.pivot_group(triples, "external_references[]", ["source_name", "url", "external_id", "hashes.SHA-256"])


def p3_signins(spark: SparkSession, sf: str) -> DataFrame:
    """The table of the cloud records themselves: one row each, with the leaves that lie in no array."""
    triples = flatten.parse_triples(table(spark, sf, "cloud_audit"), "line_no", "body")
    return flatten.pivot_group(triples, "", ["category", "eventName", "location.city", "location.country", "location.geolocation.lat", "properties.appDisplayName", "eventTime"])


def p3_policies(spark: SparkSession, sf: str) -> DataFrame:
    """The table of the policies applied to a sign-in; ``parent_position`` and ``record_no`` lead to its record."""
    triples = flatten.parse_triples(table(spark, sf, "cloud_audit"), "line_no", "body")
    return flatten.pivot_group(triples, "properties.appliedPolicies[]", ["id", "result", "target.appDisplayName"])


# -- 4: intervals -----------------------------------------------------------------------------------------
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "risk_incidents")
    seconds = lambda c: F.when(F.col(c) > 10**12, F.floor(F.col(c) / 1000)).otherwise(F.col(c)).cast("long")
    value = F.nullif(F.lower(F.trim("entity_value", F.lit(timestamps.BLANKS))), F.lit(""))
    windows = rows.select("entity_type", value.alias("entity_value"), seconds("window_start").alias("start_s"), seconds("window_end").alias("end_s")).where(F.col("entity_value").isNotNull())
    return intervals.covered_periods(windows, ["entity_type", "entity_value"], "start_s", "end_s")


def p4_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Covered and uncovered time per kind of entity."""
    return p4_found(spark, sf).groupBy("entity_type", "kind").agg(F.count("*").alias("n"), F.sum(F.col("end_s") - F.col("start_s")).alias("total_s"), F.max(F.col("end_s") - F.col("start_s")).alias("longest_s"))


# -- 5: timestamps ----------------------------------------------------------------------------------------
def stored_times(spark: SparkSession, sf: str, zone_missing: bool | None = None) -> DataFrame:
    """``src_table, record_key, text, tz_name, received, sensor`` of the three tables' time texts; of all rows, or only those
    that lack a zone (or do not), which the scans see."""
    def rows(name: str) -> DataFrame:
        t = table(spark, sf, name)
        lacks = timestamps.lacks_zone(F.col("tz_name"))
        return t if zone_missing is None else t.where(lacks if zone_missing else ~lacks)

    clean = lambda c: F.lower(F.trim(c, F.lit(timestamps.BLANKS)))
    events = rows("security_events").select(F.lit("security_events").alias("src_table"), F.col("event_id").cast("string").alias("record_key"), F.col("time").alias("text"), "tz_name", F.col("received_at").alias("received"), clean(F.col("src_hostname")).alias("sensor"))
    seen = rows("sightings").select(F.lit("sightings").alias("src_table"), F.col("id").alias("record_key"), F.col("first_seen").alias("text"), "tz_name", F.col("added_at").alias("received"), clean(F.col("created_by_ref")).alias("sensor"))
    of_line = "line_no long, tz_name string, received_at timestamp_ntz, shape string"
    lines = rows("cloud_audit").select(F.to_json(F.struct("line_no", "tz_name", F.col("received_at").cast("timestamp_ntz").alias("received_at"), "shape")).alias("line"), "body")
    cloud = flatten.parse_triples(lines, "line", "body", ["eventTime"]).select("record_id", "val", F.from_json("source_key", of_line).alias("l")).select(
        F.lit("cloud_audit").alias("src_table"), F.col("record_id").alias("record_key"), F.col("val").alias("text"), F.col("l.tz_name").alias("tz_name"), F.col("l.received_at").alias("received"), F.col("l.shape").alias("sensor")
    )
    parts = [events, seen, cloud]
    return functools.reduce(DataFrame.unionByName, [p.withColumn("received", F.unix_micros(F.col("received").cast("timestamp"))) for p in parts])


def _unusual(times: DataFrame) -> DataFrame:
    # a canonical text of a valid date needs no work; the cheap test keeps most rows out of the rest of the plan
    valid = times["text"].rlike(timestamps.CANONICAL) & times["text"].try_cast("timestamp").isNotNull()
    return times.where(times["text"].isNotNull() & ~valid)


def zone_candidates(spark: SparkSession, sf: str) -> list[str]:
    """The zones that the three tables name."""
    names = [table(spark, sf, n).select("tz_name") for n in ("security_events", "sightings", "cloud_audit")]
    return timestamps.stated_zones(functools.reduce(DataFrame.unionByName, names), "tz_name")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Zone-less rows get the zone that their sensor's ingestion times speak for, with UTC, which the data define, as the prior.

    Of a record that is stored several times the copy that arrived first counts (then the least instant)."""
    lacking = timestamps.fill_zones(
        _unusual(stored_times(spark, sf, True)).withColumn("got", F.timestamp_micros("received")), ["src_table", "sensor"], "text", "tz_name", "got", zone_candidates(spark, sf)
    ).drop("got")
    times = _unusual(stored_times(spark, sf, False)).unionByName(lacking)
    timed = timestamps.normalise_times(times, "text", "tz_name").where(F.col("outcome").isNotNull())
    first = F.min(F.struct(F.coalesce("received", F.lit((1 << 63) - 1)).alias("received"), "instant_us", "outcome")).alias("f")
    return timed.groupBy("src_table", "record_key").agg(first).select("src_table", "record_key", "f.outcome", "f.instant_us")


def p5_zones(spark: SparkSession, sf: str) -> DataFrame:
    """The zone of each host whose events lack one, estimated from the ingestion times."""
    rows = stored_times(spark, sf, True).where(F.col("src_table") == "security_events").withColumn("got", F.timestamp_micros("received")).withColumnRenamed("sensor", "host")
    return timestamps.estimate_zones(rows, ["host"], "text", "got", zone_candidates(spark, sf), prior="UTC")


def queries() -> dict:
    return {f.__name__: f for f in (
        p1_found, p1_report, p2_found, p2_durations, p3_found, p3_groups, p3_external_references, p3_signins, p3_policies, p4_found, p4_coverage, p5_found, p5_zones,
    )}


_CLEAN = "nullif(lower(trim({0}, E' \\t\\n\\r')), '')"


def _sql_references() -> str:
    parts = []
    for name, fields in REFERRING.items():
        for f in fields:
            value = f"unnest({f})" if f.endswith("_refs") else f
            parts.append(f"SELECT '{name}' AS src_table, id AS record_id, '{f}' AS ref_field, {value} AS target, added_at AS seen_at FROM {name}")
    refs = " UNION ALL ".join(parts)
    parents = " UNION ALL ".join(f"SELECT id, added_at, deleted_at FROM {n}" for n in PARENTS)
    return f"""
r AS (SELECT src_table, record_id, ref_field, {_CLEAN.format('target')} AS target_id, seen_at FROM ({refs}) WHERE seen_at IS NOT NULL),
p AS (SELECT {_CLEAN.format('id')} AS id, added_at, deleted_at FROM ({parents})),
d AS (SELECT DISTINCT target_id, seen_at FROM r WHERE target_id IS NOT NULL),
j AS (SELECT d.target_id, d.seen_at, count(p.id) AS n, count(*) FILTER (p.added_at <= d.seen_at) AS so_far,
  count(*) FILTER (p.added_at <= d.seen_at AND (p.deleted_at IS NULL OR d.seen_at < p.deleted_at)) AS alive FROM d LEFT JOIN p ON p.id = d.target_id GROUP BY 1, 2),
o AS (SELECT r.*, CASE WHEN n = 0 THEN 'missing' WHEN so_far = 0 THEN 'late' ELSE 'deleted' END AS reason, strftime(r.seen_at, '%Y-%m') AS period
  FROM r JOIN j ON r.target_id = j.target_id AND r.seen_at = j.seen_at WHERE alive = 0)"""


_SQL_PERIODS = f"""
w AS (SELECT entity_type, {_CLEAN.format('entity_value')} AS entity_value,
  CASE WHEN window_start > 1000000000000 THEN window_start // 1000 ELSE window_start END AS s,
  CASE WHEN window_end > 1000000000000 THEN window_end // 1000 ELSE window_end END AS e FROM risk_incidents),
v AS (SELECT * FROM w WHERE entity_value IS NOT NULL AND s <= e),
m AS (SELECT *, max(e) OVER (PARTITION BY entity_type, entity_value ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
i AS (SELECT *, sum(CASE WHEN s > before THEN 1 ELSE 0 END) OVER (PARTITION BY entity_type, entity_value ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
q AS (SELECT entity_type, entity_value, island, min(s) AS s, max(e) AS e FROM i GROUP BY ALL),
f AS (SELECT entity_type, entity_value, 'period' AS kind, s AS start_s, e AS end_s FROM q UNION ALL
  SELECT entity_type, entity_value, 'gap', e, lead(s) OVER (PARTITION BY entity_type, entity_value ORDER BY island) FROM q QUALIFY lead(s) OVER (PARTITION BY entity_type, entity_value ORDER BY island) IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; the others are tested against plain versions."""
    return {
        "p1_found": f"WITH {_sql_references()} SELECT DISTINCT src_table, record_id, ref_field, target_id, reason, period FROM o",
        "p1_report": f"WITH {_sql_references()}, u AS (SELECT DISTINCT * FROM o) SELECT src_table, ref_field, reason, period, count(*) AS n_references, count(DISTINCT target_id) AS n_targets FROM o GROUP BY ALL",
        "p4_found": f"WITH {_SQL_PERIODS} SELECT * FROM f",
        "p4_coverage": f"WITH {_SQL_PERIODS} SELECT entity_type, kind, count(*) AS n, sum(end_s - start_s)::BIGINT AS total_s, max(end_s - start_s)::BIGINT AS longest_s FROM f GROUP BY ALL",
    }
