"""Contract queries of threat intelligence: patterns, graph, store, markings, checks; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.operators import orphans, stix
from spanlight.session import table

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


MAPPING = {"event:type": "event_type", "event:value": "value", "event:id": "event_id", "event:k": "props.k"}
SQL_EVENTS = "e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS t FROM events)"


def _pattern(name: str, pattern: str, sql: str) -> None:
    @_query(name, sql)
    def _(spark: SparkSession, sf: str) -> DataFrame:
        return stix.evaluate(table(spark, sf, "events"), pattern, ["user_id"], "ts", "event_id", MAPPING, {"props"})


def _one(where: str) -> str:
    return f"WITH {SQL_EVENTS} SELECT DISTINCT user_id, t AS start_us, t AS end_us FROM e WHERE {where}"


_pattern("stix_comparison", "[event:type = 'error' AND (event:value > 150 OR event:value <= 1)]", _one("event_type = 'error' AND (value > 150 OR value <= 1)"))
_pattern("stix_in", "[event:type IN ('error', 'view') AND event:value NOT IN (1, 2)]", _one("event_type IN ('error', 'view') AND value NOT IN (1, 2)"))
_pattern("stix_like", "[event:type LIKE '%ur_hase']", _one("event_type LIKE '%ur_hase'"))
_pattern("stix_matches", "[event:type MATCHES '^(cl|vi)']", _one("regexp_matches(event_type, '^(cl|vi)')"))
_pattern("stix_exists", "[EXISTS event:value AND NOT EXISTS event:nothing AND event:k >= 95]", _one("value IS NOT NULL AND (props->>'$.k')::DOUBLE >= 95"))
_pattern("stix_not", "[event:type NOT = 'error' AND event:value NOT < 120]", _one("NOT (event_type = 'error') AND NOT (value < 120)"))
_pattern("stix_startstop", "[event:type = 'error'] START t'2024-01-05T00:00:00Z' STOP t'2024-01-08T00:00:00Z'", _one("event_type = 'error' AND t >= 1704412800000000 AND t < 1704672000000000"))
_pattern("stix_observation_or", "[event:type = 'error'] OR [event:value > 150]", _one("event_type = 'error' OR value > 150"))
_pattern("stix_followedby", "[event:type = 'error'] FOLLOWEDBY [event:value > 100]", f"WITH {SQL_EVENTS} SELECT DISTINCT b.user_id, max(a.t) AS start_us, b.t AS end_us FROM e a JOIN e b ON a.user_id = b.user_id AND a.t <= b.t AND a.event_id <> b.event_id WHERE a.event_type = 'error' AND b.value > 100 GROUP BY b.user_id, b.event_id, b.t")
_pattern("stix_within", "([event:type = 'error'] FOLLOWEDBY [event:type = 'purchase']) WITHIN 5 HOURS", f"WITH {SQL_EVENTS}, m AS (SELECT b.user_id, max(a.t) AS s, b.t AS f FROM e a JOIN e b ON a.user_id = b.user_id AND a.t <= b.t AND a.event_id <> b.event_id WHERE a.event_type = 'error' AND b.event_type = 'purchase' GROUP BY b.user_id, b.event_id, b.t) SELECT DISTINCT user_id, s AS start_us, f AS end_us FROM m WHERE f - s <= 18000000000")
_pattern("stix_repeats", "[event:type = 'error'] REPEATS 3 TIMES WITHIN 2 DAYS", f"WITH {SQL_EVENTS}, m AS (SELECT user_id, t, lag(t, 2) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM e WHERE event_type = 'error') SELECT DISTINCT user_id, s AS start_us, t AS end_us FROM m WHERE t - s <= 172800000000")
_pattern("stix_observation_and", "([event:type = 'error'] AND [event:type = 'signup']) WITHIN 3 HOURS", f"""WITH {SQL_EVENTS}, x AS (SELECT * FROM e WHERE event_type IN ('error', 'signup')),
m AS (SELECT b.user_id, max(a.t) AS s, b.t AS f FROM x a JOIN x b ON a.user_id = b.user_id AND a.t <= b.t AND a.event_type <> b.event_type GROUP BY b.user_id, b.event_id, b.t, b.event_type) SELECT DISTINCT user_id, s AS start_us, f AS end_us FROM m WHERE f - s <= 10800000000""")


_pattern("stix_observation_and_three", "([event:type = 'error'] AND [event:type = 'signup'] AND [event:type = 'purchase']) WITHIN 12 HOURS", f"""WITH {SQL_EVENTS}, x AS (SELECT * FROM e WHERE event_type IN ('error', 'signup', 'purchase')),
m AS (SELECT b.user_id, b.t AS f, least(max(a.t) FILTER (a.event_type = 'error'), max(a.t) FILTER (a.event_type = 'signup'), max(a.t) FILTER (a.event_type = 'purchase')) AS s
  FROM x a JOIN x b ON a.user_id = b.user_id AND a.t <= b.t GROUP BY b.user_id, b.event_id, b.t HAVING count(DISTINCT a.event_type) = 3) SELECT DISTINCT user_id, s AS start_us, f AS end_us FROM m WHERE f - s <= 43200000000""")


REFERRING = {"stix_objects": ["created_by_ref"], "observed_data": ["created_by_ref", "object_refs"], "sightings": ["created_by_ref", "sighting_of_ref", "observed_data_refs"], "stix_reports": ["created_by_ref", "object_refs"]}


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference of the four tables: ``src, rel_type, dst``, ids trimmed and in lower case."""
    refs = orphans.references([orphans.Referring(n, table(spark, sf, n), f) for n, f in REFERRING.items()])
    return refs.select(orphans.clean_id(F.col("record_id")).alias("src"), F.col("ref_field").alias("rel_type"), F.col("target_id").alias("dst")).where("src is not null").distinct()


_ID = "nullif(lower(trim({0}, E' \\t\\n\\r')), '')"
SQL_EDGES = "g AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(
    f"SELECT {_ID.format('id')} AS src, '{f}' AS rel_type, {_ID.format('x')} AS dst FROM (SELECT id, {f'unnest({f})' if f.endswith('refs') else f} AS x FROM {n} WHERE added_at IS NOT NULL)" for n, fields in REFERRING.items() for f in fields
) + ") WHERE src IS NOT NULL AND dst IS NOT NULL)"
SQL_START = f"s AS (SELECT DISTINCT {_ID.format('id')} AS id FROM stix_objects WHERE rec_no % 100 = 0 AND trim(id) <> '')"


def _start(spark: SparkSession, sf: str) -> DataFrame:
    """The objects that are asked for: those of every hundredth stored version."""
    return table(spark, sf, "stix_objects").where("rec_no % 100 = 0").select(orphans.clean_id(F.col("id")).alias("id")).where("id is not null").distinct()


@_query("graph_neighbours", f"WITH {SQL_EDGES}, {SQL_START} SELECT src, rel_type, dst FROM g WHERE rel_type IN ('object_refs', 'sighting_of_ref') AND (dst IN (SELECT id FROM s) OR src IN (SELECT id FROM s))")
def _(spark, sf):
    return stix.neighbours(_edges(spark, sf), _start(spark, sf), "both", ["object_refs", "sighting_of_ref"])


@_query("graph_expand", f"""WITH RECURSIVE {SQL_EDGES}, {SQL_START}, b AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
r AS (SELECT id, 0 AS depth FROM s UNION SELECT b.dst, r.depth + 1 FROM r JOIN b ON b.src = r.id WHERE r.depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY 1""")
def _(spark, sf):
    return stix.expand(_edges(spark, sf), _start(spark, sf), 3)


@_query("graph_reference_edges", "SELECT src, path, count(*) AS n FROM (SELECT id AS src, 'created_by_ref' AS path, created_by_ref AS dst FROM sightings UNION ALL SELECT id, 'sighting_of_ref', sighting_of_ref FROM sightings UNION ALL SELECT id, 'observed_data_refs', unnest(observed_data_refs) FROM sightings) WHERE dst IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    objects = table(spark, sf, "sightings").select("id", F.to_json(F.struct("created_by_ref", "sighting_of_ref", "observed_data_refs")).alias("body"))
    return stix.reference_edges(objects).groupBy("src", "path").agg(F.count("*").alias("n"))


@_query("graph_unresolved", "WITH n AS (SELECT DISTINCT lower(trim(id)) AS id FROM stix_objects) SELECT lower(trim(sighting_of_ref)) AS dst, count(*) AS n FROM sightings WHERE trim(sighting_of_ref) <> '' AND lower(trim(sighting_of_ref)) NOT IN (SELECT id FROM n WHERE id IS NOT NULL) GROUP BY 1")
def _(spark, sf):
    nodes = table(spark, sf, "stix_objects").select(F.lower(F.trim("id")).alias("dst"))
    refs = table(spark, sf, "sightings").select(F.lower(F.trim("sighting_of_ref")).alias("dst")).where("dst <> ''")
    return refs.join(nodes, "dst", "left_anti").groupBy("dst").agg(F.count("*").alias("n"))


@_query("store_latest", "SELECT id, type, name, modified, rec_no FROM stix_objects QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified DESC NULLS LAST, rec_no DESC, name DESC NULLS LAST, added_at DESC) = 1")
def _(spark, sf):
    return stix.latest_versions(table(spark, sf, "stix_objects")).select("id", "type", "name", "modified", "rec_no")


@_query("store_query", "SELECT rec_no FROM (SELECT DISTINCT ON (id) id, rec_no FROM (SELECT id, rec_no, type, name, modified FROM stix_objects QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified DESC NULLS LAST, rec_no DESC, name DESC NULLS LAST, added_at DESC) = 1) WHERE type IN ('malware', 'indicator', 'tool') AND contains(lower(name), 'a') AND modified > TIMESTAMP '2023-07-01' ORDER BY id) ORDER BY id LIMIT 50 OFFSET 10")
def _(spark, sf):
    newest = stix.latest_versions(table(spark, sf, "stix_objects"))
    return stix.store_query(newest, types=["malware", "indicator", "tool"], text="A", modified_after="2023-07-01", offset=10, limit=50).select("rec_no")


@_query("marking_most_restrictive", "SELECT id, ['clear', 'white', 'green', 'amber', 'amber+strict', 'red'][max(r)] AS tlp FROM (SELECT id, CASE WHEN len(coalesce(report_types, [])) = 0 THEN 1 ELSE len(report_types) % 6 + 1 END AS r FROM stix_reports) GROUP BY 1")
def _(spark, sf):
    level = F.element_at(F.array(*[F.lit(t) for t in stix.TLP]), F.when(F.size("report_types") > 0, F.size("report_types") % 6 + 1).otherwise(1))
    return stix.most_restrictive(table(spark, sf, "stix_reports").select("id", F.concat(F.lit("TLP:"), F.upper(level)).alias("tlp")))


UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


@_query("stix_diagnostics", f"""SELECT rec_no, unnest(list_filter([
  CASE WHEN NOT coalesce(regexp_full_match(id, '[a-z0-9]+(-[a-z0-9]+)*--{UUID}'), false) THEN 'id_form' END, CASE WHEN string_split(id, '--')[1] <> type THEN 'id_type' END,
  CASE WHEN NOT coalesce(spec_version IN ('2.0', '2.1'), false) THEN 'spec_version' END, CASE WHEN modified < created THEN 'modified_before_created' END,
  CASE WHEN created_by_ref IS NOT NULL AND NOT regexp_full_match(created_by_ref, '[a-z0-9]+(-[a-z0-9]+)*--{UUID}') THEN 'created_by_form' END,
  CASE WHEN regexp_full_match(created_by_ref, '[a-z0-9]+(-[a-z0-9]+)*--{UUID}') AND NOT starts_with(created_by_ref, 'identity--') THEN 'created_by_type' END,
  CASE WHEN NOT coalesce(json_valid(body), false) THEN 'body_json' END], lambda x: x IS NOT NULL)) AS code FROM stix_objects""")
def _(spark, sf):
    return stix.diagnostics(table(spark, sf, "stix_objects"))


@_query("collection_page", "SELECT id, rec_no FROM (SELECT * FROM stix_objects WHERE type IN ('malware', 'indicator') AND spec_version = '2.1' AND added_at > TIMESTAMP '2023-08-01' QUALIFY row_number() OVER (PARTITION BY id ORDER BY modified DESC, rec_no DESC, name DESC NULLS LAST, added_at DESC) = 1) WHERE added_at > TIMESTAMP '2023-09-01' ORDER BY added_at, id, rec_no LIMIT 40")
def _(spark, sf):
    return stix.collection_page(table(spark, sf, "stix_objects"), types=["malware", "indicator"], spec_versions=["2.1"], added_after="2023-08-01", cursor=("2023-09-01", "zzz"), limit=40).select("id", "rec_no")


@_query("collection_manifest", "SELECT id, len(list_distinct(list(modified)))::BIGINT AS n_versions, min(added_at) AS date_added FROM stix_objects GROUP BY 1")
def _(spark, sf):
    return stix.manifest(table(spark, sf, "stix_objects")).select("id", F.size("versions").cast("long").alias("n_versions"), "date_added")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
