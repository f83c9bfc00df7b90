"""Nulls, blanks, ties, repeats, empty tables and clashing column names for the general operators."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from spanlight.operators import bloom, flatten, intervals, orphans, sessions, timestamps
from spanlight.plans import core_queries
from tests import brute

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


# -- sessions ---------------------------------------------------------------------------------------------
def run_sessions(spark, rows, gap=10):
    df = spark.createDataFrame(rows, "who string, t long, start_us string, __k0 int")
    return sorted(map(tuple, sessions.sessionise(df, ["who"], "t", gap).collect()), key=str)


def test_sessions_nulls_ties_repeats_and_clashing_names(spark):
    rows = [("a", 5, "x", 1), ("a", 5, "x", 1), ("a", 15, None, 2), ("a", 26, None, 2), (None, 1, "y", 3), (None, None, "y", 3), ("b", None, "z", 4), ("a", -8, "n", 5)]
    assert run_sessions(spark, rows) == sorted([("a", -8, -8, 1), ("a", 5, 15, 3), ("a", 26, 26, 1), (None, 1, 1, 1)], key=str)


def test_sessions_empty(spark):
    assert run_sessions(spark, []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_against_plain_loop(spark, seed):
    """Long chains over many blocks, a hot entity, and gaps exactly at the limit."""
    rng = random.Random(seed)
    rows, want = [], []
    for who, n in (("hot", 900), ("b", 60), ("c", 1)):
        t, start, count = rng.randrange(-50, 50), None, 0
        times = []
        for _ in range(n):
            t += rng.choice([0, 1, 3, 9, 10, 10, 11] if rng.random() < 0.1 else [0, 1, 5, 10])
            times.append(t)
        rows += [(who, x, None, 0) for x in times]
        start, prev, count = times[0], times[0], 0
        for x in times:
            if x - prev > 10:
                want.append((who, start, prev, count))
                start, count = x, 0
            prev, count = x, count + 1
        want.append((who, start, prev, count))
    rng.shuffle(rows)
    assert run_sessions(spark, rows) == sorted(want, key=str)


# -- intervals --------------------------------------------------------------------------------------------
def run_periods(spark, rows, width=8):
    df = spark.createDataFrame(rows, "k string, s long, e long, t int, block int, number int")
    return sorted(map(tuple, intervals.covered_periods(df, ["k"], "s", "e", width).collect()), key=str)


def test_periods_nulls_touching_zero_length_and_clashing_names(spark):
    rows = [("a", 1, 5, 0, 0, 0), ("a", 5, 7, 0, 0, 0), ("a", 9, 9, 0, 0, 0), ("a", 9, 9, 0, 0, 0), ("a", 20, 10, 0, 0, 0), ("a", None, 3, 0, 0, 0), ("a", 3, None, 0, 0, 0), (None, 2, 3, 0, 0, 0)]
    assert run_periods(spark, rows) == sorted([("a", "period", 1, 7), ("a", "gap", 7, 9), ("a", "period", 9, 9), (None, "period", 2, 3)], key=str)


def test_periods_empty(spark):
    assert run_periods(spark, []) == []


def test_periods_against_plain_loop(spark):
    rng = random.Random(3)
    rows, want = [], []
    for k, n in (("hot", 400), ("b", 20)):
        xs = []
        for _ in range(n):
            s = rng.randrange(-500, 3000)
            xs.append((s, s + rng.choice([0, 1, 2, 5, 300] if rng.random() < 0.05 else [0, 1, 2, 5])))
        rows += [(k, s, e, 0, 0, 0) for s, e in xs]
        xs.sort()
        lo, hi = xs[0]
        for s, e in xs[1:]:
            if s <= hi:
                hi = max(hi, e)
            else:
                want += [(k, "period", lo, hi), (k, "gap", hi, s)]
                lo, hi = s, e
        want.append((k, "period", lo, hi))
    assert run_periods(spark, rows) == sorted(want, key=str)


# -- orphans ----------------------------------------------------------------------------------------------
def test_orphans_reasons_boundaries_and_dirty_ids(spark):
    parents = spark.createDataFrame(
        [(" A--1 ", day(1), day(3), 1), ("a--1", day(5), None, 1), ("a--2", day(4), None, 1), ("a--3", None, None, 1), ("a--4", day(3), day(3), 1), (None, day(1), None, 1), ("", day(1), None, 1)],
        "id string, added_at timestamp, deleted_at timestamp, reason int",
    )
    refs = spark.createDataFrame(
        [("r1", day(1), ["A--1", None, "", "a--1 "]), ("r2", day(3), ["a--1"]), ("r3", day(0), ["a--1"]), ("r4", day(5), ["a--1", "a--9"]), ("r5", day(2), ["a--2"]), ("r6", day(9), ["a--3"]), ("r7", day(9), ["a--4"]), ("r8", None, ["a--9"]), ("r9", day(1), None)],
        "id string, added_at timestamp, refs array<string>",
    )
    for blocks in (1, 64):  # with one block the filter says "maybe" to much; the result is the same
        found = orphans.find_orphans(orphans.references([orphans.Referring("t", refs, ["refs"])]), orphans.lifetimes([parents]), blocks)
        got = sorted((r.record_id, r.target_id, r.reason) for r in found.collect())
        assert got == [("r2", "a--1", "deleted"), ("r3", "a--1", "late"), ("r4", "a--9", "missing"), ("r5", "a--2", "late"), ("r6", "a--3", "late"), ("r7", "a--4", "deleted")]


def test_orphans_empty_tables(spark):
    parents = spark.createDataFrame([], "id string, added_at timestamp, deleted_at timestamp")
    refs = spark.createDataFrame([("r1", day(1), "x")], "id string, added_at timestamp, ref string")
    found = orphans.find_orphans(orphans.references([orphans.Referring("t", refs, ["ref"])]), orphans.lifetimes([parents]))
    assert [(r.target_id, r.reason) for r in found.collect()] == [("x", "missing")]
    none = orphans.find_orphans(orphans.references([orphans.Referring("t", refs.where("false"), ["ref"])]), orphans.lifetimes([parents]))
    assert none.count() == 0


@pytest.mark.parametrize("broadcast", [1 << 18, 8])
def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark, monkeypatch, broadcast):
    """Broadcast, and partitioned with the probing rows shuffled to it."""
    monkeypatch.setattr(bloom, "BROADCAST_BLOCKS", broadcast)
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    other = spark.range(20_000).select(F.concat(F.lit("o"), F.col("id")).alias("key"), F.lit(1).alias("bf_block"))
    made = bloom.build(keys, "key", 1024)
    assert bloom.probe(keys, "key", made, 1024).where("not maybe").count() == 0
    assert bloom.probe(other, "key", made, 1024).where("maybe").count() < 400
    assert bloom.blocks_for(20_000) == 512 and bloom.blocks_for(0) == 64
    with pytest.raises(ValueError):
        bloom.build(keys, "key", 0)


# -- nested records ---------------------------------------------------------------------------------------
def triples(spark, bodies, **options):
    df = spark.createDataFrame([(i, b, "x") for i, b in enumerate(bodies)], "key long, body string, path string")
    return flatten.parse_triples(df, "key", "body", **options)


def test_flatten_shapes_and_positions(spark):
    got = {(r.source_key, r.record_no, r.path, r.position, r.val, r.kind) for r in triples(spark, [
        '{"id":"a","x":[{"y":1},{"y":[2.50,null]}],"t":"{\\"z\\": true}"}', '[{"id":"b"},{"id":"c","e":{}}]', '{"records":[{"id":"d","n":[]}]}', None, "", '{"id":"e"', '[{"id":"f"},{"id":"g"', "7",
    ]).collect()}
    assert got == {
        ("0", 0, "id", "", "a", "string"), ("0", 0, "x[].y", "0", "1", "number"), ("0", 0, "x[].y[]", "1.0", "2.50", "number"), ("0", 0, "x[].y[]", "1.1", None, "null"), ("0", 0, "t.z", "", "true", "boolean"),
        ("1", 0, "id", "", "b", "string"), ("1", 1, "id", "", "c", "string"), ("1", 1, "e", "", None, "empty object"), ("2", 0, "id", "", "d", "string"), ("2", 0, "n[]", "", None, "empty array"),
        ("5", 0, "", "", None, "broken"), ("6", 0, "id", "", "f", "string"), ("6", 1, "", "", None, "broken"), ("7", 0, "", "", "7", "number"),
    }


def test_flatten_pivot_keeps_parents(spark):
    df = triples(spark, ['{"id":"a","x":[{"n":"p","y":[{"k":1},{"k":2}]},{"n":"q"}]}'])
    outer = {(r.position, r.ordinal, r.n, r.record_id) for r in flatten.pivot_group(df, "x[]", ["n"]).collect()}
    inner = {(r.parent_position, r.ordinal, r.k) for r in flatten.pivot_group(df, "x[].y[]", ["k"]).collect()}
    assert outer == {("0", 0, "p", "a"), ("1", 1, "q", "a")}
    assert inner == {("0", 0, "1"), ("0", 1, "2")}


def test_flatten_pivot_takes_one_object_for_an_array(spark):
    """Objects where an array is usual, also as text, in inner arrays and beside the array, against plain reading."""
    rng = random.Random(4)
    bodies, want, inner = [], set(), set()
    for i in range(60):
        members = [{"n": f"{i}-{k}", "h": {"s": k}} for k in range(rng.choice([1, 1, 2, 3]))]
        for k, m in enumerate(members):
            refs = [{"k": f"{i}/{k}/{j}"} for j in range(rng.choice([1, 2]))]
            m["y"] = refs[0] if len(refs) == 1 and rng.random() < 0.7 else refs
            want.add((str(i), str(k), "", k, m["n"], str(k)))
            inner |= {(str(i), f"{k}.{j}", str(k), j, x["k"]) for j, x in enumerate(refs)}
        x = members[0] if len(members) == 1 and rng.random() < 0.7 else members
        bodies.append(json.dumps({"id": f"r{i}", "x": json.dumps(x) if rng.random() < 0.2 else x}))
    bodies.append('{"id":"both","x":[{"n":"in"}],"x.n":"beside"}')
    want |= {("60", "0", "", 0, "in", None), ("60", "0", "", 0, "beside", None)}
    df = triples(spark, bodies)
    outer = flatten.pivot_group(df, "x[]", ["n", "h.s"]).select("source_key", "position", "parent_position", "ordinal", "n", "h_s").collect()
    assert len(outer) == len(want) and {tuple(r) for r in outer} == want
    got = flatten.pivot_group(df, "x[].y[]", ["k"]).select("source_key", "position", "parent_position", "ordinal", "k").collect()
    assert len(got) == len(inner) and {tuple(r) for r in got} == inner


def test_external_references_against_plain_reading(spark, sf):
    got = core_queries.p3_external_references(spark, sf).select("source_key", "ordinal", "source_name", "url", "external_id", "hashes_SHA-256").collect()
    want = set()
    for number, body in spark.read.parquet(f"{sf}/stix_objects.parquet").select("rec_no", "body").collect():
        try:
            record = json.loads(body or "null", parse_int=str, parse_float=str)
        except ValueError:
            continue
        for record in record if isinstance(record, list) else [record]:
            refs = record.get("external_references") if isinstance(record, dict) else None
            refs = json.loads(refs, parse_int=str, parse_float=str) if isinstance(refs, str) and refs.strip()[:1] in ("[", "{") else refs
            for k, ref in enumerate(refs if isinstance(refs, list) else [refs]):
                if isinstance(ref, dict) and ref:
                    want.add((str(number), k, *(ref.get(x) for x in ("source_name", "url", "external_id")), (ref.get("hashes") or {}).get("SHA-256")))
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_flatten_very_deep_and_very_long(spark):
    deep, long = "[" * 5000 + "]" * 5000, '{"id":"l","v":"' + "x" * 2_000_000 + '"}'
    got = triples(spark, ['{"id":"d","v":' + deep + "}", long], paths=["v"]).collect()
    assert [len(r.val) for r in got if r.source_key == "1"] == [2_000_000]


# -- timestamps -------------------------------------------------------------------------------------------
CASES = [
    ("2024-10-27 02:30:00", "Europe/Berlin"), ("2024-03-31 02:30:00", "Europe/Berlin"), ("2024-10-27 02:30:00 CET", "Europe/Berlin"), ("2024-10-27 02:30:00 CEST", "Europe/Berlin"),
    ("2024-04-07 01:45:00", "Australia/Lord_Howe"), ("2024-10-06 02:15:00", "Australia/Lord_Howe"), ("2024-02-30 00:00:00", "UTC"), ("2024-01-01T00:00:00.123456789Z", None), ("2024-01-01t00:00:00z", " "),
    ("1727762478", "x/y"), ("1727762458000", None), ("1727762629809876", None), ("1727762461.5", None), ("12/31/2024 12:00:00 AM", "America/New_York"), ("31/12/2024 23:59:59", "Asia/Kolkata"), ("T12:40:00Z", None), ("never", None),
    (None, "UTC"), ("", "UTC"), ("  ", None), ("Tue Oct  1 11:54:49 2024", "Asia/Kathmandu"), ("01/Oct/2024:08:13:07 +0200", None), ("Tue, 01 Oct 2024 06:03:56 GMT", "America/New_York"), ("20241001T060125Z", "Asia/Tokyo"), ("2024-10-01 06:10:01,5", "UTC"),
]


def test_timestamps_against_plain_version(spark):
    df = spark.createDataFrame([(i, t, z, 1) for i, (t, z) in enumerate(CASES)], "i long, text string, zone string, instant_us int")
    got = {r.i: (r.outcome, r.instant_us) for r in timestamps.normalise_times(df, "text", "zone").collect()}
    for i, (text, zone) in enumerate(CASES):
        assert got[i] == (brute.instant(text, zone) or (None, None)), (text, zone)


def test_timestamps_stated_failures(spark):
    rows = [("2024-01-01 00:00:00", "No/Zone"), ("05/06/2024 10:00:00", "UTC"), ("2024-01-01 00:00:00 XYZQ", "UTC"), ("99999999999999999999", "UTC")]
    df = spark.createDataFrame(rows, "text string, zone string")
    assert {r.outcome for r in timestamps.normalise_times(df, "text", "zone").collect()} == {"unreadable"}
    assert timestamps.normalise_times(df.where("false"), "text", "zone").count() == 0


def test_zone_estimates_find_the_zone_that_was_hidden(spark):
    rows = []
    for host, zone in (("a", "Europe/Berlin"), ("b", "America/New_York"), ("c", "Asia/Tokyo"), (None, "UTC")):
        for i in range(120):
            at = dt.datetime(2024, 10, 1, tzinfo=dt.UTC) + dt.timedelta(hours=11 * i)
            local = at.astimezone(brute.zoneinfo.ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S")
            rows.append((host, local, (at + dt.timedelta(seconds=30 + i)).replace(tzinfo=None)))
    df = spark.createDataFrame(rows, "host string, time string, received_at timestamp")
    found = {r.host: r.zone for r in timestamps.estimate_zones(df, ["host"], "time", "received_at", ["UTC", "Europe/Berlin", "America/New_York", "Asia/Tokyo", "Europe/London"]).collect()}
    assert found == {"a": "Europe/Berlin", "b": "America/New_York", "c": "Asia/Tokyo", None: "UTC"}
