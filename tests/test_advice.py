"""Overlapping roles, hot values, spans and order in alerts, patterns and streams, against plain versions."""

import datetime as dt
import itertools
import random

import pytest

from spanlight.operators import alerts as A
from spanlight.operators import stix
from spanlight.operators.detect import matching
from spanlight.rules.model import load_rules
from spanlight.streaming import detect as streams


# -- inhibition -------------------------------------------------------------------------------------------
def plain_inhibit(rows, source, target, duration):
    last, kept = {}, set()
    for seq, ts, user, title in sorted(rows, key=lambda r: (r[1], r[0])):
        if title in target and title not in source and user in last and ts - last[user] < duration:
            continue
        if title in source:
            last[user] = ts
        kept.add(seq)
    return kept


def test_inhibit_with_overlapping_matchers(spark):
    """An alert that is source and target is a source and is never muted."""
    rng = random.Random(5)
    rows = [(i, rng.randrange(0, 400_000), rng.choice("ab"), rng.choice("xyz")) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, ts long, user string, title string")
    for source, target in (("xy", "yz"), ("xy", "y"), ("x", "xyz"), ("xyz", "xyz"), ("x", "z")):
        m = A.Matcher.parse
        found = A.inhibit(df, [m(f"title=~[{source}]")], [m(f"title=~[{target}]")], ["user"], 5_000)
        got = [r.seq for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == plain_inhibit(rows, source, target, 5_000)


# -- entity incidents -------------------------------------------------------------------------------------
def test_a_value_of_many_alerts_joins_them_all(spark):
    df = spark.range(100_002).selectExpr("id AS seq", "id AS ts", "'hot' AS h")
    assert {r.incident for r in A.entity_incidents(df, A.EntityGraph(["h"])).select("incident").distinct().collect()} == {0}


def test_guard_lets_the_first_alerts_of_a_value_join(spark):
    rows = [(5, 1, "v", "p"), (1, 2, "v", "q"), (2, 3, "v", "r"), (3, 4, "w", "r"), (4, 5, "v", None)]
    df = spark.createDataFrame(rows, "seq long, ts long, h string, u string")
    got = {r.seq: r.incident for r in A.entity_incidents(df, A.EntityGraph(["h", "u"], max_alerts=2)).collect()}
    assert got == {5: 1, 1: 1, 2: 2, 3: 2, 4: 4}


# -- streams ----------------------------------------------------------------------------------------------
RULES = """
title: errors
name: errors
detection: {s: {kind: error}, condition: s}
---
title: many
correlation: {type: KIND, rules: [errors], group-by: [user], timespan: 50s, condition: {FIELDgte: 3}}
"""


def run_stream(spark, folder, files, rules):
    """The firings of files that arrive one after another."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, "id long, ts long, user string, kind string, item string").coalesce(1).write.parquet(f"{folder}/in/{i}")
    schema = spark.read.parquet(f"{folder}/in/0").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    out = streams.sliding_correlation(source, rules, rules.correlations[0], "ts", "id")
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.seq, r.value) for r in spark.read.parquet(f"{folder}/out").collect())


def plain_stream(files, distinct):
    seen, out = [], []
    for rows in files:
        for i, ts, user, _, item in sorted(rows, key=lambda r: (r[1], r[0])):
            seen.append((ts, user, item))
            inside = [x for t, u, x in seen if u == user and ts - 50 <= t <= ts]
            n = len(set(inside)) if distinct else len(inside)
            if n >= 3:
                out.append((i, float(n)))
    return sorted(out)


@pytest.mark.parametrize("kind", ["event_count", "value_count"])
def test_stream_correlation_orders_a_group_over_chunks_and_late_files(spark, tmp_path, kind):
    rng = random.Random(6)
    files = [[(k * 100 + i, 1_000 * k + rng.randrange(2_000), rng.choice("ab"), "error", rng.choice("pqrs")) for i in range(80)] for k in range(2)]
    for rows in files:
        rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rules = load_rules(RULES.replace("KIND", kind).replace("FIELD", "field: item, " if kind == "value_count" else ""))
        got = run_stream(spark, tmp_path, files, rules)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_stream(files, kind == "value_count")


# -- patterns ---------------------------------------------------------------------------------------------
def run_pattern(spark, rows, pattern):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    df = spark.createDataFrame([(i, "h", at + dt.timedelta(seconds=t), k, v) for i, t, k, v in rows], "id long, host string, ts timestamp, kind string, v long")
    zero = int(at.timestamp() * 1e6)
    return {((r.start_us - zero) // 1_000_000, (r.end_us - zero) // 1_000_000) for r in stix.evaluate(df, pattern, ["host"], "ts", "id", {"event:kind": "kind", "event:v": "v"}).collect()}


def plain_and(parts):
    """Parts are lists of (start, end, ids); for each match that ends last, the best of the others."""
    best = {}
    for choice in itertools.product(*parts):
        if len(set().union(*[c[2] for c in choice])) == sum(len(c[2]) for c in choice):
            end = max(c[1] for c in choice)
            for i, c in enumerate(choice):
                if c[1] == end:
                    best[i, c] = max(best.get((i, c), -1), min(c[0] for c in choice))
    return {(start, c[1]) for (_, c), start in best.items()}


def test_and_of_three_and_of_spans(spark):
    one = lambda k: f"[event:kind = '{k}']"
    rows = [(1, 1, "a", 0), (2, 3, "c", 0), (3, 5, "b", 0)]
    assert run_pattern(spark, rows, f"{one('a')} AND {one('b')} AND {one('c')}") == {(1, 5)}
    assert run_pattern(spark, rows, f"({one('a')} FOLLOWEDBY {one('b')}) AND {one('c')}") == {(1, 5)}
    # the span's own observation is not used again
    assert run_pattern(spark, rows, f"({one('a')} FOLLOWEDBY {one('b')}) AND {one('b')}") == set()


def test_and_against_plain_version(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(0, 40), rng.choice("abcd"), rng.randrange(4)) for i in range(26)]
    pick = lambda test: [(t, t, frozenset([i])) for i, t, k, v in rows if test(k, v)]
    a, b, c, low, mid = pick(lambda k, v: k == "a"), pick(lambda k, v: k == "b"), pick(lambda k, v: k == "c"), pick(lambda k, v: v < 2), pick(lambda k, v: v < 3)
    assert run_pattern(spark, rows, "[event:kind = 'a'] AND [event:kind = 'b'] AND [event:kind = 'c']") == plain_and([a, b, c])
    assert run_pattern(spark, rows, "[event:v < 2] AND ([event:v < 3] AND [event:v < 2])") == plain_and([low, mid, low])
    spans = [(max(x[0] for x in a if x[0] <= y[0]), y[1], y[2]) for y in b if any(x[0] <= y[0] for x in a)]
    assert run_pattern(spark, rows, "([event:kind = 'a'] FOLLOWEDBY [event:kind = 'b']) AND [event:kind = 'c']") == plain_and([spans, c])


# -- windash ----------------------------------------------------------------------------------------------
def test_windash_varies_every_dash(spark):
    value = " ".join(f"-{c}" for c in "abcdefghij")
    rows = [(0, f"X {value} y"), (1, f"x {value.replace('-j', '/J')}"), (2, value.replace("-", "–")), (3, value.replace("-i", "+i")), (4, "x"), (5, None)]
    df = spark.createDataFrame(rows, "i long, t string")
    for op, want in (("contains", [0, 1, 2]), ("endswith", [1, 2]), ("startswith", [2])):
        rules = load_rules(f"title: t\ndetection: {{s: {{'t|windash|{op}': '{value}'}}, condition: s}}")
        assert sorted(r.i for r in matching(df, rules, rules.rules[0]).collect()) == want
