"""Many rules, texts in JSON, addresses, expressions, patterns with repeats, sinks and live sources."""

import datetime as dt
import ipaddress
import json
import os
import random
import re
import socket
import threading

import pytest
from pyspark.sql import functions as F

from spanlight.operators import detect as D
from spanlight.operators import scan, stix
from spanlight.rules import match, plain, prefilter
from spanlight.rules.fields import Resolver, json_texts, string_leaves
from spanlight.rules.model import load_rules
from spanlight.sources import sinks, streams
from spanlight.sources import stix as bundles


# -- many rules -------------------------------------------------------------------------------------------
WORDS = ["PowerShell", "cmd.exe", "certutil", "Ωmega", "straße", "a'b", "back\\slash", "K1", "iK", "x.y*z"]


def random_rules(rng, n):
    out = []
    for i in range(n):
        quote = lambda w: "'" + w.replace("'", "''").replace("\\", "\\\\").replace("*", "\\*") + "'"
        word = lambda: quote(rng.choice(WORDS)[: rng.choice([3, 4, 20])])
        item = lambda: rng.choice([
            f"a|contains: {word()}", f"b|startswith: [{word()}, {word()}]", f"a|endswith|cased: {word()}", f"c: {word()}", f"a|contains|all: [{word()}, {word()}]",
            "b|re: '^[A-Z]'", "n|gte: 5", "a: '*shell*'", "'d[any]': cmd.exe", f"d|contains: {word()}", "c: null", "c: ''",
        ])
        body = ", ".join(f"{p}: {{{item()}}}" for p in ("s", "t"))
        out.append(f"title: r{i}\ndetection: {{{body}, k: ['{rng.choice(['certutil', 'omega', 'shell'])}'], condition: {rng.choice(['s', 's or t', 's and not t', '1 of s*', 'all of them', 'k and s'])}}}")
    rules = load_rules("\n---\n".join(out))
    assert not rules.errors
    return rules


def test_prefiltered_rules_find_what_each_rule_finds(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda: rng.choice([None, "", " ".join(rng.choice([str.lower, str.upper, str])(rng.choice(WORDS)) for _ in range(rng.randrange(1, 4)))])
    rows = [(i, text(), text(), rng.choice(WORDS), rng.randrange(10), [rng.choice(WORDS)] if rng.random() < 0.7 else None) for i in range(300)] + [(300, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string, n int, d array<string>")
    rules = random_rules(rng, 40)
    want = {(r.title, x.id) for r in rules.rules for x in D.matching(df, rules, r).select("id").collect()}
    for least in (1, 1000):
        monkeypatch.setattr(D, "PREFILTER", least)
        got = [(x.rule_title, x.id) for x in D.detect(df, rules, ["id"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert D.detect(df.where("false"), rules, ["id"]).count() == 0


def test_plain_text_of_rules_says_what_columns_say(spark):
    rng = random.Random(3)
    rules = random_rules(rng, 60)
    df = spark.createDataFrame([(i, *[rng.choice([None, "", *WORDS, *map(str.lower, WORDS)]) for _ in range(3)]) for i in range(120)], "id int, a string, b string, c string")
    resolver = Resolver(df.schema)
    seen = 0
    for r in rules.rules:
        text = plain.plain_rule(r, set(r.detection), [], resolver)
        if text is None:
            continue
        seen += 1
        from spanlight.rules.compile import compile_detection, condition_column

        column = condition_column(r.conditions[0], {n: compile_detection(b, resolver, string_leaves(df.schema)) for n, b in r.detection.items()})
        assert df.where(F.expr(text[0]) != column).count() == 0, text
    only = load_rules("title: x\ndetection: {s: {a|contains: [Ab, \"c'd\"], b: x*}, condition: s}").rules[0]
    assert plain.plain_rule(only, {"s"}, [], resolver) is not None


def test_trie_pattern_takes_the_longest(spark):
    pattern = prefilter.trie_pattern(["ab", "abc", "abd", "x.y", "b"])
    assert [m for m in re.findall(f"(?=({pattern}))", "abcabxyx.yabd")] == ["abc", "b", "ab", "b", "x.y", "abd", "b"]


def test_need_of_a_rule():
    need = lambda c, body: prefilter.rule_need(load_rules(f"title: r\ndetection: {{{body}, condition: {c}}}").rules[0])
    assert need("s", "s: {a|contains: Hello, b: xy}") == {("a", "hello")}
    assert need("s or t", "s: {a: hello}, t: {b: world}") == {("a", "hello"), ("b", "world")}
    assert need("s or t", "s: {a: hello}, t: {n: 5}") is None
    assert need("s and not t", "s: {a: '*ho?lla*'}, t: {b: x}") == {("a", "lla")}
    assert need("not s", "s: {a: hello}") is None


# -- texts in JSON ----------------------------------------------------------------------------------------
def test_json_texts_at_any_depth(spark):
    rng = random.Random(2)

    def value(depth):
        if depth and rng.random() < 0.6:
            return {rng.choice(["k:", 'q"', "n"]) + str(i): value(depth - 1) for i in range(3)} if rng.random() < 0.5 else [value(depth - 1) for _ in range(3)]
        return rng.choice(["a", 'say "x": 1', "ü\\", "", 'end:', 5, None, True, "\n,]"])

    def texts(v):
        return [v] if isinstance(v, str) else [t for x in (v.values() if isinstance(v, dict) else v) for t in texts(x)] if isinstance(v, (dict, list)) else []

    values = [{"top": value(4)} for _ in range(40)]
    df = spark.createDataFrame([(json.dumps(v, ensure_ascii=rng.random() < 0.5),) for v in values], "j string")
    got = [r.t for r in df.select(json_texts(F.col("j")).alias("t")).collect()]
    assert got == [texts(v) for v in values]
    assert spark.createDataFrame([("plain",), (None,)], "j string").select(json_texts(F.col("j")).alias("t")).where("t is not null").count() == 0


def test_string_leaves_of_nested_columns(spark):
    df = spark.sql("""select 'a' s, array(named_struct('x', 'b', 'y', 1), null) t, map('k', named_struct('z', array('c', null))) m, parse_json('{"p": ["d", 2, {"q": "e"}]}') v, '{"r": "f"}' j, 3 n""")
    assert df.select(string_leaves(df.schema, {"j"}).alias("t")).first().t == ["a", "b", "c", "d", "e", "f"]


# -- addresses and expressions ----------------------------------------------------------------------------
def test_addresses_against_the_library(spark):
    texts = ["::ffff:1.2.3.4", "::1", "2001:db8::8:800:200c:417a", "1.2.3.4", "1.2.3.256", "fe80::", "1::2::3", ":1::", "2001:db8:0:0:8:800:200c:417a", "12345::", "", "::", "01.2.3.4", "::1.2.3", "64:ff9b::192.0.2.33"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    for network in ("::ffff:0:0/96", "2001:db8::/32", "1.2.0.0/16", "::/0", "64:ff9b::/96"):
        net = ipaddress.ip_network(network)

        def inside(t, net=net):
            try:
                return ipaddress.ip_address(t) in net
            except ValueError:
                return False

        assert {r.a for r in df.where(match.in_network(F.col("a"), network)).collect()} == {t for t in texts if inside(t)}, network


def test_issuperset_against_the_library(spark):
    texts = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3", "0.0.0.0/0", "10.1.0.0/99", "bad/8", "2001:db8::/32", "2001:db8::/29", "2001:db8:8000::/33", "::/0", "11.0.0.0/7"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    for constant in ("10.1.2.0/24", "10.1.2.3/32", "2001:db8::/32", "2001:db8:ffff::/48"):
        net = ipaddress.ip_network(constant)

        def holds(t, net=net):
            try:
                own = ipaddress.ip_network(t, strict=False)
            except ValueError:
                return False
            return own.version == net.version and net.subnet_of(own)

        assert {r.a for r in df.where(stix._contains_network(F.col("a"), constant)).collect()} == {t for t in texts if holds(t)}, constant


@pytest.mark.parametrize(("pattern", "modifiers", "hits"), [
    ("a(?i)b", [], {"ab", "aB", "ab\n"}), ("(?i)ab$", [], {"ab", "aB", "AB"}), ("[$|]x", [], {"$x"}), ("[]a]b", [], {"ab", "]b", "ab\n"}), (r"^\d$", [], {"5", "٣"}), ("(?:a|b$)", [], {"ab", "aB", "b", "]b", "ab\n"}), ("b$", ["m"], {"ab", "b", "]b", "ab\n"}),
])
def test_expressions(spark, pattern, modifiers, hits):
    df = spark.createDataFrame([(t,) for t in ("ab", "aB", "AB", "$x", "]b", "5", "٣", "b", "ab\n")], "t string")
    assert {r.t for r in df.where(F.col("t").rlike(match.java_regex(pattern, modifiers))).collect()} == hits


# -- patterns ---------------------------------------------------------------------------------------------
def test_repeats_of_a_composite_needs_disjoint_observations(spark):
    def run(letters, pattern):
        at = dt.datetime(2024, 1, 1)
        rows = [("h", at + dt.timedelta(seconds=i), i, c) for i, c in enumerate(letters)]
        df = spark.createDataFrame(rows, "host string, t timestamp, seq long, v string")
        return stix.evaluate(df, pattern, ["host"], "t", "seq", {"x:v": "v"}).count()

    twice = "([x:v = 'a'] FOLLOWEDBY [x:v = 'b']) REPEATS 2 TIMES"
    assert run("abb", twice) == 0
    assert run("abab", twice) >= 1
    assert run("aabb", twice) >= 1
    assert run("ab", "([x:v = 'a'] AND [x:v = 'b']) REPEATS 2 TIMES") == 0
    assert run("abba", "([x:v = 'a'] AND [x:v = 'b']) REPEATS 2 TIMES") >= 1


# -- sources and sinks ------------------------------------------------------------------------------------
def test_bundles_from_files(spark, tmp_path):
    one = {"type": "bundle", "id": "bundle--a", "objects": [{"type": "note", "id": "note--1", "modified": "2024-01-02T03:04:05Z"}, {"type": "file", "id": "file--2", "x": {"y": [1]}}]}
    (tmp_path / "a.json").write_text(json.dumps(one, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"more": False, "objects": [{"type": "url", "id": "url--3"}]}) + "\n" + json.dumps({"type": "note", "id": "note--9"}) + "\n" + "broken")
    got = {(r.bundle_id, r.place, r.id, r.type) for r in bundles.read_bundles(spark, str(tmp_path)).collect()}
    assert got == {("bundle--a", 0, "note--1", "note"), ("bundle--a", 1, "file--2", "file"), (None, 0, "url--3", "url")}


def test_delivery_waits_longer_each_time_and_keeps_what_fails(spark, tmp_path):
    waits, seen = [], []

    def fails(_):
        raise OSError("no")

    df = spark.createDataFrame([(1, "a")], "seq int, rule_title string")
    said = sinks.deliver(df, {"good": sinks.console(seen.append), "bad": fails}, str(tmp_path / "dead"), 2, 1.0, waits.append)
    assert said == {"good": "delivered", "bad": "dead letters"} and waits == [1.0, 2.0, 4.0] and json.loads(seen[0])["seq"] == 1
    assert spark.read.json(str(tmp_path / "dead")).first().sink == "bad"


def test_webhook_bodies_and_signatures(spark, tmp_path):
    out = str(tmp_path / "posts")

    def send(body, headers):
        with open(out, "ab") as f:
            f.write(body + b"|" + headers["X-Signature"].encode() + b"\n")

    sinks.webhook(send, '{"t": "${title}", "n": ${seq}}', b"key")(spark.createDataFrame([(1, 'q"x')], "seq int, title string"))
    body, signed = open(out, "rb").read().strip().rsplit(b"|", 1)
    assert json.loads(body) == {"t": 'q"x', "n": 1} and signed.decode() == sinks.signature(b"key", body)


def test_unix_sockets_take_and_give_lines(spark, tmp_path):
    path = str(tmp_path / "s")
    server = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
    server.bind(path)
    server.listen(4)
    got = []

    def accept():
        link, _ = server.accept()
        while chunk := link.recv(1 << 16):
            got.append(chunk)

    thread = threading.Thread(target=accept)
    thread.start()
    sinks.unix_socket(path)(spark.createDataFrame([(1,), (2,)], "n int").coalesce(1))
    thread.join(20)
    assert [json.loads(x)["n"] for x in b"".join(got).splitlines()] == [1, 2]

    def feed():
        link, _ = server.accept()
        link.sendall(b"one\ntwo\nhalf")
        threading.Event().wait(1)
        link.close()

    thread = threading.Thread(target=feed)
    thread.start()
    lines, end = streams._UnixReader(path, 0.3).read({"line": 0})
    thread.join(20)
    assert list(lines) == [("one",), ("two",)] and end == {"line": 2}
    os.unlink(path)


def test_looking_into_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny\nz\n")
    seen = []
    query = streams.watch(streams.read_drops(spark, str(tmp_path / "in")), seen.extend, at_most=2, checkpoint=str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 2


# -- scans ------------------------------------------------------------------------------------------------
def test_running_sums_with_null_keys_and_clashing_names(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, None]), i, rng.randrange(5), "x") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, j int, t int, v int, total string").withColumn("block", F.floor(F.col("t") / 16))
    got = {(r.k, r.j, r.t): r.run for r in scan.running_sums(df, ["k", "j"], "block", ["t"], {"run": "v"}).collect()}
    want, sums = {}, {}
    for k, j, t, v, _ in rows:
        sums[k, j] = sums.get((k, j), 0) + v
        want[k, j, t] = sums[k, j]
    assert got == want


# -- chains and includes ----------------------------------------------------------------------------------
def test_chains_have_an_order_and_no_circles():
    from spanlight.operators import correlate

    text = "title: {0}\ncorrelation: {{type: event_count, rules: [{1}], timespan: 1h, condition: {{gte: 1}}}}"
    rules = load_rules("\n---\n".join(text.format(a, b) for a, b in (("c", "b"), ("b", "a"), ("a", "rule"))))
    assert [c.title for c in correlate.chain_order(rules)] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="itself"):
        correlate.chain_order(load_rules("\n---\n".join(text.format(a, b) for a, b in (("x", "y"), ("y", "x")))))
    with pytest.raises(ValueError, match="stand on"):
        correlate.chain_order(load_rules("\n---\n".join(text.format(f"c{i}", f"c{i + 1}") for i in range(12))))


def test_includes(tmp_path):
    from spanlight.sources import dynamic

    (tmp_path / "a.yml").write_text("x: 1\ny: {include: b.json}\n")
    (tmp_path / "b.json").write_text('{"z": [1, 2]}')
    (tmp_path / "list.yml").write_text("- p\n- q\n")
    (tmp_path / "self.yml").write_text("include: self.yml\n")
    assert dynamic.expand_includes({"include": "a.yml", "x": 2, "k": ["o", {"include": "list.yml"}]}, str(tmp_path)) == {"x": 2, "y": {"z": [1, 2]}, "k": ["o", "p", "q"]}
    for bad in ("self.yml", "../outside.yml"):
        with pytest.raises(ValueError):
            dynamic.expand_includes({"include": bad}, str(tmp_path))
