"""Rules, matchers and correlations on small fixtures, against stated results and plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from spanlight.operators import alerts as A
from spanlight.operators import correlate as C
from spanlight.operators import enrich, risk, schemas, stix
from spanlight.operators.detect import detect, matching
from spanlight.rules import analysis, lucene, pipeline
from spanlight.rules.match import base64_offsets, dash_variants, tokens
from spanlight.rules.model import Collection, RuleError, load_rules, parse_condition, seconds
from spanlight.rules.stix_pattern import PatternError, parse
from spanlight.sources import dynamic, formats, sinks


def hits(spark, rows, schema, detection, **options):
    """The ids of the rows that a rule matches."""
    collection = load_rules("title: t\nsigma-version: 3\ndetection:\n" + "\n".join("  " + line for line in detection.strip().splitlines()))
    assert not collection.errors, collection.errors
    df = spark.createDataFrame(rows, schema)
    return sorted(r.i for r in matching(df, collection, collection.rules[0], **options).collect())


# -- conditions -------------------------------------------------------------------------------------------
def test_condition_precedence_and_errors():
    assert parse_condition("a or b and not c") == ("or", [("name", "a"), ("and", [("name", "b"), ("not", ("name", "c"))])])
    assert parse_condition("(1 of x_* or all of them)") == ("or", [("of", 1, "x_*"), ("of", "all", "them")])
    for bad in ("", "a and", "(a", "a b", "not"):
        with pytest.raises(RuleError):
            parse_condition(bad)


def test_documents_global_reset_and_errors():
    c = load_rules("action: global\nlevel: high\n---\ntitle: a\ndetection: {s: {x: 1}, condition: s}\n---\naction: reset\n---\ntitle: b\ndetection: {s: {x: 1}, condition: s}\n---\ntitle: c\ndetection: {s: {x: 1}, condition: nope}\n---\n- 1")
    assert [(r.title, r.level) for r in c.rules] == [("a", "high"), ("b", None)] and len(c.errors) == 2
    assert load_rules("a: [").errors
    assert [seconds(x) for x in ("15s", "2m", "1h", "1d", "1w", "1M", "1y")] == [15, 120, 3600, 86400, 604800, 2629746, 31556952]


# -- values and matchers ----------------------------------------------------------------------------------
def test_value_forms():
    assert tokens(r"a\*b*c?\\") == ["a*b", 0, "c", 1, "\\"]
    assert base64_offsets(b"foo") == ["Zm9v", "Zvbw", "mb28"]
    assert dash_variants("-a /b")[0] == "-a /b" and len(dash_variants("-a /b")) == 25


TEXTS = [(0, "Éva\nx", "5"), (1, "50%_off", " 5"), (2, None, "1d"), (3, "a*b", "1e1"), (4, "", "-3"), (5, "C:\\x\\cmd.exe /c", None)]


@pytest.mark.parametrize(("detection", "want"), [
    ("s: {t: 'éVA*'}\ncondition: s", [0]), ("s: {t|contains: '%_'}\ncondition: s", [1]), ("s: {t: 'a\\*b'}\ncondition: s", [3]), ("s: {t: null}\ncondition: s", [2]),
    ("s: {t: ''}\ncondition: s", [4]), ("s: {t|exists: false}\ncondition: s", [2]), ("s: {t|neq: ''}\ncondition: s", [0, 1, 3, 5]), ("s: {t: ''}\ncondition: not s", [0, 1, 2, 3, 5]),
    ("s: {n|gte: 5}\ncondition: s", [0, 3]), ("s: {n: -3}\ncondition: s", [4]), ("s: {t|re: 'x$'}\ncondition: s", [0]), ("s: {t|re: '^É'}\ncondition: s", [0]), ("s: {t|re|i: '^é'}\ncondition: s", [0]),
    ("s: {t|cased|contains: 'É'}\ncondition: s", [0]), ("s: {t|windash|contains: ' -c'}\ncondition: s", [5]), ("s: {t|endswith: '\\cmd.exe /c'}\ncondition: s", [5]),
    ("s: {t|contains|all: [a, b]}\ncondition: s", [3]), ("s: {t: ['a\\*b', '']}\ncondition: s", [3, 4]), ("s: {nothing: 1}\ncondition: s", []), ("s: {nothing: null}\ncondition: s", [0, 1, 2, 3, 4, 5]),
    ("s: {nothing|neq: 1}\ncondition: s", []), ("k: [cmd, _off]\ncondition: k", [1, 5]), ("k: {'|all': [cmd, exe]}\ncondition: k", [5]), ("a: {t: 'a?b'}\ncondition: 1 of zzz*", []), ("a: {t: 'a?b'}\ncondition: all of zzz*", [0, 1, 2, 3, 4, 5]),
    ("s:\n  - {t: '', n: -3}\n  - {n: 5}\ncondition: s", [0, 4]),
])
def test_text_matchers(spark, detection, want):
    assert hits(spark, TEXTS, "i int, t string, n string", detection) == want


def test_addresses(spark):
    rows = [(0, "10.1.2.3"), (1, "10.1.2.300"), (2, "2001:db8::1"), (3, "2001:DB8:0:0::ff"), (4, "2001:db9::1"), (5, None), (6, "::1"), (7, "host")]
    assert hits(spark, rows, "i int, a string", "s: {a|cidr: 10.0.0.0/8}\ncondition: s") == [0]
    assert hits(spark, rows, "i int, a string", "s: {a|cidr: '2001:db8::/32'}\ncondition: s") == [2, 3]
    assert hits(spark, rows, "i int, a string", "s: {a|cidr: '::/0'}\ncondition: s") == [2, 3, 4, 6]


def test_doubles_as_text_and_flat_before_nested(spark):
    rows = [(0, 1.0, ("x",), "y"), (1, 1.5, ("y",), "x"), (2, None, None, None)]
    schema = "i int, d double, a struct<b:string>, `a.b` string"
    assert hits(spark, rows, schema, "s: {d|contains: '1'}\ncondition: s") == [0, 1]
    assert hits(spark, rows, schema, "s: {d|endswith: '1'}\ncondition: s") == [0]
    assert hits(spark, rows, schema, "s: {a.b: x}\ncondition: s") == [1]


def test_arrays_of_structs_and_positions(spark):
    rows = [(0, [("a", 1), ("b", 9)]), (1, [("a", 9)]), (2, []), (3, None)]
    schema = "i int, c array<struct<n:string,v:int>>"
    assert hits(spark, rows, schema, "s: {'c[any]': {n: a, v|gte: 5}}\ncondition: s") == [1]
    assert hits(spark, rows, schema, "s: {c.n: a, c.v|gte: 5}\ncondition: s") == [0, 1]
    assert hits(spark, rows, schema, "s: {'c[all]': {v|gte: 5}}\ncondition: s") == [1]
    assert hits(spark, rows, schema, "s: {'c[all_or_empty]': {v|gte: 5}}\ncondition: s") == [1, 2, 3]
    assert hits(spark, rows, schema, "s: {'c[none]': {v|gte: 5}}\ncondition: s") == [2, 3]
    assert hits(spark, rows, schema, "s: {'c[-1].n': b}\ncondition: s") == [0]
    assert hits(spark, rows, schema, "s: {'c[any]': {x: {n: a}, y: {v: 9}, condition: x and not y}}\ncondition: s") == [0]


def test_modifier_conflicts():
    for key in ("a|contains|startswith", "a|base64|base64offset", "a|wide|utf16be", "a|i", "a|nope"):
        from spanlight.rules.match import check_modifiers

        with pytest.raises(RuleError):
            check_modifiers(key.split("|")[1:])


def test_detect_without_usable_rules(spark):
    assert detect(spark.createDataFrame(TEXTS, "i int, t string, n string"), Collection()).count() == 0


# -- correlations against plain folds ---------------------------------------------------------------------
BASE = "title: e\nname: e\ndetection: {s: {k: e}, condition: s}\n---\ntitle: f\nname: f\ndetection: {s: {k: f}, condition: s}\n---\n"


def events(seed, n=160, users=("a", "b", None)):
    rng, t, out = random.Random(seed), 1_700_000_000, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 5, 10, 11, 30])
        out.append((i, t, rng.choice(users), rng.choice("ef"), rng.choice([1.0, 2.0, None])))
    return out


def run(spark, rows, body, attributes="{}"):
    c = load_rules(BASE + f"title: c\ncustom_attributes: {attributes}\ncorrelation: {body}")
    assert not c.errors
    df = spark.createDataFrame(rows, "i long, t long, u string, k string, v double")
    return sorted((r.seq, r.value) for r in C.correlate(df, c, c.correlations[0], "t", "i").collect())


def plain(rows, span, need, gap=None, window="sliding", mute=0, reset=False, kinds="e"):
    state, last, out = {}, {}, []
    for i, t, u, k, _ in rows:
        if k not in kinds:
            continue
        own = state.setdefault(u, [])
        if window == "sliding":
            own[:] = [x for x in own if x >= t - span]
        elif window == "tumbling":
            own[:] = [x for x in own if x // span == t // span]
        elif own and (t - own[-1] > gap or t - own[0] > span):
            own.clear()
        own.append(t)
        if len(own) >= need and (u not in last or t - last[u] >= mute):
            out.append((i, float(len(own))))
            last[u] = t
            if reset:
                own.clear()
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_in_all_windows(spark, seed):
    rows = events(seed)
    assert run(spark, rows, "{type: event_count, rules: [e], group-by: [u], timespan: 40s, condition: {gte: 3}}") == plain(rows, 40, 3)
    assert run(spark, rows, "{type: event_count, rules: [e], group-by: [u], timespan: 60s, window: tumbling, condition: {gte: 3}}") == plain(rows, 60, 3, window="tumbling")
    assert run(spark, rows, "{type: event_count, rules: [e], group-by: [u], timespan: 70s, window: session, gap: 30s, condition: {gte: 3}}") == plain(rows, 70, 3, 30, "session")
    assert run(spark, rows, "{type: event_count, rules: [e, f], timespan: 20s, condition: {gte: 6}}") == plain([(i, t, None, k, v) for i, t, _, k, v in rows], 20, 6, kinds="ef")


def test_suppress_and_reset(spark):
    rows = events(3)
    body = "{type: event_count, rules: [e], group-by: [u], timespan: 60s, condition: {gte: 2}}"
    assert run(spark, rows, body, "{suppress: 50s}") == plain(rows, 60, 2, mute=50)
    assert run(spark, rows, body, "{action: reset}") == plain(rows, 60, 2, reset=True)
    assert run(spark, rows, body, "{action: reset, suppress: 50s}") == plain(rows, 60, 2, mute=50, reset=True)


def test_window_boundary_is_closed_and_missing_values_do_not_count(spark):
    rows = [(0, 100, "a", "e", None), (1, 140, "a", "e", 2.0), (2, 181, "a", "e", 2.0)]
    assert run(spark, rows, "{type: event_count, rules: [e], group-by: [u], timespan: 40s, condition: {gte: 2}}") == [(1, 2.0)]
    assert run(spark, rows, "{type: value_sum, rules: [e], group-by: [u], timespan: 100s, condition: {gte: 2, field: v}}") == [(1, 2.0), (2, 4.0)]
    assert run(spark, rows, "{type: value_avg, rules: [e], timespan: 1s, condition: {lt: 1, field: v}}") == [(0, 0.0)]


def test_ordered_temporal(spark):
    rows = [(0, 10, "a", "f", None), (1, 20, "a", "e", None), (2, 30, "a", "f", None), (3, 500, "a", "f", None)]
    assert run(spark, rows, "{type: temporal_ordered, rules: [e, f], group-by: [u], timespan: 60s, condition: {gte: 2}}") == [(2, 2.0)]
    assert run(spark, rows, "{type: temporal, rules: [e, f], group-by: [u], timespan: 60s, condition: {gte: 2}}") == [(1, 2.0), (2, 2.0)]


# -- alerts, risk -----------------------------------------------------------------------------------------
def test_entity_incidents_are_connected_components(spark):
    rng = random.Random(4)
    rows = [(i, f"h{rng.randrange(40)}", f"u{rng.randrange(60)}") for i in range(60)] + [(100 + i, f"c{i}", f"d{i // 2}") for i in range(0)] + [(200 + i, f"x{i}", f"x{i}") for i in range(3)]
    chain = [(300 + i, f"n{i}", f"m{(i + 1) // 2}" if i % 2 else f"n{i}") for i in range(2)]
    rows += chain + [(400, None, ""), (401, "stop", None), (402, "stop", None)]
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for column in (1, 2):
        seen = {}
        for r in rows:
            if r[column] and r[column] != "stop":
                if r[column] in seen:
                    a, b = sorted((find(seen[r[column]]), find(r[0])))
                    root[b] = a
                seen.setdefault(r[column], r[0])
    df = spark.createDataFrame(rows, "seq long, h string, u string")
    got = {r.seq: r.incident for r in A.entity_incidents(df, A.EntityGraph(["h", "u"], ["stop"])).collect()}
    assert got == {s: find(s) for s in root}


def test_fingerprint_is_fnv(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")

    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    assert [r.f for r in df.select(A.fnv1a(F.col("x")).alias("f")).collect()] == [fnv(b"a\0"), fnv(b"\0")]


def test_risk_cooldown(spark):
    rows = [(i, 100 * i, "a", 60.0, ["execution"]) for i in range(8)]
    df = spark.createDataFrame(rows, "seq long, ts long, e string, score double, tactics array<string>")
    got = sorted(r.ts for r in risk.risk_incidents(df, ["e"], 250, 120.0, cooldown_s=300).collect())
    assert got == [100, 400, 700]


# -- the rest ---------------------------------------------------------------------------------------------
def test_enrichment_calls_and_errors(spark):
    df = spark.createDataFrame([("a",), ("bad",), (None,)], "x string")

    def ask(values):
        if values.iloc[0] == "bad":
            raise RuntimeError
        return values.str.upper()

    assert {(r.x, r.y) for r in enrich.call(df, "y", ask, "x").collect()} == {("a", "A"), ("bad", None), (None, None)}
    assert {r.x for r in enrich.call(df, "y", ask, "x", "drop").collect()} == {"a", None}


def test_pipeline_steps():
    rule = load_rules("title: t\nlogsource: {product: windows, category: process_creation}\ndetection: {s: {Image: 'A', Hashes: 'MD5=00*'}, condition: s}").rules[0]
    steps = pipeline.load_pipeline("transformations:\n- {type: hashes_fields, field_prefix: h}\n- {type: field_name_mapping, mapping: {Image: [a, b]}}\n- {type: case_transformation, method: lower}\n- {type: field_name_suffix, suffix: x}\n- {type: set_custom_attribute, attribute: k, value: v}")
    out = pipeline.apply_pipelines(rule, [steps, pipeline.builtin("sysmon")])
    assert out.detection["s"] == [{"ax": "a", "hMD5x": "00"}, {"bx": "a", "hMD5x": "00"}] and out.attributes == {"k": "v"}
    assert out.detection["_added_0"] == {"EventID": [1]} and rule.detection["s"]["Image"] == "A"
    with pytest.raises(RuleError):
        pipeline.apply_pipelines(rule, [pipeline.load_pipeline("transformations: [{type: rule_failure, message: no}]")])
    assert pipeline.finalize(["a", "b"], [{"type": "concat", "separator": ";", "prefix": "<", "suffix": ">"}]) == "<a;b>"


def test_query_strings():
    rule = lucene.from_query('a:"x y" AND NOT (b:/r.*/ OR c:[1 TO 5}) d')
    assert rule.detection == {"s0": {"a": "x y"}, "s1": {"b|re": "r.*"}, "s2": {"c|gte": 1, "c|lt": 5}, "s3": ["d"]}
    assert lucene.roundtrip(rule).detection == rule.detection
    for bad in ("(a:1", "a:1 AND", ")"):
        with pytest.raises(RuleError):
            lucene.from_query(bad)
    assert lucene.convert(Collection([rule]), "t")[1]


def test_lint():
    codes = {f.code for f in analysis.lint(load_rules("title: a\nlevel: odd\ntags: [A, A]\ndetection: {s: {x: 1}, t: {y: 1}, condition: s}"))}
    assert codes == {"missing_id", "invalid_level", "missing_logsource", "invalid_tag", "duplicate_tags", "unused_selection"}


def test_side_inputs(tmp_path):
    (tmp_path / "a.json").write_text('{"emails": ["x@y", "z@y"], "n": {"k": 1}}')
    (tmp_path / "b.csv").write_text("h,r\nweb,front\n")
    s = dynamic.Sources({"a": dynamic.Source("a", str(tmp_path / "a.json")), "b": dynamic.Source("b", str(tmp_path / "b.csv"), "csv"), "c": dynamic.Source("c", "/none", on_error="default", default=[1]), "d": dynamic.Source("d", "/none", on_error="fail")})
    assert s.expand({"v": ["${source.a.emails}", "w"], "t": "k=${source.a.n.k}", "u": "${source.c}"}) == {"v": ["x@y", "z@y", "w"], "t": "k=1", "u": [1]}
    assert dynamic.extract(s.get("b"), "$[0].r") == "front" and dynamic.extract({"a": []}, ".a[].b") is None
    with pytest.raises(OSError):
        s.get("d")


def test_formats(spark):
    lines = ['<34>Oct 11 22:14:15 host su[12]: failed for x', '<165>1 2003-10-11T22:14:15.003Z h app - ID47 [ex@1 a="b\\"c"] {"k":"v"}', 'x CEF:0|V|P\\|q|1|9|n|5|src=1.2.3.4 msg=a b\\=c dst=5', 'level=info msg="a \\"b\\"" x y=', '{"a":{"b":1},"c":null}', "", "{broken"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r.raw: (r.format, r.body) for r in formats.parse_lines(df).collect()}
    assert [got[x][0] for x in lines if x] == ["syslog", "syslog", "plain", "plain", "json", "plain"]
    assert got[lines[0]][1]["procid"] == "12" and got[lines[0]][1]["facility"] == "4"
    assert got[lines[1]][1]["ex@1.a"] == 'b"c' and got[lines[1]][1]["k"] == "v" and got[lines[1]][1]["msgid"] == "ID47"
    cef = formats.parse_lines(df, "cef").collect()
    assert len(cef) == 1 and cef[0].body["msg"] == "a b=c" and cef[0].body["deviceProduct"] == "P|q"
    logfmt = {r.raw: r.body for r in formats.parse_lines(df, "logfmt").collect()}
    assert logfmt[lines[3]] == {"level": "info", "msg": 'a "b"', "x": "true", "y": ""}
    otlp = spark.createDataFrame([('{"resourceLogs":[{"resource":{"attributes":[{"key":"s","value":{"stringValue":"x"}}]},"scopeLogs":[{"scope":{"name":"n"},"logRecords":[{"timeUnixNano":"1700000000123456789","body":{"stringValue":"hi"}}]}]}]}',)], "value string")
    r = formats.otlp_events(otlp).collect()[0]
    assert (r.message, r.scope, r.resource, r.time.microsecond) == ("hi", "n", {"s": "x"}, 123456)


def test_delivery_and_dead_letters(spark, tmp_path):
    def broken(_):
        raise RuntimeError("down")

    said = sinks.deliver(spark.createDataFrame([(1,)], "x int"), {"ok": lambda b: b.count(), "no": broken}, str(tmp_path / "dead"))
    assert said == {"ok": "delivered", "no": "dead letters"} and spark.read.json(str(tmp_path / "dead")).collect()[0].payload == '{"x":1}'
    assert sinks.signature(b"k", b"b").startswith("sha256=")


def test_patterns_and_schemas(spark):
    tree = parse("[a:b = 'x' AND a:c NOT IN (1, 2)] REPEATS 2 TIMES WITHIN 5 MINUTES")
    assert tree.kind == "within" and tree.value == 300 and tree.parts[0].kind == "repeats"
    for bad in ("[a:b = ]", "[a:b 'x']", "a:b = 1", "[a:b = 1", "[a:b = 1] WITHIN 1 EONS"):
        with pytest.raises(PatternError):
            parse(bad)
    df = spark.createDataFrame([(0, "h", "10.1.2.3"), (1, "h", "10.0.0.0/8"), (2, "h", None)], "i int, k string, ip string").withColumn("t", F.timestamp_seconds("i"))
    sub = stix.evaluate(df, "[x:ip ISSUBSET '10.1.0.0/16']", ["k"], "t", "i").collect()
    sup = stix.evaluate(df, "[x:ip ISSUPERSET '10.1.0.0/16']", ["k"], "t", "i").collect()
    assert [r.end_us for r in sub] == [0] and [r.end_us for r in sup] == [1_000_000]
    clusters = schemas.discover([(["a", "b", "c"], 10), (["a", "b"], 5), (["x"], 2)])
    assert [(c["n"], c["core"]) for c in clusters] == [(15, ["a", "b"]), (2, ["x"])]
