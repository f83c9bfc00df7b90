"""Threat intelligence: patterns over observations, the object graph, the store, markings and checks."""

from __future__ import annotations

import datetime as dt
import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.rules.fields import Resolver, number_of, text_of
from spanlight.rules.match import hex_address, in_network, java_quote, java_regex
from spanlight.rules.stix_pattern import Node, PatternError, parse
from spanlight.session import materialise

FAR = 1 << 62


# -- patterns ---------------------------------------------------------------------------------------------
def comparison(node: Node, resolver: Resolver) -> Column:
    """The bracketed part of a pattern as a row predicate. A path ``type:a.b`` is the field ``a.b`` (or what the
    resolver maps ``type:a.b`` to); values of different kinds never compare."""
    if node.kind in ("all", "any"):
        return reduce((lambda a, b: a & b) if node.kind == "all" else (lambda a, b: a | b), [comparison(p, resolver) for p in node.parts])
    path, op, value, negated = node.value
    found = resolver.find(path) or resolver.find(path.split(":", 1)[1].replace("[*]", ""))
    if found is None:
        return F.lit(op == "EXISTS" and negated)
    if op == "EXISTS":
        return ~found.column.isNotNull() if negated else found.column.isNotNull()
    test = lambda v: _compare(v, found.type, op, value)
    hit = F.coalesce(F.exists(found.column, lambda x: F.coalesce(test(x), F.lit(False))) if found.many else test(found.column), F.lit(False))
    return ~hit if negated else hit


def _compare(v: Column, kind: T.DataType, op: str, value) -> Column:
    if op == "IN":
        return reduce(lambda a, b: a | b, [F.coalesce(_compare(v, kind, "=", x), F.lit(False)) for x in value])
    text = text_of(v, kind)
    if op == "LIKE":
        body = "".join(".*" if c == "%" else "." if c == "_" else java_quote(c) for c in str(value))
        return text.rlike(rf"(?sd)^{body}\z")
    if op == "MATCHES":
        return text.rlike(java_regex(str(value), []))
    if op == "ISSUBSET":
        return in_network(F.substring_index(text, "/", 1), str(value))
    if op == "ISSUPERSET":
        return _contains_network(text, str(value))
    if isinstance(value, tuple):
        if value[0] == "timestamp":
            left, right = v.try_cast("timestamp") if isinstance(kind, T.StringType) else v.cast("timestamp"), F.lit(value[1]).cast("timestamp")
        else:
            left, right = F.lower(text), F.lit(str(value[1]).lower())
    elif isinstance(value, bool):
        left, right = v.cast("boolean") if isinstance(kind, T.BooleanType) else F.lower(text) == "true", F.lit(value)
    elif isinstance(value, (int, float)):
        left, right = number_of(v, kind), F.lit(float(value))
    else:
        if isinstance(kind, T.NumericType):
            return F.lit(op == "!=")
        left, right = text, F.lit(value)
    return {"=": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]


def _contains_network(text: Column, network: str) -> Column:
    """Whether the row's address or network contains the constant one: same version, no longer prefix, equal leading bits."""
    net = ipaddress.ip_network(network, strict=False)
    digits = net.max_prefixlen // 4
    own, other = hex_address(F.substring_index(text, "/", 1), net.version), F.lit(f"{int(net.network_address):0{digits}x}")
    bits = F.when(F.instr(text, "/") > 0, F.substring_index(text, "/", -1).try_cast("int")).otherwise(net.max_prefixlen)
    whole, rest = F.floor(bits / 4).cast("int"), bits % 4
    nibble = lambda h: F.call_function("shiftright", F.conv(F.substring(h, whole + 1, F.lit(1)), 16, 10).cast("int"), F.lit(4) - rest)
    same = (F.substring(own, F.lit(1), whole) == F.substring(other, F.lit(1), whole)) & ((rest == 0) | (nibble(own) == nibble(other)))
    return F.coalesce(bits.between(0, net.prefixlen) & same, F.lit(False))


def evaluate(observations: DataFrame, pattern: str, keys: list[str], time: str, seq: str, mapping: dict | None = None, json: set[str] = frozenset()) -> DataFrame:
    """The matches of a pattern per key group (a source, a host): ``keys, start_us, end_us``, one row per tightest
    witness, ending at each observation that completes one.

    AND needs distinct observations in any order (spans of its parts may overlap), FOLLOWEDBY an order of times (equal times count as ordered);
    WITHIN bounds a witness's length, REPEATS asks for n matches that share no observation, START/STOP bounds the times. No
    observation is joined to others: each operator is a running maximum, or a look n rows back, per key. A part that is
    a span itself stands with its tightest witnesses only.
    """
    tree = parse(pattern)
    resolver = Resolver(observations.schema, set(json), mapping or {})
    rows = observations.select(*[F.col(k) for k in keys], F.unix_micros(F.col(time).cast("timestamp")).alias("__t"), F.col(seq).alias("__seq"), *[F.col(f"`{c}`") for c in observations.columns if c not in keys])
    out = _matches(tree, rows, resolver, keys)
    return out.select(*keys, F.col("__s").alias("start_us"), F.col("__e").alias("end_us")).distinct()


def _matches(node: Node, rows: DataFrame, resolver: Resolver, keys: list[str], keep: int = 1) -> DataFrame:
    """Bindings ``keys, __s, __e, __seq, __w`` (``__seq`` null once several observations take part, ``__w`` all of them).

    ``keep`` is how many matches of a sequence's beginning each end is paired with: REPEATS needs as many as it counts."""
    if node.kind == "obs":
        return rows.where(comparison(node.parts[0], resolver)).select(*keys, F.col("__t").alias("__s"), F.col("__t").alias("__e"), F.col("__seq").cast("string").alias("__seq"), F.array(F.col("__seq").cast("string")).alias("__w"))
    if node.kind == "or":
        return reduce(DataFrame.unionByName, [_matches(p, rows, resolver, keys, keep) for p in node.parts]).distinct()
    if node.kind == "startstop":
        start, stop = (int(dt.datetime.fromisoformat(x.replace("Z", "+00:00")).timestamp() * 1e6) for x in node.value)
        return _matches(node.parts[0], rows, resolver, keys, keep).where((F.col("__s") >= start) & (F.col("__e") < stop))
    if node.kind == "within":
        return _matches(node.parts[0], rows, resolver, keys, keep).where(F.col("__e") - F.col("__s") <= int(node.value * 1_000_000))
    if node.kind == "repeats":
        inner = _matches(node.parts[0], rows, resolver, keys, keep * node.value)
        if _taking_part(node.parts[0]) > 1 and node.value > 1:  # matches of several observations must not share any
            return _together([inner] * node.value, keys, _taking_part(node))
        w = Window.partitionBy(*keys).orderBy("__e", "__s", "__seq")
        back = F.lag("__s", node.value - 1).over(w)
        all_of = F.array_sort(F.array_distinct(F.flatten(F.collect_list("__w").over(w.rowsBetween(1 - node.value, 0)))))
        return inner.withColumns({"__first": back, "__w": all_of}).where(F.col("__first").isNotNull()).select(*keys, F.col("__first").alias("__s"), "__e", F.lit(None).cast("string").alias("__seq"), "__w")
    if node.kind == "followedby":
        step = (lambda a, b: _followed(a, b, keys)) if keep == 1 else (lambda a, b: _followed_by_several(a, b, keys, keep))
        return reduce(step, [_matches(p, rows, resolver, keys, keep) for p in node.parts])
    if node.kind == "and":
        parts = _conjuncts(node)
        return _together([_matches(p, rows, resolver, keys, keep) for p in parts], keys, sum(map(_taking_part, parts)))
    raise PatternError(node.kind)


def _conjuncts(node: Node) -> list[Node]:
    return [x for p in node.parts for x in _conjuncts(p)] if node.kind == "and" else [node]


def _taking_part(node: Node) -> int:
    """The most observations that a match of the pattern is made of."""
    if node.kind == "obs":
        return 1
    counts = [_taking_part(p) for p in node.parts]
    return max(counts) if node.kind == "or" else sum(counts) * (node.value if node.kind == "repeats" else 1)


def _followed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each right match the left one that starts last among those that end no later than it starts."""
    none = F.lit(None).cast("struct<s:bigint,w:array<string>>")
    line = left.select(*keys, F.col("__e").alias("__t"), F.lit(0).alias("__side"), F.struct(F.col("__s").alias("s"), F.col("__w").alias("w")).alias("__ls"), F.lit(None).cast("bigint").alias("__re"), "__seq", F.lit(None).cast("array<string>").alias("__w")).unionByName(
        right.select(*keys, F.col("__s").alias("__t"), F.lit(1).alias("__side"), none.alias("__ls"), F.col("__e").alias("__re"), "__seq", "__w")
    )
    upto = Window.partitionBy(*keys).orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    peers = Window.partitionBy(*keys, "__t")
    same = Window.partitionBy(*keys, "__t", "__seq")
    starts = line.withColumns({
        "__before": F.max("__ls").over(upto),
        "__peer": F.max("__ls").over(peers),
        "__other": F.min("__ls").over(peers),
        "__n": F.count("__ls").over(peers),
        "__own": F.when(F.col("__seq").isNotNull(), F.count("__ls").over(same)).otherwise(0),
    })
    # a left match at the same time counts unless it is the same single observation
    peer = F.when(F.arrays_overlap("__peer.w", "__w"), F.struct(F.col("__peer.s").alias("s"), F.col("__other.w").alias("w"))).otherwise(F.col("__peer"))
    start = F.when(F.col("__n") > F.col("__own"), peer).otherwise(F.col("__before"))
    found = starts.where("__side = 1").withColumn("__start", start).where(F.col("__start").isNotNull())
    return found.select(*keys, F.col("__start.s").alias("__s"), F.col("__re").alias("__e"), F.lit(None).cast("string").alias("__seq"), F.array_sort(F.array_distinct(F.concat("__start.w", "__w"))).alias("__w"))


def _followed_by_several(left: DataFrame, right: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """For each right match the ``keep`` last left ones that end no later than it starts and share no observation with it."""
    side = F.struct("__s", "__e", "__w")
    line = left.select(*keys, F.col("__e").alias("__t"), F.lit(0).alias("__side"), side.alias("__l"), side.alias("__r")).unionByName(
        right.select(*keys, F.col("__s").alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(left.select(side.alias("x")).schema["x"].dataType).alias("__l"), side.alias("__r"))
    )
    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY __t, __side, __r)"
    # as many more as can share an observation with the right match
    back = F.array(*[F.expr(f"lag(__l, {k}) IGNORE NULLS {over}") for k in range(1, 2 * keep + 1)])
    pairs = line.withColumn("__back", back).where("__side = 1").select(*keys, "__r", F.explode(F.slice(F.filter("__back", lambda x: x.isNotNull() & ~F.arrays_overlap(x["__w"], F.col("__r.__w"))), 1, keep)).alias("__l"))
    return pairs.select(*keys, F.col("__l.__s").alias("__s"), F.col("__r.__e").alias("__e"), F.lit(None).cast("string").alias("__seq"), F.array_sort(F.array_distinct(F.concat("__l.__w", "__r.__w"))).alias("__w")).distinct()


def _together(parts: list[DataFrame], keys: list[str], most: int) -> DataFrame:
    """For each match of a part, as the one that ends last, the latest matches of all other parts that end no later and
    share no observation with it or each other.

    Every row carries the last ``most`` matches of each part (as many as a witness has observations: when the others have
    taken theirs, one is left) and the one that starts last.
    """
    n = len(parts)
    line = reduce(DataFrame.unionByName, [p.select(*keys, "__s", "__e", "__w", F.lit(i).alias("__side")) for i, p in enumerate(parts)])
    line = line.withColumns({f"__x{i}": F.when(F.col("__side") == i, F.struct(F.col("__s").alias("s"), F.col("__w").alias("w"))) for i in range(n)})
    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY __e, __side, __s, __w)"
    upto = Window.partitionBy(*keys).orderBy("__e").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*keys, "__e").orderBy("__side", "__s", "__w").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = line.withColumns({f"__b{i}": F.max(f"__x{i}").over(upto) for i in range(n)} | {f"__x{i}_{k}": F.expr(f"lag(__x{i}, {k}) IGNORE NULLS {over}") for i in range(n) for k in range(1, most + 1)})
    line = line.withColumns({f"__l{i}": F.array(f"__x{i}", *[f"__x{i}_{k}" for k in range(1, most + 1)]) for i in range(n)})
    line = line.withColumns({f"__l{i}": F.array_distinct(F.filter(F.concat(F.last(f"__l{i}").over(peers), F.array(f"__b{i}")), lambda x: x.isNotNull())) for i in range(n)})

    def joined(combined: Column, i: int) -> Column:
        grown = F.flatten(F.transform(combined, lambda c: F.transform(F.filter(F.col(f"__l{i}"), lambda x: ~F.arrays_overlap(c["w"], x["w"])), lambda x: F.struct(F.least(c["s"], x["s"]).alias("s"), F.concat(c["w"], x["w"]).alias("w")))))
        return F.when(F.col("__side") == i, combined).otherwise(grown)

    line = line.withColumn("__c", F.array(F.struct(F.col("__s").alias("s"), F.col("__w").alias("w"))))
    for i in range(n):
        line = line.withColumn("__c", joined(F.col("__c"), i))
    best = line.withColumn("__best", F.array_max("__c")).where(F.col("__best").isNotNull())
    return best.select(*keys, F.col("__best.s").alias("__s"), "__e", F.lit(None).cast("string").alias("__seq"), F.array_sort("__best.w").alias("__w")).distinct()


# -- graph ------------------------------------------------------------------------------------------------
def reference_edges(objects: DataFrame, body: str = "body") -> DataFrame:
    """``src, path, dst``: the embedded references (members that end in ``_ref`` or ``_refs``) of JSON objects."""
    names = F.filter(F.json_object_keys(F.col(body)), lambda k: k.rlike("_refs?$"))
    pairs = objects.select(F.col("id").alias("src"), F.from_json(F.col(body), "map<string,string>").alias("m"), F.explode(names).alias("path"))
    value = F.element_at("m", F.col("path"))
    members = F.when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.array(value))
    return pairs.select("src", "path", F.explode(members).alias("dst")).where(F.col("dst").isNotNull())


def neighbours(edges: DataFrame, ids: DataFrame, direction: str = "out", types: list[str] = ()) -> DataFrame:
    """The edges out of, into, or at the given ids (column ``id``); ``types`` limits ``rel_type``."""
    picked = edges.where(F.col("rel_type").isin(list(types))) if types else edges
    out = picked.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(*edges.columns)
    into = picked.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)
    return out if direction == "out" else into if direction == "in" else out.unionByName(into).distinct()


def expand(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``id, depth``: what is reached from the start ids in at most ``depth`` steps along edges in either direction,
    with the least number of steps."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = start.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for step in range(1, depth + 1):
        reached = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        fresh = materialise(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(step)), "frontier")
        if not fresh.limit(1).count():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen


# -- store ------------------------------------------------------------------------------------------------
def latest_versions(objects: DataFrame, key: str = "id", modified: str = "modified", ties: tuple[str, ...] = ("rec_no", "name", "added_at")) -> DataFrame:
    """The newest version of each object (ties: the greatest ``ties``, nulls last); an aggregation with map-side combine."""
    others = [c for c in objects.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(modified, *ties))
    return objects.groupBy(key).agg(best.alias("v")).select(key, "v.*")


def store_query(objects: DataFrame, ids: list[str] = (), types: list[str] = (), text: str | None = None, modified_after: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Objects by id, type, text in the name and time, sorted by id, from ``offset`` on."""
    out = objects
    if ids:
        out = out.where(F.col("id").isin(list(ids)))
    if types:
        out = out.where(F.col("type").isin(list(types)))
    if text is not None:
        out = out.where(F.contains(F.lower("name"), F.lit(text.lower())))
    if modified_after is not None:
        out = out.where(F.col("modified") > F.lit(modified_after).cast("timestamp"))
    out = out.orderBy("id")
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


# -- markings ---------------------------------------------------------------------------------------------
# fixed values: the traffic light levels, least restrictive first
TLP = ["clear", "white", "green", "amber", "amber+strict", "red"]


def most_restrictive(marked: DataFrame, key: str = "id", level: str = "tlp") -> DataFrame:
    """``key, tlp``: the most restrictive level of each object's markings."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TLP]), F.lower(F.regexp_replace(F.col(level), "(?i)^tlp:", "")))
    return marked.groupBy(key).agg(F.max(rank).alias("r")).select(key, F.when(F.col("r") > 0, F.element_at(F.array(*[F.lit(t) for t in TLP]), F.col("r").cast("int"))).alias("tlp"))


def disclosable(marked: DataFrame, ceiling: str, key: str = "id", level: str = "tlp") -> DataFrame:
    """The objects that may be shown to an audience of a level: none of their markings is stricter; unmarked ones may."""
    allowed = TLP[: TLP.index(ceiling) + 1]
    return most_restrictive(marked, key, level).where(F.col("tlp").isNull() | F.col("tlp").isin(allowed))


# -- checks -----------------------------------------------------------------------------------------------
ID = r"^[a-z0-9]+(?:-[a-z0-9]+)*--[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def diagnostics(objects: DataFrame) -> DataFrame:
    """``rec_no, code``: the rules that an object breaks (id form, id and type, version, times, references, JSON)."""
    id_, ref = F.col("id"), F.col("created_by_ref")
    rules = {
        "id_form": ~F.coalesce(id_.rlike(ID), F.lit(False)),
        "id_type": F.substring_index(id_, "--", 1) != F.col("type"),
        "spec_version": ~F.coalesce(F.col("spec_version").isin("2.0", "2.1"), F.lit(False)),
        "modified_before_created": F.col("modified") < F.col("created"),
        "created_by_form": ref.isNotNull() & ~ref.rlike(ID),
        "created_by_type": ref.isNotNull() & ref.rlike(ID) & ~F.startswith(ref, F.lit("identity--")),
        "body_json": ~F.coalesce(F.get_json_object("body", "$").isNotNull(), F.lit(False)),
    }
    codes = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return objects.select("rec_no", F.explode(codes).alias("code"))


# -- collections ------------------------------------------------------------------------------------------
def collection_page(
    objects: DataFrame, ids: list[str] = (), types: list[str] = (), spec_versions: list[str] = (), version: str = "last",
    added_after: str | None = None, limit: int | None = None, cursor: tuple[str, str] | None = None,
) -> DataFrame:
    """A page of a collection of stored objects, as the public exchange protocol filters and pages them: by id, type,
    specification and object version (``first``, ``last``, ``all`` or a time), rows added after a time, in order of
    (``added_at``, ``id``). ``cursor`` is the last pair of the page before; all filters reach the scan."""
    out = objects
    for column, values in (("id", ids), ("type", types), ("spec_version", spec_versions)):
        if values:
            out = out.where(F.col(column).isin(list(values)))
    if added_after is not None:
        out = out.where(F.col("added_at") > F.lit(added_after).cast("timestamp"))
    if version in ("first", "last"):
        pick = F.max_by if version == "last" else F.min_by
        others = [c for c in out.columns if c != "id"]
        out = out.groupBy("id").agg(pick(F.struct(*others), F.struct("modified", "rec_no", "name", "added_at")).alias("v")).select("id", "v.*")
    elif version != "all":
        out = out.where(F.col("modified") == F.lit(version).cast("timestamp"))
    if cursor is not None:
        at = F.lit(cursor[0]).cast("timestamp")
        out = out.where((F.col("added_at") > at) | ((F.col("added_at") == at) & (F.col("id") > cursor[1])))
    out = out.orderBy("added_at", "id", "rec_no")
    return out.limit(limit) if limit is not None else out


def manifest(objects: DataFrame) -> DataFrame:
    """``id, versions, date_added``: the versions of each object, oldest first."""
    return objects.groupBy("id").agg(F.array_sort(F.collect_set("modified")).alias("versions"), F.min("added_at").alias("date_added"))
