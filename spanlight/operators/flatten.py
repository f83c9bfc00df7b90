"""Deeply nested semi-structured records, turned into related flat tables.

1. :func:`parse_triples` stream-parses each text into *path-value-ordinal* triples, one row per leaf.
2. :func:`repeated_ancestor` groups paths by their innermost repeated ancestor (the array they lie in).
3. :func:`pivot_group` pivots one such group into one table whose rows keep their parent record and position;
   :func:`pivot_groups` does so for all groups at once.

Parsing is the one step that Catalyst cannot express for records whose shape is not known beforehand (objects
given as text, dotted keys, arrays where an object is usual); it runs in Arrow batches, narrow, without shuffle. The
parser goes from token to token with a stack of its own: no tree of a record is built, and nesting has no bound.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.session import ship_package

TRIPLES = "source_key string, record_no int, record_id string, path string, ordinal long, position string, occurrence int, val string, kind string"

_TOKEN = re.compile(r'[ \t\r\n]*(?:(")|([{}\[\],:])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|-?Infinity|NaN)|(true|false|null))').match
_SPACE = " \t\r\n"
_MAX_KNOWN = 10_000  # paths that are remembered as wanted or not

Leaf = tuple[str, tuple[int, ...], "str | None", str]


class Wanted:
    """Which subtrees are read: those on the way to one of ``paths``, through arrays and dotted keys; None = all."""

    def __init__(self, paths: list[str] | None):
        self.paths = paths
        self.known: dict[str, bool] = {}

    def leads(self, keys: list[str]) -> bool:
        plain = ".".join(keys)
        found = self.known.get(plain)
        if found is None:
            if len(self.known) > _MAX_KNOWN:
                self.known.clear()
            found = self.known[plain] = any(p == plain or p.startswith(plain + ".") for p in self.paths)
        return found


def read_value(text: str, at: int, wanted: Wanted, out: list[Leaf | None], parts: list[str] | None = None, keys: list[str] | None = None, idx: list[int] | None = None) -> int:
    """Read one JSON value from ``at`` on, append its leaves to ``out`` and give the place after it.

    A leaf is its path (arrays marked ``[]``), its array indices, value and kind; leaves that a repeated key replaces
    become None. Raises ValueError where the text breaks off or is no JSON. A text in it that is an object or array
    itself counts as that.
    """
    parts, keys, idx = parts if parts is not None else [], keys if keys is not None else [], idx if idx is not None else []
    top = bool(parts)
    # of each open object or array: is it an object, the spans of its keys' leaves, where the present key's leaves begin
    stack: list[list] = []
    skip = 0  # the depth of the stack at which an unwanted value began; 0 = none
    choose = wanted.paths is not None
    while True:
        m = _TOKEN(text, at)
        if m is None:
            raise ValueError(f"no value at {at}")
        kind, at = m.lastindex, m.end()
        opened = False
        if kind == 1:
            value, at = scanstring(text, at, False)
            if not skip and not (value[:1] in "{[ \t\r\n" and (stack or top) and _embedded(value, wanted, out, parts, keys, idx)):
                out.append(("".join(parts), tuple(idx), value, "string"))
        elif kind == 3:
            if not skip:
                out.append(("".join(parts), tuple(idx), m.group(3), "number"))
        elif kind == 4:
            if not skip:
                word = m.group(4)
                out.append(("".join(parts), tuple(idx), None if word == "null" else word, "null" if word == "null" else "boolean"))
        else:
            opened = True
            mark = m.group(2)
            follows = _TOKEN(text, at)
            if follows is None:
                raise ValueError(f"cut off at {at}")
            if mark == "{":
                if follows.group(2) == "}":
                    at, opened = follows.end(), False
                    if not skip:
                        out.append(("".join(parts), tuple(idx), None, "empty object"))
                elif follows.lastindex == 1:
                    stack.append([True, {}, len(out)])
                else:
                    raise ValueError(f"no key at {at}")
            elif mark == "[":
                if follows.group(2) == "]":
                    at, opened = follows.end(), False
                    if not skip:
                        out.append(("".join(parts) + "[]", tuple(idx), None, "empty array"))
                else:
                    stack.append([False, None, 0])
                    if not skip:
                        parts.append("[]")
                        idx.append(0)
                    continue
            else:
                raise ValueError(f"unexpected {mark} at {at}")
        while True:  # what comes after a value, or the first key of an object
            if not stack:
                return at
            frame = stack[-1]
            if not opened:
                if skip == len(stack):
                    skip = 0
                elif not skip and frame[0]:
                    parts.pop()
                    keys.pop()
                m = _TOKEN(text, at)
                mark = m.group(2) if m is not None else None
                if mark is None:
                    raise ValueError(f"cut off at {at}")
                at = m.end()
                if frame[0]:
                    frame[1][frame[3]] = (frame[2], len(out))
                if mark == ("}" if frame[0] else "]"):
                    stack.pop()
                    if not frame[0] and not skip:
                        parts.pop()
                        idx.pop()
                    continue
                if mark != ",":
                    raise ValueError(f"unexpected {mark} at {at}")
                if not frame[0]:
                    if not skip:
                        idx[-1] += 1
                    break
            opened = False
            m = _TOKEN(text, at)
            if m is None or m.lastindex != 1:
                raise ValueError(f"no key at {at}")
            key, at = scanstring(text, m.end(), False)
            m = _TOKEN(text, at)
            if m is None or m.group(2) != ":":
                raise ValueError(f"no colon at {at}")
            at = m.end()
            del frame[3:]
            frame.append(key)
            frame[2] = len(out)
            if not skip:
                before = frame[1].get(key)
                if before:  # the last of equal keys counts
                    out[before[0] : before[1]] = [None] * (before[1] - before[0])
                keys.append(key)
                if choose and not wanted.leads(keys):
                    keys.pop()
                    skip = len(stack)
                else:
                    parts.append("." + key if parts else key)
            break


def _embedded(value: str, wanted: Wanted, out: list, parts: list[str], keys: list[str], idx: list[int]) -> bool:
    """Read an object or array given as text, if it wholly is one. Each such level at least doubles the escapes around
    it, so these calls cannot go deep."""
    inner = value.strip(_SPACE)
    if inner[:1] not in ("{", "["):
        return False
    found: list = []
    try:
        end = read_value(inner, 0, wanted, found, list(parts), list(keys), list(idx))
    except ValueError:
        return False
    if end != len(inner):
        return False
    out.extend(found)
    return True


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] in _SPACE:
        at += 1
    return at


def _elements(text: str, at: int, wanted: Wanted, records: list[list]) -> int:
    """Read the elements of an array, from behind its bracket on, as records; the complete ones are kept also where
    ValueError is raised."""
    at = _skip(text, at)
    if text[at : at + 1] == "]":
        return at + 1
    while True:
        leaves: list = []
        at = _skip(text, read_value(text, at, wanted, leaves))
        records.append(leaves)
        if text[at : at + 1] == "]":
            return at + 1
        if text[at : at + 1] != ",":
            raise ValueError(f"cut off at {at}")
        at += 1


def _unwrap(leaves: list, wrapper: str) -> list[list] | None:
    """The records of an object whose only purpose is the array ``wrapper``; None if it is no such object."""
    if any(x is not None and x[0] == "id" for x in leaves):
        return None
    mine = [x for x in leaves if x is not None and x[1] and x[0].startswith(wrapper + "[]")]
    if not mine:
        return [] if any(x is not None and x[0] == wrapper + "[]" for x in leaves) else None
    out: dict[int, list] = {}
    for path, indices, value, kind in mine:
        rest = path[len(wrapper) + 2 :]
        out.setdefault(indices[0], []).append((rest[1:] if rest[:1] == "." else rest, indices[1:], value, kind))
    return list(out.values())


def read_records(text: str | None, wrapper: str | None = "records", wanted: Wanted | None = None) -> tuple[list[list[Leaf | None]], bool]:
    """The leaves of each record of one stored text, and whether all of it could be read.

    A text holds one record, an array of records, an object whose only purpose is the array ``wrapper``, or
    several of these one after another. Of a broken text the records that are complete are kept.
    """
    records: list[list] = []
    if text is None:
        return records, True
    wanted = wanted or Wanted(None)
    wrapped = wrapper and json.dumps(wrapper) in text
    at = _skip(text, 1 if text[:1] == "\ufeff" else 0)
    while at < len(text):
        try:
            if text[at] == "[":
                at = _elements(text, at + 1, wanted, records)
            else:
                leaves: list = []
                end = read_value(text, at, Wanted(None) if wrapped else wanted, leaves)
                inner = _unwrap(leaves, wrapper) if wrapped and text[at] == "{" else None
                records.extend([leaves] if inner is None else inner)
                at = end
        except ValueError:
            head = re.compile(r'\{\s*"%s"\s*:\s*\[' % re.escape(wrapper)).match(text, at) if wrapped else None
            if head:  # cut off inside the wrapper
                try:
                    _elements(text, head.end(), wanted, records)
                except ValueError:
                    pass
            return records, False
        at = _skip(text, at)
        if at < len(text) and text[at] == ",":
            at = _skip(text, at + 1)
    return records, True


def parse_triples(
    df: DataFrame,
    key: str,
    body: str,
    paths: list[str] | None = None,
    id_fields: tuple[str, ...] = ("id", "eventID"),
    wrapper: str | None = "records",
) -> DataFrame:
    """One row per leaf of every record in ``body``; with ``paths``, only the leaves there (pruned while parsing).

    Result: ``source_key`` (the row's ``key`` as text), ``record_no`` (place of the record in the text),
    ``record_id`` (the first of ``id_fields`` at the record's top, trimmed), ``path`` (arrays marked ``[]``), ``ordinal``
    (place in the innermost array, from 0 and counting nulls; 0 without array), ``position`` (all array indices,
    dotted), ``occurrence`` (0; 1, 2, ... where a record has the same path and position again, by nested and dotted keys),
    ``val``, ``kind``. Of a key given twice in one object the last counts. Null bodies have no rows. A text that cannot be
    read to its end gives its complete records and one row of kind ``broken`` (not with ``paths``). Values that are no
    objects give one leaf with an empty path (not with ``paths``). ``paths`` leave arrays and dotted keys unmarked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted([*paths, *id_fields] if paths is not None else None)
        asked = set(paths or ())
        for batch in batches:
            rows: list[tuple] = []
            for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records, whole = read_records(text, wrapper, wanted)
                for number, leaves in enumerate(records):
                    top = {x[0]: x[2] for x in leaves if x is not None and not x[1] and x[2] is not None and x[0] in id_fields}
                    own = next((top[f].strip() for f in id_fields if f in top), None)
                    seen: dict[tuple, int] = {}
                    for leaf in leaves:
                        if leaf is None:
                            continue
                        path, indices, val, kind = leaf
                        if paths is not None and (path.replace("[]", "") not in asked or kind.startswith("empty")):
                            continue
                        again = seen[path, indices] = seen.get((path, indices), -1) + 1
                        rows.append((source, number, own, path, indices[-1] if indices else 0, ".".join(map(str, indices)), again, val, kind))
                if not whole and paths is None:
                    rows.append((source, len(records), None, "", 0, "", 0, None, "broken"))
            cols = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES.values(), strict=True)], names=list(_TYPES))

    ship_package(df.sparkSession)
    slim = df.select(df[key].cast("string").alias("key"), df[body].cast("string").alias("body")).where(F.col("body").isNotNull())
    return slim.mapInArrow(run, TRIPLES)


_TYPES = {
    "source_key": pa.string(), "record_no": pa.int32(), "record_id": pa.string(), "path": pa.string(), "ordinal": pa.int64(),
    "position": pa.string(), "occurrence": pa.int32(), "val": pa.string(), "kind": pa.string(),
}


def repeated_ancestor(path: Column) -> Column:
    """The innermost array that a path lies in; '' for paths outside any array."""
    return F.when(F.instr(path, "[]") > 0, F.regexp_extract(path, r"^(.*\[\])", 1)).otherwise("")


def group_sizes(triples: DataFrame) -> DataFrame:
    """The groups (tables-to-be) of a set of triples: ancestor, leaf, rows, records. Aggregated map-side first."""
    grouped = triples.where(F.col("kind") != "broken").withColumn("ancestor", repeated_ancestor(F.col("path")))
    leaf = F.regexp_replace(F.expr("substring(path, length(ancestor) + 1)"), r"^\.", "")
    return grouped.withColumn("leaf", leaf).groupBy("ancestor", "leaf").agg(F.count("*").alias("n_values"), F.count("val").alias("n_present"))


def _shapes(ancestor: str) -> dict[str, tuple[bool, ...]]:
    """The paths at which members of ``ancestor`` lie where single objects stand in place of some of its arrays, and which
    of the arrays are there; ``ancestor`` itself is first."""
    parts = ancestor.split("[]")[:-1]
    return {"".join(p + "[]" * k for p, k in zip(parts, kept, strict=True)): kept for kept in reversed(list(itertools.product([False, True], repeat=len(parts))))}


def pivot_group(triples: DataFrame, ancestor: str, leaves: list[str]) -> DataFrame:
    """One flat table: the members of the array ``ancestor`` ('' = the records themselves) as rows.

    Columns: ``source_key, record_no, record_id, position, occurrence, parent_position, ordinal`` and one per leaf (dots
    become underscores). ``parent_position`` is the position of the enclosing member, so that tables of inner
    arrays join their parents on ``source_key, record_no, parent_position = position``. A leaf given twice
    in one member (as a nested and as a dotted key) is a further row of it, ``occurrence`` 1 and so on. One object where an
    array is usual is its member at place 0; it is a row of its own also where the record has that array too.
    """
    shapes = _shapes(ancestor)
    names = lambda at: [f"{at}.{x}" if at and x else at or x for x in leaves]
    path, shape, place, ordinal = F.col("path"), F.lit(None).cast("int"), F.col("position"), F.col("ordinal")
    for number, (at, kept) in enumerate(shapes.items()):
        array = at[: at.rindex("[]") + 2] if "[]" in at else ""
        here = (repeated_ancestor(path) == array) & path.isin(names(at))
        if not all(kept):
            here = here & ~((path == at) & (F.col("kind") == "null"))  # a null is no member
            index = iter(range(1, len(kept) + 1))
            parts = [F.try_element_at(F.split("position", r"\."), F.lit(next(index))) if k else F.lit("0") for k in kept]
            place = F.when(F.col("__shape") == number, F.concat_ws(".", *parts)).otherwise(place)
            ordinal = ordinal if kept[-1] else F.when(F.col("__shape") == number, F.lit(0).cast("long")).otherwise(ordinal)
        shape = F.when(here, number).otherwise(shape)
    wanted = triples.where(F.col("kind") != "broken").withColumn("__shape", shape).where(F.col("__shape").isNotNull()).withColumns({"position": place, "ordinal": ordinal})
    columns = [F.max(F.when(path.isin(list(same)), F.col("val"))).alias(x.replace(".", "_") or "value") for x, same in zip(leaves, zip(*map(names, shapes), strict=True), strict=True)]
    parent = F.when(F.instr("position", ".") > 0, F.regexp_replace("position", r"\.\d+$", "")).otherwise("")
    return (
        wanted.groupBy("source_key", "record_no", "position", "occurrence", "__shape")
        .agg(F.max("record_id").alias("record_id"), F.max("ordinal").alias("ordinal"), *columns)
        .drop("__shape")
        .withColumn("parent_position", parent)
    )


def pivot_groups(triples: DataFrame, leaves: list[str]) -> DataFrame:
    """All groups of a set of triples, pivoted in one pass: a row per record, repeated ancestor and member.

    Columns: ``source_key, record_no, record_id, ancestor, position, occurrence, ordinal`` and one per leaf, named ``leaf0``,
    ``leaf1``, ... in the order of ``leaves``, which are whole paths without array marks. The table of one group is where
    ``ancestor`` is its array ('' = the records themselves), whatever arrays the data have on the way.
    """
    wanted = triples.where(F.col("kind") != "broken").withColumns({"ancestor": repeated_ancestor(F.col("path")), "__plain": F.regexp_replace("path", r"\[\]", "")})
    columns = [F.max(F.when(F.col("__plain") == x, F.col("val"))).alias(f"leaf{i}") for i, x in enumerate(leaves)]
    return wanted.where(F.col("__plain").isin(leaves)).groupBy("source_key", "record_no", "ancestor", "position", "occurrence").agg(F.max("record_id").alias("record_id"), F.max("ordinal").alias("ordinal"), *columns)
