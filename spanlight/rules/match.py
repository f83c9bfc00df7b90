"""Matchers: one field, its modifiers and values, as a Column that is never null."""

from __future__ import annotations

import base64
import ipaddress
import itertools
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlight.rules.fields import Found, Resolver, number_of, text_of
from spanlight.rules.model import RuleError

OPERATORS = {"contains", "startswith", "endswith", "re", "cidr", "gt", "gte", "lt", "lte", "neq", "exists", "fieldref"}
PARTS = {"minute": F.minute, "hour": F.hour, "day": F.dayofmonth, "week": F.weekofyear, "month": F.month, "year": F.year}
MODIFIERS = OPERATORS | set(PARTS) | {"all", "cased", "i", "m", "s", "ignorecase", "multiline", "dotall", "base64", "base64offset", "wide", "utf16le", "utf16be", "utf16", "windash", "expand"}
EPSILON = 2.220446049250313e-16
DASHES = "-/–—―"  # fixed values: what windash exchanges
MAX_DASHES = 8  # values with more are not written out


def check_modifiers(modifiers: list[str]) -> None:
    """At most one operator and one utf16 form; base64 or base64offset; regex flags need ``re``."""
    unknown = [m for m in modifiers if m not in MODIFIERS]
    if unknown:
        raise RuleError(f"unknown modifier {unknown[0]!r}")
    if len([m for m in modifiers if m in OPERATORS or m in PARTS]) > 1 and not ("neq" in modifiers and len([m for m in modifiers if m in OPERATORS]) == 2):
        raise RuleError(f"conflicting operators: {modifiers}")
    if len([m for m in modifiers if m in ("wide", "utf16le", "utf16be", "utf16")]) > 1:
        raise RuleError("more than one utf16 form")
    if "base64" in modifiers and "base64offset" in modifiers:
        raise RuleError("base64 and base64offset exclude each other")
    if any(m in modifiers for m in ("i", "m", "s", "ignorecase", "multiline", "dotall")) and "re" not in modifiers:
        raise RuleError("regex flags need re")


# -- values -----------------------------------------------------------------------------------------------
def tokens(text: str) -> list[str | int]:
    """A value's plain pieces and wildcards (0 = ``*``, 1 = ``?``); a backslash takes the meaning from ``* ? \\``."""
    out: list[str | int] = []
    plain, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in "*?\\":
            plain += text[i + 1]
            i += 2
            continue
        if c in "*?":
            if plain:
                out.append(plain)
            plain = ""
            out.append(0 if c == "*" else 1)
        else:
            plain += c
        i += 1
    return [*out, plain] if plain or not out else out


def wildcard_regex(parts: list[str | int], cased: bool, left: bool = True, right: bool = True) -> str:
    body = "".join(".*" if p == 0 else "." if p == 1 else java_quote(p) for p in parts)
    return f"(?{'sd' if cased else 'iusd'})" + ("^" if left else "") + body + (r"\z" if right else "")


def java_quote(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}&\-#~])", r"\\\1", text)


def _wide(text: bytes | str, modifiers: list[str]) -> bytes:
    if "utf16be" in modifiers:
        return text.encode("utf-16-be")
    if "utf16" in modifiers:
        return b"\xff\xfe" + text.encode("utf-16-le")
    if "wide" in modifiers or "utf16le" in modifiers:
        return text.encode("utf-16-le")
    return text.encode()


def base64_offsets(data: bytes) -> list[str]:
    """The encodings of ``data`` at the three alignments, without what neighbouring bytes decide at the start."""
    out = []
    for pad in range(3):
        encoded = base64.b64encode(b" " * pad + data).decode().rstrip("=")
        out.append(encoded[(0, 2, 3)[pad]:])
    return out


def dash_places(text: str) -> list[int]:
    return [i for i, c in enumerate(text) if c in "-/" and (i == 0 or text[i - 1].isspace())]


def dash_variants(text: str) -> list[str]:
    places = dash_places(text)
    if len(places) > MAX_DASHES:
        raise RuleError(f"windash: {len(places)} dashes cannot be written out")
    out = []
    for choice in itertools.product(DASHES, repeat=len(places)):
        chars = list(text)
        for place, c in zip(places, choice, strict=True):
            chars[place] = c
        out.append("".join(chars))
    return list(dict.fromkeys([text, *out]))


def in_network(text: Column, network: str) -> Column:
    """Whether an address text lies in a network; unreadable texts do not. IPv4 is arithmetic on the text;
    IPv6 addresses are written out to eight groups first."""
    net = ipaddress.ip_network(network, strict=False)
    if net.version == 4:
        octets = F.split(text, r"\.")
        well = text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z")
        number = reduce(lambda a, b: a * 256 + b, [F.try_element_at(octets, F.lit(i)).try_cast("bigint") for i in (1, 2, 3, 4)])
        return F.when(well, number.between(int(net.network_address), int(net.broadcast_address))).otherwise(False)
    hexed = hex_address(text, 6)
    first, last = f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"
    return F.coalesce(hexed.between(first, last), F.lit(False))


def hex_address(text: Column, version: int) -> Column:
    """An address as 8 or 32 hex digits; null if the text is no address of that version. The last two groups of an IPv6
    address may be written as an IPv4 address."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    four = rf"{octet}(?:\.{octet}){{3}}"
    pair = lambda t: F.array_join(F.transform(F.split(t, r"\."), lambda x: F.lpad(F.lower(F.hex(x.try_cast("bigint"))), 2, "0")), "")
    if version == 4:
        return F.when(text.rlike(rf"^{four}\z"), pair(text))
    low = F.lower(text)
    embedded = F.nullif(F.regexp_extract(low, rf":({four})\z", 1), F.lit(""))
    written = F.when(embedded.isNotNull(), F.concat(F.regexp_replace(low, r"[^:]*\z", ""), F.substring(pair(embedded), 1, 4), F.lit(":"), F.substring(pair(embedded), 5, 4))).otherwise(low)
    short = F.instr(written, "::") > 0
    clean = lambda a: F.filter(a, lambda x: x != "")
    head = clean(F.split(F.substring_index(written, "::", 1), ":"))
    tail = clean(F.when(short, F.split(F.substring_index(written, "::", -1), ":")).otherwise(F.array().cast("array<string>")))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0)))
    groups = F.when(short, F.concat(head, zeros, tail)).otherwise(head)
    hexed = F.array_join(F.transform(groups, lambda x: F.lpad(x, 4, "0")), "")
    well = written.rlike(r"^(?:[0-9a-f]{0,4}:){1,8}[0-9a-f]{0,4}\z") & ~written.rlike(r":::|::.*::|^:[^:]|[^:]:\z") & (F.size(groups) == 8) & (F.length(hexed) == 32)
    return F.when(well, hexed)


# -- matching ---------------------------------------------------------------------------------------------
def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _text_match(op: str, value: str, cased: bool):
    """text Column -> bool Column for one wildcard value."""
    parts = tokens(value)
    plain = parts[0] if len(parts) == 1 and isinstance(parts[0], str) else None
    if op == "contains":
        parts = [p for i, p in enumerate(parts) if p != 0 or 0 < i < len(parts) - 1]
    elif op == "startswith" and parts and parts[-1] == 0:
        parts = parts[:-1]
    elif op == "endswith" and parts and parts[0] == 0:
        parts = parts[1:]
    # `*x*`, `x*` and `*x` need no regular expression
    if op == "exact" and len(parts) > 1 and all(isinstance(p, str) or i in (0, len(parts) - 1) for i, p in enumerate(parts)) and 1 not in parts and sum(isinstance(p, str) for p in parts) == 1:
        left, right = parts[0] != 0, parts[-1] != 0
        plain = next(p for p in parts if isinstance(p, str))
        op = "startswith" if left else "endswith" if right else "contains"
    elif len(parts) == 1 and isinstance(parts[0], str):
        plain = parts[0]
    elif not parts or parts == [0]:
        return lambda text: text.isNotNull()
    if plain is not None:
        needle = plain if cased else plain.lower()
        fold = (lambda t: t) if cased else F.lower
        function = {"exact": lambda t: t == needle, "contains": lambda t: F.contains(t, F.lit(needle)), "startswith": lambda t: F.startswith(t, F.lit(needle)), "endswith": lambda t: F.endswith(t, F.lit(needle))}[op]
        return lambda text: function(fold(text))
    expression = wildcard_regex(parts, cased, op in ("exact", "startswith"), op in ("exact", "endswith"))
    return lambda text: text.rlike(expression)


def java_regex(pattern: str, modifiers: list[str]) -> str:
    """The pattern in Java's dialect: Unicode case folding and classes, ``.`` stops at line feeds only, ``$`` is the very end.

    Flags in the pattern hold from where they stand, as they are written; only their case folding is made Unicode's.
    """
    lines = bool({"m", "multiline"} & set(modifiers)) or re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    out, i, in_class, unicode_class = [], 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            unicode_class = unicode_class or pattern[i + 1] in "dDwWsSbB"
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            in_class += (c == "[") - (c == "]")
        elif c == "[":
            in_class = 1
            following = re.match(r"\[\^?\]?", pattern[i:])[0]  # a bracket that comes first is itself
            out.append(following.replace("]", "\\]"))
            i += len(following)
            continue
        elif c == "$" and not lines:
            c = r"\z"
        elif flags := re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])", pattern[i:]):
            on = flags[1].replace("i", "iu") if "u" not in flags[1] else flags[1]
            out.append(f"(?{on}{flags[2] or ''}{flags[3]}")
            i += len(flags[0])
            continue
        out.append(c)
        i += 1
    flags = "d" + ("iu" if {"i", "ignorecase"} & set(modifiers) else "") + ("m" if {"m", "multiline"} & set(modifiers) else "") + ("s" if {"s", "dotall"} & set(modifiers) else "") + ("U" if unicode_class else "")
    return f"(?{flags})" + "".join(out)


def _timestamp(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    number = number_of(value, kind)
    stamp = F.when(F.abs(number) > 1e12, F.timestamp_micros((number * 1000).cast("bigint"))).otherwise(F.timestamp_micros((number * 1_000_000).cast("bigint")))
    return F.coalesce(stamp, value.try_cast("timestamp")) if isinstance(kind, T.StringType) else stamp


def value_matcher(value, modifiers: list[str], resolver: Resolver):
    """(value Column, type) -> bool Column for one rule value."""
    op = next((m for m in modifiers if m in OPERATORS and m != "neq"), None) or next((m for m in modifiers if m in PARTS), "exact")
    cased = "cased" in modifiers
    if op in PARTS:
        number = float(value)
        return lambda v, kind: F.abs(PARTS[op](_timestamp(v, kind)).cast("double") - number) < EPSILON
    if op in ("gt", "gte", "lt", "lte"):
        number = float(value)
        compare = {"gt": lambda x: x > number, "gte": lambda x: x >= number, "lt": lambda x: x < number, "lte": lambda x: x <= number}[op]
        return lambda v, kind: compare(number_of(v, kind))
    if op == "cidr":
        return lambda v, kind: in_network(text_of(v, kind), str(value))
    if op == "re":
        expression = java_regex(str(value), modifiers)
        return lambda v, kind: text_of(v, kind).rlike(expression)
    if op == "fieldref":
        other = resolver.find(str(value))
        if other is None:
            return lambda v, kind: F.lit(False)
        fold = (lambda t: t) if cased else F.lower
        if other.many:
            return lambda v, kind: F.exists(other.column, lambda y: fold(text_of(v, kind)) == fold(text_of(y, other.type)))
        return lambda v, kind: fold(text_of(v, kind)) == fold(text_of(other.column, other.type))
    if value is None:
        return lambda v, kind: v.isNull()
    if isinstance(value, bool):
        words = ["true", "1", "yes"] if value else ["false", "0", "no"]
        return lambda v, kind: F.lower(text_of(v, kind)).isin(words)
    if "expand" in modifiers:
        pieces = re.split(r"%([^%\s]+)%", str(value))
        built = F.concat(*[F.lit(p) if i % 2 == 0 else _field_text(resolver, p) for i, p in enumerate(pieces) if p or i % 2])
        fold = (lambda t: t) if cased else F.lower
        how = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}.get(op)
        return lambda v, kind: how(fold(text_of(v, kind)), fold(built)) if how else fold(text_of(v, kind)) == fold(built)
    if isinstance(value, (int, float)) and op == "exact" and not {"base64", "base64offset"} & set(modifiers):
        number = float(value)
        return lambda v, kind: F.abs(number_of(v, kind) - number) < EPSILON
    texts = [str(value)]
    places = dash_places(texts[0]) if "windash" in modifiers and not {"base64", "base64offset"} & set(modifiers) else []
    if len(places) > MAX_DASHES:
        marked = "".join("\ufdd0" if i in places else c for i, c in enumerate(texts[0]))
        expression = wildcard_regex(tokens(marked), cased, op in ("exact", "startswith"), op in ("exact", "endswith")).replace("\ufdd0", f"[{DASHES}]")
        return lambda v, kind: text_of(v, kind).rlike(expression)
    if "windash" in modifiers:
        texts = [v for t in texts for v in dash_variants(t)]
    if "base64" in modifiers:
        texts = [base64.b64encode(_wide(t, modifiers)).decode() for t in texts]
        cased = cased or op == "exact"
    if "base64offset" in modifiers:
        texts = [e for t in texts for e in base64_offsets(_wide(t, modifiers))]
        op = "contains"
    matchers = [_text_match(op, t, cased) for t in texts]
    return lambda v, kind: any_of([m(text_of(v, kind)) for m in matchers])


def _field_text(resolver: Resolver, name: str) -> Column:
    found = resolver.find(name)
    return F.lit("") if found is None or found.many else F.coalesce(text_of(found.column, found.type), F.lit(""))


def match_field(resolver: Resolver, name: str, modifiers: list[str], values: list) -> Column:
    """One detection item. An absent field matches ``null`` and ``exists: false`` only."""
    check_modifiers(modifiers)
    found = resolver.find(name)
    if "exists" in modifiers:
        present = F.lit(False) if found is None else found.column.isNotNull()
        wanted = values[0] if isinstance(values[0], bool) else str(values[0]).lower() in ("true", "yes", "1")
        return present if wanted else ~present
    if "all" in modifiers and len(values) < 2:
        raise RuleError("`all` needs more than one value")
    if found is None:
        return F.lit(any(v is None for v in values) and "neq" not in modifiers)
    plain = [m for m in modifiers if m not in ("all",)]
    quick = _fast_list(found, plain, values)
    if quick is not None and "all" not in modifiers:
        test = quick
    else:
        matchers = [value_matcher(v, plain, resolver) for v in values]
        one = lambda v, kind: (all_of if "all" in modifiers else any_of)([F.coalesce(m(v, kind), F.lit(False)) for m in matchers])
        if found.many:
            singles = [F.coalesce(_exists(found, m), F.lit(False)) for m in matchers]
            test = (all_of if "all" in modifiers else any_of)(singles)
            if any(v is None for v in values):
                test = test | found.column.isNull()
        else:
            test = one(found.column, found.type)
    if "neq" in modifiers:
        return found.column.isNotNull() & ~F.coalesce(test, F.lit(False))
    return F.coalesce(test, F.lit(False))


def _exists(found: Found, matcher) -> Column:
    return F.exists(found.column, lambda x: F.coalesce(matcher(x, found.type), F.lit(False)))


def _fast_list(found: Found, modifiers: list[str], values: list) -> Column | None:
    """A list of plain texts as one set membership, or as one alternation for long lists of substrings."""
    if found.many or not values or not all(isinstance(v, str) for v in values) or len(values) < 2:
        return None
    parts = [tokens(v) for v in values]
    if not all(len(p) == 1 and isinstance(p[0], str) for p in parts):
        return None
    text, cased = text_of(found.column, found.type), "cased" in modifiers
    rest = [m for m in modifiers if m not in ("cased", "neq")]
    if not rest:
        return (text if cased else F.lower(text)).isin([p[0] if cased else p[0].lower() for p in parts])
    if rest == ["contains"] and len(values) >= 8:
        return text.rlike(f"(?{'d' if cased else 'iud'})(?:" + "|".join(java_quote(p[0]) for p in parts) + ")")
    return None


def match_keywords(leaves: Column, words: list, every: bool = False) -> Column:
    """Whether any text value of the event holds the words (any of them, or all)."""
    tests = []
    for word in words:
        m = _text_match("contains", str(word), False)
        tests.append(_leaf_exists(leaves, m))
    return F.coalesce((all_of if every else any_of)(tests), F.lit(False))


def _leaf_exists(leaves: Column, matcher) -> Column:
    return F.exists(leaves, lambda x: F.coalesce(matcher(x), F.lit(False)))
