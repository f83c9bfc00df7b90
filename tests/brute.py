"""Plain, single-threaded versions of the general operators, to test against."""

import datetime as dt
import json
import re
import zoneinfo
from collections import defaultdict
from decimal import Decimal

import duckdb

UTC = dt.UTC
EPOCH = dt.datetime(1970, 1, 1)
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def rows(sf, sql):
    con = duckdb.connect()
    return con.execute(sql.replace("{sf}", sf)).fetchall()


def us(naive):
    delta = naive - EPOCH
    return (delta.days * 86400 + delta.seconds) * 1_000_000 + delta.microseconds


def instant(text, zone):
    """(outcome, us) of a stored time text, or None where it is null or blank."""
    if text is None or not text.strip():
        return None
    s, zone = text.strip(), (zone or "").strip() or "UTC"
    if re.fullmatch(r"\d{9,16}(\.\d+)?", s):
        whole, _, frac = s.partition(".")
        frac = int((frac + "000000")[:6])
        n = int(whole)
        return ("instant", n * 10**6 + frac if len(whole) <= 11 else n * 1000 if len(whole) <= 14 else n)
    frac, off = "", ""
    try:
        if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))? ?([Zz]|[+-]\d\d:?\d\d|[A-Za-z]{2,5})?", s):
            *a, frac, off = m.groups()
        elif m := re.fullmatch(r"(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(Z)", s):
            *a, off = m.groups()
        elif m := re.fullmatch(r"(\d\d)/(\w{3})/(\d{4}):(\d\d):(\d\d):(\d\d) ([+-]\d{4})", s):
            d, mo, y, h, mi, sec, off = m.groups()
            a = [y, MONTHS.index(mo) + 1, d, h, mi, sec]
        elif m := re.fullmatch(r"\w{3}, (\d\d) (\w{3}) (\d{4}) (\d\d):(\d\d):(\d\d) ([+-]\d{4}|\w+)", s):
            d, mo, y, h, mi, sec, off = m.groups()
            a = [y, MONTHS.index(mo) + 1, d, h, mi, sec]
        elif m := re.fullmatch(r"\w{3} (\w{3}) +(\d+) (\d\d):(\d\d):(\d\d) (\d{4})", s):
            mo, d, h, mi, sec, y = m.groups()
            a = [y, MONTHS.index(mo) + 1, d, h, mi, sec]
        elif m := re.fullmatch(r"(\d\d)/(\d\d)/(\d{4}) (\d\d):(\d\d):(\d\d)(?: ([AP]M))?", s):
            p, q, y, h, mi, sec, half = m.groups()
            h = int(h) % 12 + 12 * (half == "PM") if half else h
            a = [y, q, p, h, mi, sec] if int(q) <= 12 else [y, p, q, h, mi, sec]
        else:
            return ("unreadable", 0)
        wall = dt.datetime(*map(int, a)) + dt.timedelta(microseconds=int(((frac or "") + "000000")[:6]))
    except ValueError:
        return ("unreadable", 0)
    off = (off or "").upper()
    if off in ("Z", "UTC", "GMT"):
        return ("instant", us(wall))
    if off[:1] in ("+", "-"):
        secs = int(off[1:3]) * 3600 + int(off[-2:]) * 60
        return ("instant", us(wall) - (secs if off[0] == "+" else -secs) * 10**6)
    z = zoneinfo.ZoneInfo(zone)
    fits = set()
    for fold in (0, 1):
        u = wall.replace(tzinfo=z, fold=fold).astimezone(UTC)
        back = u.astimezone(z)
        if back.replace(tzinfo=None) == wall and (not off or back.tzname() == off):
            fits.add(us(u.replace(tzinfo=None)))
    if not fits:
        return ("nonexistent", 0)
    return ("ambiguous", 0) if len(fits) > 1 else ("instant", fits.pop())


def canonical(text):
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", text):
        return False
    return instant(text, "UTC")[0] == "instant"


def records(body):
    try:
        value = json.loads(body)
    except (TypeError, ValueError):
        return []
    if isinstance(value, dict) and isinstance(value.get("records"), list):
        value = value["records"]
    return [r for r in (value if isinstance(value, list) else [value]) if isinstance(r, dict)]


def p5(sf):
    out = set()
    for table, sql in (("security_events", "event_id::varchar, time"), ("sightings", "id, first_seen")):
        for key, text, zone in rows(sf, f"select {sql}, tz_name from '{{sf}}/{table}.parquet'"):
            if text is not None and text.strip() and not canonical(text):
                out.add((table, key, *instant(text, zone)))
    for body, zone in rows(sf, "select body, tz_name from '{sf}/cloud_audit.parquet'"):
        for r in records(body):
            text = r.get("eventTime")
            text = None if text is None else f"{text:.3f}" if isinstance(text, float) else str(text)
            if text is not None and text.strip() and not canonical(text):
                out.add(("cloud_audit", r.get("id", r.get("eventID")), *instant(text, zone)))
    return out


def p2(sf, gap=1_800_000_000):
    once = {}
    for eid, text, zone, user, host in rows(sf, "select event_id, time, tz_name, actor_user_name, src_hostname from '{sf}/security_events.parquet'"):
        got = instant(text, zone)
        user, host = (user or "").strip().lower(), (host or "").strip().lower()
        who = ("user", user) if user not in ("", "-") else ("device", host)
        if got and got[0] == "instant" and who[1]:
            once[eid] = min(once.get(eid, (got[1], *who)), (got[1], *who))
    times = defaultdict(list)
    for t, kind, who in once.values():
        times[kind, who].append(t)
    out = set()
    for (kind, who), ts in times.items():
        ts.sort()
        start = prev = ts[0]
        n = 0
        for t in ts:
            if t - prev > gap:
                out.add((kind, who, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        out.add((kind, who, start, prev, n))
    return out


def p4(sf):
    spans = defaultdict(list)
    for kind, value, s, e in rows(sf, "select entity_type, entity_value, window_start, window_end from '{sf}/risk_incidents.parquet'"):
        value = (value or "").strip().lower()
        if not value or s is None or e is None:
            continue
        s, e = (x // 1000 if x > 10**12 else x for x in (s, e))
        if s <= e:
            spans[kind, value].append((s, e))
    out = set()
    for key, xs in spans.items():
        xs.sort()
        lo, hi = xs[0]
        for s, e in xs[1:]:
            if s <= hi:
                hi = max(hi, e)
            else:
                out |= {(*key, "period", lo, hi), (*key, "gap", hi, s)}
                lo, hi = s, e
        out.add((*key, "period", lo, hi))
    return out


def p1(sf):
    fields = {"stix_objects": ["created_by_ref"], "observed_data": ["created_by_ref", "object_refs"], "sightings": ["created_by_ref", "sighting_of_ref", "observed_data_refs"], "stix_reports": ["created_by_ref", "object_refs"]}
    clean = lambda x: (x or "").strip().lower()
    life = defaultdict(list)
    for t in [*fields, "identities"]:
        for i, a, d in rows(sf, f"select id, added_at, deleted_at from '{{sf}}/{t}.parquet'"):
            life[clean(i)].append((a, d))
    out = set()
    for t, names in fields.items():
        for i, at, *values in rows(sf, f"select id, added_at, {', '.join(names)} from '{{sf}}/{t}.parquet'"):
            for name, value in zip(names, values, strict=True):
                for ref in value if isinstance(value, list) else [value]:
                    ref = clean(ref)
                    if not ref:
                        continue
                    lives = life.get(ref, [])
                    if any(a <= at and (d is None or at < d) for a, d in lives):
                        continue
                    reason = "missing" if not lives else "late" if all(a > at for a, _ in lives) else "deleted"
                    out.add((t, i, name, ref, reason, at.strftime("%Y-%m")))
    return out


def p3(sf):
    def hits(value, names, ordinal=0, top=False):
        if isinstance(value, str) and not top and names:
            try:
                value = json.loads(value, parse_float=Decimal)
            except ValueError:
                return
        if isinstance(value, list):
            for k, x in enumerate(value):
                yield from hits(x, names, k)
        elif not names:
            if not isinstance(value, dict) and value is not None and str(value).strip():
                yield ordinal, str(value).strip()
        elif isinstance(value, dict):
            for n in range(1, len(names) + 1):
                if ".".join(names[:n]) in value:
                    yield from hits(value[".".join(names[:n])], names[n:], ordinal)

    out = set()
    for (body,) in rows(sf, "select body from '{sf}/cloud_audit.parquet'"):
        for r in records(body):
            for path in ("location.geolocation.lat", "properties.appDisplayName"):
                for ordinal, val in hits(r, path.split("."), top=True):
                    if path.endswith("lat"):
                        val = str(int((Decimal(val) * 10**6).to_integral_value()))
                    out.add(("cloud_audit", r.get("id", r.get("eventID")), path, ordinal, val))
    for key, body in rows(sf, "select rec_no, body from '{sf}/stix_objects.parquet'"):
        for ordinal, val in hits(json.loads(body) if body else None, ["external_references", "external_id"], top=True):
            out.add(("stix_objects", str(key), "external_references.external_id", ordinal, val))
    return out
