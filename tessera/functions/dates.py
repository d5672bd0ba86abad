"""Dates of requests, worked out on the driver: literals as windows, date math, zones and calendar fences. Instants are epoch milliseconds."""

from __future__ import annotations

import calendar
import re
from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from ..plans.errors import RequestError

UNITS = {"y": "year", "M": "month", "w": "week", "d": "day", "h": "hour", "H": "hour", "m": "minute", "s": "second"}
NAMES = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "milli")
_LITERAL = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[T ](\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?)?(Z|[+-]\d\d:?\d\d)?)?)?)?$")


def zone(name: str | None):
    if not name or name in ("UTC", "Z"):
        return UTC
    if fixed := re.fullmatch(r"([+-])(\d\d):?(\d\d)", name):
        return timezone((1 if fixed[1] == "+" else -1) * timedelta(hours=int(fixed[2]), minutes=int(fixed[3])))
    try:
        return ZoneInfo(name)
    except Exception:
        raise RequestError("bad_time_zone", f"no time zone {name}") from None


def instant(local: datetime, tz) -> int:
    """A local time's instant: the earlier of two, and for a skipped time the instant after the gap that is as far on."""
    return round(local.replace(tzinfo=tz, fold=0).astimezone(UTC).timestamp() * 1000)


def moved(local: datetime, n: int, unit: str) -> datetime:
    """`n` units on, from the same start: the last day of a month stays within its month."""
    if unit in ("year", "quarter", "month"):
        months = local.year * 12 + local.month - 1 + n * {"year": 12, "quarter": 3, "month": 1}[unit]
        year, month = divmod(months, 12)
        return local.replace(year=year, month=month + 1, day=min(local.day, calendar.monthrange(year, month + 1)[1]))
    return local + timedelta(**{unit + "s": n}) if unit != "milli" else local + timedelta(milliseconds=n)


def floored(local: datetime, unit: str) -> datetime:
    if unit == "week":
        local = local - timedelta(days=local.weekday())
    if unit == "quarter":
        local = local.replace(month=(local.month - 1) // 3 * 3 + 1)
    parts = {"month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0, "microsecond": 0}
    keep = {"year": (), "quarter": ("month",), "month": ("month",), "week": ("month", "day"), "day": ("month", "day"), "hour": ("month", "day", "hour"), "minute": ("month", "day", "hour", "minute"), "second": ("month", "day", "hour", "minute", "second")}.get(unit)
    if keep is None:
        return local.replace(microsecond=local.microsecond // 1000 * 1000)
    return local.replace(**{k: v for k, v in parts.items() if k not in keep})


def window(text: str | int | float, now: int, tz_name: str | None = None) -> tuple[int, int]:
    """First and last millisecond that a literal names: `2024-06` is all of June; math names one instant, rounding a granule."""
    if isinstance(text, (int, float)):
        return int(text), int(text)
    tz, text = zone(tz_name), text.strip()
    if re.fullmatch(r"-?\d{5,}", text):
        return int(text), int(text)
    base, ops = _split(text)
    if base == "NOW":
        low, high = datetime.fromtimestamp(now / 1000, tz).replace(tzinfo=None), None
    else:
        found = _LITERAL.match(base)
        if not found:
            raise RequestError("bad_date", f"not a date: {text}")
        year, month, day, hour, minute, second, part, offset = found.groups()
        tz = zone(offset) if offset else tz
        try:
            low = datetime(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), int((part or "0").ljust(6, "0")[:6]))
        except ValueError as e:
            raise RequestError("bad_date", f"{text}: {e}") from None
        unit = "milli" if part else "second" if second else "minute" if minute else "hour" if hour else "day" if day else "month" if month else "year"
        high = None if ops else moved(low, 1, unit)
    for sign, n, unit in ops:
        if sign == "/":
            low = floored(low, unit)
            high = moved(low, 1, unit)
        else:
            low, high = moved(low, n if sign == "+" else -n, unit), None
    first = instant(low, tz)
    return first, first if high is None else max(first, instant(high, tz) - 1)


def _split(text: str) -> tuple[str, list[tuple[str, int, str]]]:
    """A base and its steps, in either spelling: NOW/DAY-30DAYS or now-30d/d, with || between a literal and its math."""
    if re.match(r"(?i)now", text):
        base, rest = "NOW", text[3:]
    elif "||" in text:
        base, _, rest = text.partition("||")
    else:
        m = re.match(r"[0-9T:.\-]+?Z?(?=[/+]|-\d+[A-Za-z]|$)", text)
        base, rest = (m[0], text[m.end() :]) if m and _LITERAL.match(m[0]) else (text, "")
    ops, at = [], 0
    step = re.compile(r"([+-])(\d+)([A-Za-z]+)|/([A-Za-z]+)")
    while at < len(rest):
        m = step.match(rest, at)
        if not m:
            raise RequestError("bad_date", f"not date math: {text}")
        ops.append(("/", 0, unit_of(m[4])) if m[4] else (m[1], int(m[2]), unit_of(m[3])))
        at = m.end()
    return base, ops


def unit_of(name: str) -> str:
    if name in UNITS:
        return UNITS[name]
    plain = name.lower().rstrip("s") if len(name) > 1 else name
    plain = {"millisecond": "milli", "date": "day"}.get(plain, plain)
    if plain not in NAMES:
        raise RequestError("bad_date", f"no unit {name}")
    return plain


def fences(start: int, end: int, n: int, unit: str, tz_name: str | None, most: int = 100_000) -> list[int]:
    """start, start + n units, ... until `end` is reached, each counted from the start in local time; equal instants once."""
    tz = zone(tz_name)
    local = datetime.fromtimestamp(start / 1000, tz).replace(tzinfo=None)
    out, k = [start], 1
    while out[-1] < end:
        if k > most:
            raise RequestError("too_many_buckets", f"over {most} calendar buckets")
        at = instant(moved(local, n * k, unit), tz)
        if at > out[-1]:
            out.append(at)
        k += 1
    return out


def floor_instant(at: int, unit: str, tz_name: str | None) -> int:
    tz = zone(tz_name)
    return instant(floored(datetime.fromtimestamp(at / 1000, tz).replace(tzinfo=None), unit), tz)


def iso(at: int) -> str:
    return datetime.fromtimestamp(at / 1000, UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{at % 1000:03d}Z"
