"""Times and durations as requests and queries write them."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Duration units in nanoseconds.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000, "w": 604_800_000_000_000, "y": 31_536_000_000_000_000}
_PART = re.compile(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d|w|y)")


def duration_ns(text: str) -> int:
    """Nanoseconds of a duration like 1h30m."""
    if not text or _PART.sub("", text):
        raise ValueError(f"no duration: {text!r}")
    return sum(round(float(n) * UNITS[u]) for n, u in _PART.findall(text))


def is_duration(text: str) -> bool:
    return bool(text) and not _PART.sub("", text)


def parse_time(text: str | int | float, now: datetime | None = None) -> datetime:
    """An instant in UTC: epoch s, ms, us or ns (by size), RFC 3339, a date or its parts, now, now-1h, or an age like 1h."""
    now = now or datetime.now(UTC)
    s = str(text).strip()
    if re.fullmatch(r"-?\d+(\.\d+)?", s) and not re.fullmatch(r"\d{4}", s):
        value = float(s)
        for limit, scale in ((1e11, 1), (1e14, 1e3), (1e17, 1e6)):
            if abs(value) < limit:
                break
        else:
            scale = 1e9
        exact = int(s) * 1_000_000 // int(scale) if s.lstrip("-").isdigit() else round(value * 1e6 / scale)
        return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=exact)
    if s == "now":
        return now
    if m := re.fullmatch(r"now([+-])(.+)", s):
        step = timedelta(microseconds=duration_ns(m[2]) / 1000)
        return now - step if m[1] == "-" else now + step
    if is_duration(s.removeprefix("-")):
        return now - timedelta(microseconds=duration_ns(s.removeprefix("-")) / 1000)
    for form in ("%Y", "%Y-%m", "%Y-%m-%dT%H"):
        try:
            return datetime.strptime(s, form).replace(tzinfo=UTC)
        except ValueError:
            continue
    found = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", s))
    return found.astimezone(UTC) if found.tzinfo else found.replace(tzinfo=UTC)


def end_of(text: str, now: datetime | None = None) -> datetime:
    """The last microsecond that a range's end means: a bare date means the whole day."""
    at, s = parse_time(text, now), str(text).strip()
    tick = timedelta(microseconds=1)
    if re.fullmatch(r"\d{4}-\d\d-\d\d", s):
        return at + timedelta(days=1) - tick
    if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d", s):
        return at + timedelta(hours=1) - tick
    return at


def bucket(time: Column, step: str) -> Column:
    """Start of a step's bucket, counted from the epoch in UTC."""
    us = duration_ns(step) // 1000
    if us <= 0:
        raise ValueError(f"no step: {step!r}")
    at = F.unix_micros(time.cast("timestamp"))
    return F.timestamp_micros(at - F.pmod(at, F.lit(us)))
