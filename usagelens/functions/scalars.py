"""Scalar functions on times, durations, versions, text sets and resource strings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket widths in seconds.  A week starts on Monday; 1970-01-05 was one.
BUCKET_SECONDS = {
    "half-hour": 1800,
    "hour": 3600,
    "half-day": 43200,
    "day": 86400,
    "week": 604800,
}
WEEK_ANCHOR = 4 * 86400
KB_PER_GB = 1 << 20


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_to(c: Column | str, width: int, anchor: int = 0) -> Column:
    """The start of the fixed-width bucket that holds ``c``."""
    c = _col(c)
    return c - F.pmod(c - F.lit(anchor), F.lit(width))


def trunc_time(c: Column | str, unit: str) -> Column:
    """Start of the half-hour, hour, half-day, day or ISO week (UTC)."""
    return floor_to(c, BUCKET_SECONDS[unit], WEEK_ANCHOR if unit == "week" else 0).cast("bigint")


def relative_date(text: str, now: dt.datetime, end: bool = False) -> int:
    """``YYYY-MM-DD``, ``Nd`` or ``Nw`` as Unix seconds; an end date means 23:59:59 of that day."""
    text = text.strip()
    if text[-1:] in ("d", "w") and text[:-1].isdigit():
        day = (now - dt.timedelta(days=int(text[:-1]) * (7 if text[-1] == "w" else 1))).date()
    else:
        day = dt.date.fromisoformat(text)
    at = dt.time(23, 59, 59) if end else dt.time(0, 0, 0)
    return int(dt.datetime.combine(day, at, tzinfo=dt.timezone.utc).timestamp())


def string_set_compare(a: Column | str, b: Column | str, op: str) -> Column:
    """Set relation of two string arrays: ``=``, ``<``, ``<=``, ``>``, ``>=``."""
    a, b = _col(a), _col(b)
    if op in (">", ">="):
        a, b = b, a
    included = F.size(F.array_except(a, b)) == 0
    covers = F.size(F.array_except(b, a)) == 0
    if op == "=":
        return included & covers
    if op in ("<", ">"):
        return included & ~covers
    return included


def parse_duration(c: Column | str) -> Column:
    """``1w2d3h4m`` (any subset, in this order) or plain seconds to seconds; NULL if neither."""
    text = F.trim(_col(c))
    pattern = r"^(?:(\d+)[wW])?(?:(\d+)[dD])?(?:(\d+)[hH])?(?:(\d+)[mM])?$"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, i).try_cast("bigint"), F.lit(0))

    total = part(1) * 604800 + part(2) * 86400 + part(3) * 3600 + part(4) * 60
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")).when(
        (text != "") & text.rlike(pattern), total
    )


def format_duration(c: Column | str) -> Column:
    """``1d2h3m``, rounded to the nearest minute, ties up."""
    minutes = F.floor((_col(c) + 30) / 60).cast("bigint")
    return F.format_string(
        "%dd%dh%dm", F.floor(minutes / 1440), F.pmod(F.floor(minutes / 60), F.lit(24)), F.pmod(minutes, F.lit(60))
    )


def format_time(c: Column | str, style: str = "minute") -> Column:
    """``yyyy-MM-dd HH:mm``, or an ISO time with ``style="iso"``."""
    pattern = {"minute": "yyyy-MM-dd HH:mm", "iso": "yyyy-MM-dd'T'HH:mm:ss'Z'", "date": "yyyy-MM-dd", "time": "HH:mm"}
    return F.date_format(F.timestamp_seconds(_col(c)), pattern[style])


def round_up(c: Column | str) -> Column:
    """Ceiling of a percentage or a size, as shown in reports."""
    return F.ceil(_col(c)).cast("bigint")


def kb_to_gb(c: Column | str) -> Column:
    """Whole GB by integer division."""
    return F.floor(_col(c) / KB_PER_GB).cast("bigint")


def parse_gpu_request(c: Column | str) -> Column:
    """GPU entries of a resource string: ``gres/gpu:model=n`` gives ``model=n``, ``gres/gpu=n`` gives ``*=n``."""
    entries = F.filter(F.split(F.coalesce(_col(c), F.lit("")), ","), lambda e: e.rlike(r"^gres/gpu[=:]"))
    named = F.transform(
        entries,
        lambda e: F.when(e.startswith("gres/gpu="), F.concat(F.lit("*"), F.substr(e, F.lit(9)))).otherwise(
            F.substr(e, F.lit(10))
        ),
    )
    return F.array_join(named, ",")


def parse_version(c: Column | str) -> Column:
    """``a.b.c[-devel]`` to a struct of three ints; -devel adds 100 to the last; zeros where unparseable."""
    text = F.coalesce(_col(c), F.lit(""))
    pattern = r"^(\d+)\.(\d+)\.(?:(\d+)(-devel)?$)?"

    def part(i: int) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, i).try_cast("int"), F.lit(0))

    devel = F.when(F.regexp_extract(text, pattern, 4) != "", 100).otherwise(0)
    return F.struct(part(1).alias("major"), part(2).alias("minor"), (part(3) + devel).alias("bugfix"))


def clamp_outlier(c: Column | str, limit: float | None) -> Column:
    """Above twice the limit is noise and becomes zero; above the limit becomes the limit."""
    c = _col(c)
    if not limit:
        return c
    return F.when(c > 2 * limit, 0).when(c > limit, limit).otherwise(c)


def round_minute(c: Column | str) -> Column:
    """Nearest minute, 30 seconds go up."""
    return floor_to(_col(c) + 30, 60).cast("bigint")


def round_half_up(c: Column | str) -> Column:
    """Nearest integer of a non-negative value, ties up."""
    return F.floor(_col(c) + F.lit(0.5)).cast("bigint")


def job_mark(live_at_start: Column, live_at_end: Column) -> Column:
    """``!`` live at both bounds, ``<`` at the start, ``>`` at the end."""
    return (
        F.when(live_at_start & live_at_end, "!").when(live_at_start, "<").when(live_at_end, ">").otherwise("")
    )
