"""Time windows of queries, and how times are shown. What has no offset is Indian Standard Time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Preset windows in seconds, the one that stands for unknown names, and the zone of times without offset.
RANGES = {"15m": 900, "1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800}
DEFAULT_RANGE = "1h"
ZONE, OFFSET = "Asia/Kolkata", "+05:30"


def bound_ms(text: Column, is_end: bool = False) -> Column:
    """Milliseconds of an ISO 8601 text, null if it is none; a bare date is the start of its day, or the last millisecond for an end."""
    s = F.trim(text)
    s = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T23:59:59.999" if is_end else "T00:00:00"))).otherwise(s)
    has_offset = s.endswith("Z") | s.contains("+") | F.substring(s, 11, 40).contains("-")
    s = F.when(has_offset, s).otherwise(F.concat(s, F.lit(OFFSET)))
    whole = s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$")
    s = F.regexp_replace(s, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    return F.when(whole, F.unix_millis(F.replace(s, F.lit(","), F.lit(".")).try_cast("timestamp")))


def window(now_ms: int, name: str | None = None) -> tuple[str, int | None, int | None]:
    """A preset window's name and bounds (since, until); `all` has none, an unknown name is DEFAULT_RANGE."""
    name = (name or DEFAULT_RANGE).lower()
    if name == "all":
        return name, None, None
    name = name if name in RANGES else DEFAULT_RANGE
    return name, now_ms - 1000 * RANGES[name], None


def within(time_ms: Column, since: Column | None, until: Column | None) -> Column:
    """Whether a time lies in a window; both bounds are inclusive, a null bound is none."""
    after = F.lit(True) if since is None else F.coalesce(time_ms >= since, F.lit(True))
    return after if until is None else after & F.coalesce(time_ms <= until, F.lit(True))


def _wall(ms: Column, zone: str) -> Column:
    """The wall clock in a zone, whatever the session's zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01").cast("timestamp_ntz")))


def ist(ms: Column) -> Column:
    return F.concat(F.date_format(_wall(ms, ZONE), "yyyy-MM-dd HH:mm:ss"), F.lit(" IST"))


def ist_utc(ms: Column) -> Column:
    return F.concat(ist(ms), F.lit(" ("), F.date_format(_wall(ms, "UTC"), "HH:mm:ss"), F.lit("Z)"))


def iso_ms(ms: Column) -> Column:
    return F.concat(F.date_format(_wall(ms, "UTC"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
