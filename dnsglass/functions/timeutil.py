"""Relative time ranges (FLT-6), parsed once on the driver into a literal."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two notations of the reference
_STORE_MATH = re.compile(r"^now-(\d+)([mhd])(/d)?$")      # m = minutes
_REPORT = re.compile(r"^(\d+)([hdwm])$")                    # m = months
_UNIT = {"m": "MINUTES", "h": "HOURS", "d": "DAYS"}


def relative_range(spec: str, as_of: str) -> Column:
    """Start timestamp of a relative range ending at `as_of`.

    'now-24h' / 'now-90m' (m = minutes) / 'now-1d/d' (rounded down to the day);
    report form '12h', '7d', '2w', '3m' (m = months); anything else -> 24 h."""
    now = F.lit(as_of).cast("timestamp_ntz")
    m = _STORE_MATH.match(spec)
    if m:
        start = now - F.expr(f"INTERVAL {int(m.group(1))} {_UNIT[m.group(2)]}")
        return F.date_trunc("day", start) if m.group(3) else start
    m = _REPORT.match(spec)
    if m:
        n, u = int(m.group(1)), m.group(2)
        if u == "w":
            return now - F.expr(f"INTERVAL {7 * n} DAYS")
        if u == "m":
            return F.add_months(now, -n).cast("timestamp_ntz") + (now - F.date_trunc("day", now))
        return now - F.expr(f"INTERVAL {n} {_UNIT[u]}")
    return now - F.expr("INTERVAL 24 HOURS")
