"""Durations and resource quantities written as text."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per unit of a short duration (30s, 1m, 1h30m).
SHORT_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0, "y": 31536000.0}
# Factors of quantity suffixes (500m, 240Gi).
QUANTITY_UNITS = {
    "n": 1e-9, "u": 1e-6, "m": 1e-3, "": 1.0,
    "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18,
    "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50, "Ei": 2.0**60,
}
ISO = r"^P(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?$"
SHORT = r"^(?:\d+(?:ms|[smhdwy]))+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def duration_seconds(column: Column | str) -> Column:
    """Seconds of an ISO 8601 duration (``PT15M``) or a short one (``1h30m``); else null."""
    text = _col(column)
    iso = sum(
        (F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(0.0)) * factor
         for pattern, factor in ((r"P(\d+)D", 86400.0), (r"T.*?(\d+)H", 3600.0),
                                 (r"T.*?(\d+)M", 60.0), (r"T.*?(\d+(?:\.\d+)?)S", 1.0))),
        F.lit(0.0))
    short = sum(
        (F.coalesce(F.regexp_extract(text, rf"(\d+){unit}(?:\d|$)", 1).try_cast("double"), F.lit(0.0)) * factor
         for unit, factor in SHORT_UNITS.items()),
        F.lit(0.0))
    is_iso = text.rlike(ISO) & text.rlike(r"\d")
    return F.when(is_iso, iso).when(text.rlike(SHORT), short)


def quantity_value(column: Column | str) -> Column:
    """Number of a quantity such as ``240Gi`` or ``500m``; else null."""
    text = _col(column)
    pattern = r"^([+-]?\d+(?:\.\d+)?)(n|u|m|k|M|G|T|P|E|Ki|Mi|Gi|Ti|Pi|Ei)?$"
    suffix = F.regexp_extract(text, pattern, 2)
    factor = F.lit(None).cast("double")
    for unit, value in QUANTITY_UNITS.items():
        factor = F.when(suffix == unit, F.lit(value)).otherwise(factor)
    return F.regexp_extract(text, pattern, 1).try_cast("double") * factor


def parse_duration(text: str) -> timedelta:
    """The same two notations for arguments such as ``every="PT15M"``."""
    if re.fullmatch(ISO, text) and re.search(r"\d", text):
        days, clock = re.match(r"P(?:(\d+)D)?T?(.*)", text).groups()
        found = {unit: float(n) for n, unit in re.findall(r"(\d+(?:\.\d+)?)([HMS])", clock)}
        return timedelta(days=int(days or 0), hours=found.get("H", 0),
                         minutes=found.get("M", 0), seconds=found.get("S", 0))
    if re.fullmatch(SHORT, text):
        return timedelta(seconds=sum(
            int(n) * SHORT_UNITS[unit] for n, unit in re.findall(r"(\d+)(ms|[smhdwy])", text)))
    raise ValueError(f"not a duration: {text!r}")


def interval(text: str) -> str:
    """Spark interval text of a duration argument."""
    return f"{round(parse_duration(text).total_seconds() * 1000)} milliseconds"
