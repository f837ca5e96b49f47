"""Texts for people: durations, compact counts, percentages, kilobytes, ids. A null shows as a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import labels_text

NOTHING = "—"
SEVERITY_SIGNS = ("·", "·", "ⓘ", "▲", "✖", "✖")


def _fixed(x: Column, digits: int) -> Column:
    """Without thousands separators; null for null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.round(x.cast("double"), digits)))


def milliseconds(x: Column) -> Column:
    """One decimal under 10, none above."""
    return F.coalesce(F.when(x < 10, _fixed(x, 1)).otherwise(_fixed(x, 0)), F.lit(NOTHING))


def percent(x: Column) -> Column:
    return F.coalesce(_fixed(x * 100, 1), F.lit(NOTHING))


def kilobytes(x: Column) -> Column:
    return _fixed(x / 1024, 0)


def compact(x: Column) -> Column:
    """1234 as 1.2K, then M, B and T; one decimal at most."""
    out = F.regexp_replace(_fixed(x, 1), r"\.0$", "")
    for size, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        # What would round to a thousand of a unit is one of the next.
        out = F.when(F.abs(x) >= size * 0.99995, F.concat(F.regexp_replace(_fixed(x / size, 1), r"\.0$", ""), F.lit(unit))).otherwise(out)
    return F.coalesce(out, F.lit(NOTHING))


def waterfall_bar(offset: Column, size: Column) -> Column:
    """A bar of the waterfall as text."""
    return F.concat(F.repeat(F.lit(" "), offset), F.repeat(F.lit("█"), size))


def span_line(service: Column, offset: Column, size: Column, ns: Column) -> Column:
    """A span as a row of the waterfall: service, bar, duration."""
    return F.concat(F.lit("  "), F.rpad(service, F.greatest(F.length(service), F.lit(16)), " "), F.lit(" "), waterfall_bar(offset, size), F.lit(" "), tenths(ns))


def header_line(trace_id: Column, ns: Column, failed: Column) -> Column:
    return F.concat(F.lit("▶ trace "), F.substring(trace_id, 1, 8), F.lit("   "), tenths(ns), F.lit("   "), F.when(failed, "● FAIL").otherwise("● OK"))


def log_line(severity_num: Column, body: Column) -> Column:
    """A log after the sign of its severity."""
    return F.concat(F.lit("  "), F.get(F.array(*map(F.lit, SEVERITY_SIGNS)), severity_num), F.lit(" "), body)


def metric_text(name: Column, labels: Column, value: Column) -> Column:
    """name{key=value,...} number"""
    inside = F.when(F.size(labels) > 0, F.concat(F.lit("{"), labels_text(labels), F.lit("}"))).otherwise("")
    return F.concat(name, inside, F.lit(" "), _fixed(value, 0))


def tenths(ns: Column) -> Column:
    """Nanoseconds as milliseconds with one decimal, at least seven places wide; halves go up."""
    n = F.floor((ns + 50_000) / 100_000)
    text = F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
    return F.concat(F.lpad(text, F.greatest(F.length(text), F.lit(7)), " "), F.lit("ms"))
