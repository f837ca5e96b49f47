"""Column expressions with the language's exact semantics; all of them stay in generated code or built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import SEVERITIES

NAN, INF = float("nan"), float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as IEEE 754 has it: no error and no null on zero; the sign of a zero divisor counts."""
    a, b = a.cast("double"), b.cast("double")
    negative_zero = b.cast("string") == "-0.0"
    infinite = F.signum(a) * F.when(negative_zero, -INF).otherwise(INF)
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), NAN).otherwise(infinite)).otherwise(F.try_divide(a, b))


def ieee_div_float(a: float, b: float) -> float:
    if b:
        return a / b
    return NAN if a == 0 or math.isnan(a) else math.copysign(INF, a) * math.copysign(1.0, b)


def label_is(labels: Column, key: str, value: str) -> Column:
    """An absent label never equals anything, not even the empty text. Null, not false, for an absent one: a filter drops
    both, and a plain comparison is what Parquet can be given."""
    return labels[key] == value


def label_is_not(labels: Column, key: str, value: str) -> Column:
    """An absent label is unequal to everything."""
    return ~labels[key].eqNullSafe(F.lit(value))


def labels_text(labels: Column) -> Column:
    """Labels in the order of their keys, as key=value joined by commas."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def min_number(v: Column, none: float) -> Column:
    """The least that is a number; ``none`` if every value is NaN (null for no values at all)."""
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.when(F.count(v) > 0, F.lit(none)))


def max_number(v: Column, none: float) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.when(F.count(v) > 0, F.lit(none)))


def mean(v: Column) -> Column:
    """0 for no values, as ``stddev`` and ``median`` are."""
    return F.coalesce(F.avg(v), F.lit(0.0))


def stddev(v: Column) -> Column:
    """Of a population; 0 for a single value."""
    return F.coalesce(F.stddev_pop(v), F.lit(0.0))


def median(v: Column) -> Column:
    return F.coalesce(linear_quantile(v, 0.5), F.lit(0.0))


def linear_quantile(v: Column, q: float) -> Column:
    """Linear interpolation between closest ranks, q held to [0, 1]. It holds a map of a group's distinct values, which
    ``linear_ranks`` does not."""
    return F.percentile(v, _held(q))


def _held(q: float) -> float:
    return min(max(q, 0.0), 1.0) if q == q else 0.0


def _ranked(rows: DataFrame, by: list[str], group: list[str], value: str) -> DataFrame:
    """(by, value, _c, _upto, _n): how often a value occurs in its group, the number of values up to it, and of all. Equal values
    are counted before they are ordered, and the ordered counts stream: no group is held as an array. ``group`` are columns
    of ``by`` that tell the groups apart."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*group)
    return counted.withColumns({"_upto": F.sum("_c").over(whole.orderBy(value)), "_n": F.sum("_c").over(whole)})


def linear_ranks(rows: DataFrame, by: list[str], group: list[str], value: str, q: float) -> DataFrame:
    """(by, value) of each group's linear quantile; groups without a value have none."""
    at = F.lit(_held(q)) * (F.col("_n") - 1)
    of_rank = lambda r: F.min(F.when(F.col("_upto") > r, F.col(value)))
    ends = _ranked(rows.where(F.col(value).isNotNull()), by, group, value).groupBy(*by).agg(of_rank(F.floor(at)).alias("_low"), of_rank(F.ceil(at)).alias("_high"), F.max(at - F.floor(at)).alias("_share"))
    between = F.col("_low") * (1 - F.col("_share")) + F.col("_high") * F.col("_share")
    return ends.select(*by, F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between).alias(value))


def nearest_ranks(rows: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(by, n, a column a quantile) of the values' nearest ranks in each group."""
    ranked = _ranked(rows, by, by, value)
    at = lambda q: F.round(F.lit(q) * (F.col("_n") - 1)).cast("long")
    return ranked.groupBy(*by).agg(F.max("_n").alias("n"), *(F.coalesce(F.min(F.when(F.col("_upto") > at(q), F.col(value))), F.lit(0.0)).alias(c) for c, q in quantiles.items()))


def duration_ns(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0).cast("bigint"))


def duration_ms(start: Column, end: Column) -> Column:
    return duration_ns(start, end) / F.lit(1e6)


def millis(column: str) -> Column:
    """Whole milliseconds of a nanosecond column, in integer arithmetic."""
    return F.expr(f"{column} div 1000000")


def severity_number(name: Column) -> Column:
    """0 (trace) to 5 (fatal), whatever the case; null for any other name."""
    found = F.lit(None).cast("int")
    for k, s in enumerate(SEVERITIES):
        found = F.when(F.lower(name) == s.lower(), k).otherwise(found)
    return found


def severity_rank(name: str | None) -> int | None:
    return next((k for k, s in enumerate(SEVERITIES) if name is not None and s.lower() == name.lower()), None)


def is_hex(text: Column, size: int) -> Column:
    return F.coalesce(text.rlike(f"^[0-9a-fA-F]{{{2 * size}}}$"), F.lit(False))


def hex_id(text: Column, size: int) -> Column:
    """The id in lower case if it is one of ``size`` bytes, else null."""
    return F.when(is_hex(text, size), F.lower(text))


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def short_id(text: Column) -> Column:
    return F.substring(text, 1, 8)


def text_attribute(attributes: Column, key: str) -> Column:
    """The attribute if it is a text; values of other types give null, as all typed reads do."""
    return _typed(attributes, key, ("STRING",), "string")


def int_attribute(attributes: Column, key: str) -> Column:
    return _typed(attributes, key, ("BIGINT",), "bigint")


def double_attribute(attributes: Column, key: str) -> Column:
    """Fractional numbers; parsed JSON holds those with a point as decimals."""
    return _typed(attributes, key, ("DOUBLE", "FLOAT", "DECIMAL"), "double")


def bool_attribute(attributes: Column, key: str) -> Column:
    return _typed(attributes, key, ("BOOLEAN",), "boolean")


def _typed(attributes: Column, key: str, names: tuple[str, ...], kind: str) -> Column:
    value = attributes[key]
    fits = F.schema_of_variant(value).rlike(f"^({'|'.join(names)})")
    return F.when(fits, F.try_variant_get(value, "$", kind))


def service_of(resource: Column) -> Column:
    return F.coalesce(text_attribute(resource, "service.name"), F.lit("?"))


def series_key(name: Column, labels: Column) -> Column:
    """An id of name and labels for joins and groups; it does not depend on the order of the labels."""
    return F.xxhash64(name, labels_text(labels), F.size(labels))


def _fnv_bytes(state: Column, data: Column) -> Column:
    """FNV-1a 64 over bytes, state and result as (hi, lo) halves so that no product overflows a long."""
    mask = F.lit(0xFFFFFFFF)

    def step(s, i):
        low = s["lo"].bitwiseXOR(F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("bigint"))
        product = low * 435
        high = (s["hi"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.struct(high.alias("hi"), product.bitwiseAND(mask).alias("lo"))

    positions = F.when(F.octet_length(data) > 0, F.sequence(F.lit(1), F.octet_length(data))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(positions, state, step)


def fnv_series_id(name: Column, labels: Column) -> Column:
    """The published id of a series, as 16 hex digits: FNV-1a 64 of name, 0xff, then key = value 0x00 by key."""
    entries = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"].cast("binary"), F.lit(b"="), e["value"].cast("binary"), F.lit(b"\x00")))
    data = F.concat(name.cast("binary"), F.lit(b"\xff"), F.aggregate(entries, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)))
    seed = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))
    out = _fnv_bytes(seed, data)
    return F.lower(F.concat(F.lpad(F.hex(out["hi"]), 8, "0"), F.lpad(F.hex(out["lo"]), 8, "0")))
