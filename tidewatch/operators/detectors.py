"""Anomaly detectors over (series_id, ts_ms, value), ordered by (ts_ms, seq) in each series.

The robust z-score is a window expression. The recurrences (EWMA, Holt-Winters, CUSUM) are state machines of constant size
fed from a sorted partition in Arrow batches: series are spread over tasks, a long series streams through, and nothing is
held but the state. New detectors register a machine of the same shape.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANOMALY = "series_id long, detector string, timestamp_ms long, observed double, expected double, score double"
#: (expected, score) or nothing.
Found = tuple[float, float] | None


class Ewma:
    """Control chart on an exponentially weighted mean and variance; flagged points still move the state."""

    name = "EWMA control chart"

    def __init__(self, alpha: float = 0.05, k: float = 3.5, warmup: int = 30):
        self.alpha, self.k, self.warmup, self.n, self.mean, self.var = alpha, k, warmup, 0, 0.0, 0.0

    def push(self, x: float) -> Found:
        self.n += 1
        if self.n == 1:
            self.mean = x
            return None
        dev, sigma, mean = x - self.mean, math.sqrt(self.var) if self.var >= 0 else math.nan, self.mean
        self.mean += self.alpha * dev
        self.var = (1 - self.alpha) * (self.var + self.alpha * dev * dev)
        return (mean, abs(dev) / sigma) if self.n > self.warmup and sigma > 0 and abs(dev) > self.k * sigma else None


class Cusum:
    """Two-sided cumulative sums against the first ``warmup`` points; both sums restart after a change point."""

    name = "CUSUM changepoint"

    def __init__(self, warmup: int = 30, k: float = 0.5, h: float = 5.0):
        self.warmup, self.k, self.h, self.first, self.high, self.low = warmup, k, h, [], 0.0, 0.0
        self.mean = self.sigma = 0.0

    def push(self, x: float) -> Found:
        if len(self.first) < self.warmup:
            self.first.append(x)
            if len(self.first) == self.warmup:
                self.mean = sum(self.first) / self.warmup
                self.sigma = math.sqrt(sum((y - self.mean) ** 2 for y in self.first) / self.warmup) if self.warmup > 1 else 0.0
            return None
        if not self.sigma > 0:
            return None
        slack, limit = self.k * self.sigma, self.h * self.sigma
        self.high, self.low = max(self.high + (x - self.mean) - slack, 0.0), max(self.low + (self.mean - x) - slack, 0.0)
        crossed = max(self.high, self.low)
        if crossed > limit:
            self.high = self.low = 0.0
            return self.mean, crossed / limit
        return None


class HoltWinters:
    """Additive level, trend and season of ``period`` points, from two whole seasons on."""

    name = "Holt-Winters"

    def __init__(self, period: int = 12, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.3, k: float = 4.0):
        self.period, self.alpha, self.beta, self.gamma, self.k = period, alpha, beta, gamma, k
        self.early: list[float] = []
        self.step, self.level, self.trend, self.season, self.var = 0, 0.0, 0.0, [], 0.0

    def _forward(self, x: float) -> Found:
        at = self.step % self.period
        seasonal, level = self.season[at], self.level
        forecast = level + self.trend + seasonal
        residual, sigma = x - forecast, math.sqrt(self.var) if self.var >= 0 else math.nan
        found = (forecast, abs(residual) / sigma) if self.step >= 2 * self.period and sigma > 0 and abs(residual) > self.k * sigma else None
        self.level = self.alpha * (x - seasonal) + (1 - self.alpha) * (level + self.trend)
        self.trend = self.beta * (self.level - level) + (1 - self.beta) * self.trend
        self.season[at] = self.gamma * (x - self.level) + (1 - self.gamma) * seasonal
        self.var = 0.95 * self.var + 0.05 * residual * residual
        self.step += 1
        return found

    def push(self, x: float) -> Found:
        if self.period <= 0:
            return None
        if self.season:
            return self._forward(x)
        self.early.append(x)
        if len(self.early) == 2 * self.period:
            one, two = self.early[: self.period], self.early[self.period :]
            self.level = sum(one) / self.period
            self.trend = (sum(two) / self.period - self.level) / self.period
            self.season, self.step, self.early = [y - self.level for y in one], self.period, []
            for y in two:
                self._forward(y)
        return None


MACHINES: dict[str, Callable[[], object]] = {"ewma": Ewma, "cusum": Cusum, "holt_winters": HoltWinters}


def register(name: str, machine: Callable[[], object]) -> None:
    """machine() gives an object with a ``name`` and push(value) -> (expected, score) or None."""
    MACHINES[name] = machine


def detect(points: DataFrame, machine: Callable[[], object] | str) -> DataFrame:
    """Anomalies of every series of (series_id, ts_ms, seq, value)."""
    make = MACHINES[machine] if isinstance(machine, str) else machine
    names = [p.split(" ")[0] for p in ANOMALY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            out = []
            for series, ts, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if series != last:
                    last, state = series, make()
                found = state.push(value) if value is not None else None
                if found:
                    out.append((series, state.name, ts, value, *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    ordered = points.select("series_id", "ts_ms", "value", "seq").repartition("series_id").sortWithinPartitions("series_id", "ts_ms", "seq")
    return ordered.select("series_id", "ts_ms", "value").mapInArrow(run, ANOMALY)


#: Parts that the robust z-score deals a series in.
PARTS = 64


def _in_parts(points: DataFrame, before: int) -> DataFrame:
    """points with a part of their series' time, and ``own`` false for copies of the ``before`` rows that precede a part."""
    span = points.groupBy("series_id").agg(F.min("ts_ms").alias("_from"), (F.max("ts_ms") - F.min("ts_ms") + 1).alias("_span"))
    placed = points.join(span, "series_id").withColumn("part", F.expr(f"(ts_ms - _from) * {PARTS} div _span")).drop("_from", "_span")
    sizes = placed.groupBy("series_id", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = sizes.withColumn("upto", F.sum("n").over(Window.partitionBy("series_id").orderBy("part"))).drop("n")
    # The last rows of a part, by their distance from its end, go to the parts that begin within ``before`` rows of them.
    back = F.row_number().over(Window.partitionBy("series_id", "part").orderBy(F.desc("ts_ms"), F.desc("seq")))
    tails = placed.withColumn("back", back).where(F.col("back") <= before).join(upto, ["series_id", "part"])
    starts = upto.select("series_id", F.col("part").alias("next"), F.lag("upto").over(Window.partitionBy("series_id").orderBy("part")).alias("start"))
    near = tails.join(starts, "series_id").where((F.col("next") > F.col("part")) & (F.col("start") - F.col("upto") + F.col("back") <= before))
    copies = near.select(*points.columns, F.col("next").alias("part"), F.lit(False).alias("own"))
    return placed.withColumn("own", F.lit(True)).select(*copies.columns).unionByName(copies)


def mad(points: DataFrame, window: int = 40, threshold: float = 4.0) -> DataFrame:
    """Robust z-score of each point against the ``window`` points before it; no Python. A series is dealt in parts of its
    time, each with the rows before it, so a series with most points is no single task."""
    frame = Window.partitionBy("series_id", "part").orderBy("ts_ms", "seq").rowsBetween(-window, -1)
    median = lambda a: (F.get(a, F.lit((window - 1) // 2)) + F.get(a, F.lit(window // 2))) / 2
    rows = _in_parts(points.select("series_id", "ts_ms", "seq", "value"), window)
    rows = rows.withColumn("base", F.sort_array(F.collect_list("value").over(frame))).where(F.col("own") & (F.size("base") == window))
    rows = rows.withColumn("center", median(F.col("base")))
    rows = rows.withColumn("mad", median(F.sort_array(F.transform("base", lambda x: F.abs(x - F.col("center"))))))
    rows = rows.where("mad > 0").withColumn("score", F.abs(F.lit(0.6745) * (F.col("value") - F.col("center")) / F.col("mad")))
    found = rows.where(F.col("score") > threshold)
    return found.select("series_id", F.lit("robust z-score (MAD)").alias("detector"), F.col("ts_ms").alias("timestamp_ms"), F.col("value").alias("observed"), F.col("center").alias("expected"), "score")
