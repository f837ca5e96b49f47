"""A store: the four tables as DataFrames, and the latest time seen. Any source that fills them can be queried."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import series_key
from .model import LOGS, METRICS, SPANS


@dataclass(frozen=True)
class Store:
    """metrics, spans and logs follow the schemas of ``model``; series is derived unless given. ``latest_ns`` is the time at
    which queries are evaluated when they name none."""

    metrics: DataFrame
    spans: DataFrame
    logs: DataFrame
    series: DataFrame = field(default=None)
    latest: int | None = None

    def __post_init__(self):
        if self.series is None:
            object.__setattr__(self, "series", series_of(self.metrics))

    @cached_property
    def latest_ns(self) -> int:
        """The latest start of a span, unless the store was made with a time; 0 for an empty store."""
        if self.latest is not None:
            return self.latest
        return self.spans.agg(F.max("start_ns")).first()[0] or 0


def series_of(metrics: DataFrame) -> DataFrame:
    """One row a series; the first kind in order of arrival. Name and labels are group columns, so that filters on them
    reach the scan."""
    return metrics.groupBy("series_id", "name", "labels").agg(F.min_by("kind", "seq").alias("kind"))


def with_series_id(points: DataFrame) -> DataFrame:
    return points.withColumn("series_id", series_key(F.col("name"), F.col("labels")))


@contextmanager
def scratch(spark: SparkSession, what: str) -> Iterator[str]:
    """A folder that driver and executors share, deleted at the end: in spark.checkpoint.dir, or, for a local session without
    one, a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}")
    try:
        yield path.toString()
    finally:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def empty_store(spark: SparkSession) -> Store:
    make = lambda schema: spark.createDataFrame([], schema)
    return Store(make(METRICS), make(SPANS), make(LOGS), latest=0)


def append(base: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of both; the new ones arrive after all of the old ones."""
    last = base.agg(F.max("seq")).first()[0]
    return base.unionByName(more.withColumn("seq", F.col("seq") + F.lit(0 if last is None else last + 1)))
