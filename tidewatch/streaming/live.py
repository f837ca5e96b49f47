"""Live telemetry with Structured Streaming: a landing folder in, tables and events out.

Routing is stateless and appends; the latest time is the maximum over what was appended, so nothing but the stream's own
checkpoint is state. Independent queries take the place of a broadcast to subscribers: a slow one falls behind, it loses
nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.exprs import duration_ms
from ..model import LOGS, METRICS, SPANS
from ..sources import envelope, otlp, simulator
from ..store import Store

TABLES = {"metrics": METRICS, "spans": SPANS, "logs": LOGS}


#: Bits of an order of arrival: micro-batch, partition of it, row of that.
PARTITION_BITS, ROW_BITS = 14, 26


def arrival(seq: Column, number: int) -> Column:
    """The order of arrival over all micro-batches, from the order within one (a partition in the bits from 33 on)."""
    part, row = F.shiftrightunsigned(seq, 33), seq.bitwiseAND((1 << 33) - 1)
    fits = (part < 1 << PARTITION_BITS) & (row < 1 << ROW_BITS)
    own = F.when(fits, part * (1 << ROW_BITS) + row).otherwise(F.raise_error(F.lit("a micro-batch has too many rows or partitions")).cast("long"))
    return own + F.lit(number << (PARTITION_BITS + ROW_BITS))


def signal_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("value string").text(folder)


def route(lines: DataFrame, base: str, once: bool = True) -> StreamingQuery:
    """Parses each micro-batch once and appends it to base/metrics, base/spans and base/logs. A batch that is repeated after
    a failure overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        signals = envelope.parsed(batch).persist()
        try:
            for name, rows in (("metrics", envelope.metrics(signals)), ("spans", envelope.spans(signals)), ("logs", envelope.logs(signals))):
                rows.withColumn("seq", arrival(F.col("seq"), number)).write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")
        finally:
            signals.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/_stream")
    return writer.trigger(availableNow=True).start() if once else writer.start()


#: Simulated requests: how many stand there at the start, and how many come each second.
BACKFILL, EACH_SECOND = 2000, 4


def ticks(spark: SparkSession, each_second: int = EACH_SECOND) -> DataFrame:
    """A stream of numbers ``value`` from 0, the same again after a failure."""
    return spark.readStream.format("rate").option("rowsPerSecond", each_second).load()


def feed(numbers: DataFrame, base: str, backfill: int = BACKFILL, seed: int = 7, start_ns: int = 1_700_000_000_000_000_000) -> StreamingQuery:
    """Simulated requests, appended to base/metrics, base/spans and base/logs: a backfill first (not again when a feed is taken
    up), then one for each number of the stream, these also as events to base/events. Values follow from the request's number, so
    a repeated batch writes the same again."""

    def write(rows: DataFrame, part: str) -> Store:
        made = simulator.store_of(simulator.numbered(rows, seed, start_ns))
        for name in TABLES:
            getattr(made, name).write.mode("overwrite").parquet(f"{base}/{name}/batch={part}")
        return made

    def follow(rows: DataFrame, number: int) -> None:
        made = write(rows, str(number))
        event_json(request_events(made.spans)).write.mode("overwrite").parquet(f"{base}/events/batch={number}")

    if not _exists(numbers.sparkSession, f"{base}/_feed"):
        write(numbers.sparkSession.range(backfill).withColumnRenamed("id", "n"), "backfill")
    following = numbers.select((F.col("value") + backfill).alias("n"))
    return following.writeStream.foreachBatch(follow).option("checkpointLocation", f"{base}/_feed").start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def events(spark: SparkSession, base: str) -> DataFrame:
    """The stream of the events that a feed or ``publish`` writes to base/events, as JSON texts ``value``."""
    return spark.readStream.schema("value string").option("recursiveFileLookup", "true").parquet(f"{base}/events")


def publish(spans: DataFrame, base: str, once: bool = True) -> StreamingQuery:
    """The request events of a stream of spans, appended to base/events."""
    writer = event_json(request_events(spans)).writeStream.format("parquet").option("path", f"{base}/events").option("checkpointLocation", f"{base}/_events")
    return writer.trigger(availableNow=True).start() if once else writer.start()


#: How many events wait for a subscriber.
BACKLOG = 256


def subscribe(published: DataFrame, send: Callable[[list[str]], None], checkpoint: str, backlog: int = BACKLOG, once: bool = True) -> StreamingQuery:
    """Hands the events of each micro-batch to ``send``, in order of time. A subscriber that lags behind skips ahead: of a
    micro-batch of more than ``backlog`` events it gets the last, and no more than those come to the driver."""

    def hand(batch: DataFrame, number: int) -> None:
        at = F.get_json_object("value", "$.timestamp_ns").cast("long")
        rows = batch.select(at.alias("at"), "value").orderBy(F.desc("at"), "value").limit(backlog).collect()
        if rows:
            send([r.value for r in sorted(rows, key=lambda r: (r.at, r.value))])

    writer = published.writeStream.foreachBatch(hand).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def exports(spark: SparkSession, folder: str, base: str) -> StreamingQuery:
    """OTLP bodies that land in a folder, appended to base/spans; the errors of those that don't decode to base/errors, as
    (body_id, error)."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        bodies = otlp.bodies_of_files(batch).persist()
        try:
            otlp.spans(bodies).write.mode("overwrite").parquet(f"{base}/spans/batch={number}")
            otlp.decoded(bodies).where("error IS NOT NULL").select("body_id", "error").write.mode("overwrite").parquet(f"{base}/errors/batch={number}")
        finally:
            bodies.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/_exports").trigger(availableNow=True).start()


def store(spark: SparkSession, base: str, latest: int | None = None) -> Store:
    """What has been routed to base so far."""
    read = lambda name: spark.read.schema(TABLES[name]).option("recursiveFileLookup", "true").parquet(f"{base}/{name}")
    return Store(read("metrics"), read("spans"), read("logs"), latest=latest)


def request_events(spans: DataFrame) -> DataFrame:
    """One event for each root span, batch or stream alike."""
    roots = spans.where("parent_span_id IS NULL")
    failed = F.col("status") == "Error"
    return roots.select(
        F.lit("request").alias("kind"), "trace_id", F.col("name").alias("route"), F.when(failed, 500).otherwise(200).alias("status"),
        duration_ms(F.col("start_ns"), F.col("end_ns")).alias("duration_ms"), failed.alias("failed"), F.col("start_ns").alias("timestamp_ns"),
    )


def event_json(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def latest(rows: DataFrame) -> DataFrame:
    """The latest start, one row; on a stream in complete mode."""
    return rows.agg(F.max("start_ns").alias("latest_ns"))


def recent(events: DataFrame, keep: int = 400) -> DataFrame:
    """The last events in order of time."""
    return events.orderBy(F.desc("timestamp_ns"), "trace_id").limit(keep).orderBy("timestamp_ns", "trace_id")
