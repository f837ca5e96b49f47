"""The driver's tables seen as telemetry: two metrics from events, spans from orders and their lines, logs from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import severity_number
from ..model import SEVERITIES
from ..store import Store, with_series_id


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns_of(column: str):
    """Nanoseconds of a timestamp without zone, taken as UTC whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column}) * 1000")


def gauges(events: DataFrame) -> DataFrame:
    labels = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("bucket"), (F.col("user_id") % 4).cast("string"))
    points = events.select(F.lit("event_value").alias("name"), F.lit("Gauge").alias("kind"), labels.alias("labels"), F.expr("_ns div 1000000").alias("ts_ms"), "value", F.col("event_id").alias("seq"))
    return with_series_id(points)


def counters(events: DataFrame) -> DataFrame:
    """A counter of each event type that falls back to 0 every hundred events."""
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("_ns", "event_id"))
    labels = F.create_map(F.lit("event_type"), F.col("event_type"))
    points = events.select(F.lit("events_total").alias("name"), F.lit("Counter").alias("kind"), labels.alias("labels"), F.expr("_ns div 1000000").alias("ts_ms"), (n % 100).cast("double").alias("value"), F.col("event_id").alias("seq"))
    return with_series_id(points)


def spans(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    lpad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    ns = lambda price: F.round(price * 1e6).cast("bigint")
    start = ns_of("o_orderdate")
    roots = orders.select(
        F.col("o_orderkey").alias("trace"), (F.col("o_orderkey") * 64).alias("span"), F.lit(None).cast("bigint").alias("parent"), F.lit("order").alias("name"), F.lit("gateway").alias("service"),
        start.alias("start_ns"), (start + ns(F.col("o_totalprice"))).alias("end_ns"), F.when(F.col("o_orderstatus") == "F", "Error").otherwise("Ok").alias("status"),
    )
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    lines = lineitem.withColumn("rn", rn.cast("bigint")).join(orders.select("o_orderkey", start.alias("order_ns")), F.col("l_orderkey") == F.col("o_orderkey"))
    begin = F.col("order_ns") + F.col("l_linenumber").cast("bigint") * 1_000_000_000
    children = lines.select(
        F.col("l_orderkey").alias("trace"), (F.col("l_orderkey") * 64 + F.col("rn")).alias("span"), (F.col("l_orderkey") * 64 + F.greatest(F.col("rn") - 3, F.lit(0))).alias("parent"), F.lit("line").alias("name"),
        F.concat(F.lit("svc-"), (F.col("l_suppkey") % 6).cast("string")).alias("service"), begin.alias("start_ns"),
        F.when(F.col("l_linenumber") == 7, begin - 1).otherwise(begin + ns(F.col("l_extendedprice"))).alias("end_ns"), F.when(F.col("l_returnflag") == "R", "Error").otherwise("Ok").alias("status"),
    )
    both = roots.unionByName(children)
    none = F.lit(None).cast("map<string,variant>")
    return both.select(
        lpad(F.col("trace"), 32).alias("trace_id"), lpad(F.col("span"), 16).alias("span_id"), lpad(F.col("parent"), 16).alias("parent_span_id"), "name", F.lit("Internal").alias("kind"),
        "start_ns", "end_ns", "status", none.alias("attributes"), none.alias("resource"), "service", F.col("span").alias("seq"),
    )


def logs(events: DataFrame) -> DataFrame:
    names = {"view": "Debug", "click": "Info", "signup": "Info", "purchase": "Warn", "error": "Error"}
    severity = F.lit("Info")
    for event_type, name in names.items():
        severity = F.when(F.col("event_type") == event_type, name).otherwise(severity)
    none = F.lit(None).cast("map<string,variant>")
    rows = events.select(
        F.col("_ns").alias("ts_ns"), severity.alias("severity"), F.col("props").alias("body"), none.alias("attributes"), none.alias("resource"), F.lit("events").alias("service"),
        F.lpad(F.col("event_id").cast("string"), 32, "0").alias("trace_id"), F.lit(None).cast("string").alias("span_id"), F.col("event_id").alias("seq"),
    )
    return rows.withColumn("severity_num", severity_number(F.col("severity"))).select("ts_ns", "severity", "severity_num", "body", "attributes", "resource", "service", "trace_id", "span_id", "seq")


def store(spark: SparkSession, sf_dir: str, latest: int | None = None) -> Store:
    events = read(spark, sf_dir, "events").withColumn("_ns", ns_of("ts"))
    return Store(gauges(events).unionByName(counters(events)), spans(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")), logs(events), latest=latest)


def last_event_ns(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "events").agg(F.max(ns_of("ts"))).first()[0] or 0


# The same views in DuckDB, as the WITH parts of oracle queries.
_SEVERITY = "CASE event_type WHEN 'view' THEN 'Debug' WHEN 'purchase' THEN 'Warn' WHEN 'error' THEN 'Error' ELSE 'Info' END"
M_SQL = "m AS (SELECT event_id AS seq, event_type, CAST(user_id % 4 AS VARCHAR) AS bucket, epoch_us(ts) // 1000 AS ts_ms, value FROM events)"
CTR_SQL = "ctr AS (SELECT event_id AS seq, event_type, epoch_us(ts) // 1000 AS ts_ms, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) % 100 AS DOUBLE) AS value FROM events)"
SPANS_SQL = """spans AS (
  SELECT lpad(CAST(trace AS VARCHAR), 32, '0') AS trace_id, lpad(CAST(span AS VARCHAR), 16, '0') AS span_id, lpad(CAST(parent AS VARCHAR), 16, '0') AS parent_span_id,
         name, service, start_ns, end_ns, status, span AS seq, greatest(end_ns - start_ns, 0) AS dur FROM (
    SELECT o_orderkey AS trace, o_orderkey * 64 AS span, CAST(NULL AS BIGINT) AS parent, 'order' AS name, 'gateway' AS service, epoch_us(o_orderdate) * 1000 AS start_ns,
           epoch_us(o_orderdate) * 1000 + CAST(round(o_totalprice * 1000000.0) AS BIGINT) AS end_ns, CASE WHEN o_orderstatus = 'F' THEN 'Error' ELSE 'Ok' END AS status FROM orders
    UNION ALL
    SELECT l_orderkey, l_orderkey * 64 + rn, l_orderkey * 64 + greatest(rn - 3, 0), 'line', 'svc-' || CAST(l_suppkey % 6 AS VARCHAR), b,
           CASE WHEN l_linenumber = 7 THEN b - 1 ELSE b + CAST(round(l_extendedprice * 1000000.0) AS BIGINT) END, CASE WHEN l_returnflag = 'R' THEN 'Error' ELSE 'Ok' END
    FROM (SELECT *, epoch_us(o_orderdate) * 1000 + CAST(l_linenumber AS BIGINT) * 1000000000 AS b FROM (
            SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem
          ) JOIN orders ON l_orderkey = o_orderkey)
  ))"""
LOGS_SQL = f"""logs AS (SELECT epoch_us(ts) * 1000 AS ts_ns, {_SEVERITY} AS severity, CASE {_SEVERITY} {" ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SEVERITIES))} END AS severity_num,
  props AS body, lpad(CAST(event_id AS VARCHAR), 32, '0') AS trace_id, event_id AS seq FROM events)"""
