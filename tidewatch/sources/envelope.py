"""The signal envelope: one JSON object a line, told apart by ``signal``; parsed once and routed to three tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import severity_number, text_attribute
from ..model import LOGS, METRICS, SERVICE_NAME, SPANS
from ..store import Store, with_series_id

SCHEMA = """signal string, name string, kind string, labels map<string,string>, sample struct<timestamp bigint, value double>,
trace_id string, span_id string, parent_span_id string, start bigint, end bigint, status string, attributes map<string,variant>, resource map<string,variant>,
timestamp bigint, severity string, body string"""


def parsed(lines: DataFrame, column: str = "value", seq: str | None = None) -> DataFrame:
    """The envelope's columns with ``seq``, the order of arrival (by default that of the rows)."""
    order = F.col(seq) if seq else F.monotonically_increasing_id()
    return lines.select(F.from_json(F.col(column), SCHEMA).alias("s"), order.alias("seq")).where("s.signal IS NOT NULL").select("s.*", "seq")


def _pascal(c):
    return F.initcap(c)


def metrics(signals: DataFrame) -> DataFrame:
    rows = signals.where("signal = 'metric'").select("name", _pascal("kind").alias("kind"), F.coalesce("labels", F.from_json(F.lit("{}"), "map<string,string>")).alias("labels"), F.expr("sample.timestamp div 1000000").alias("ts_ms"), F.col("sample.value").alias("value"), "seq")
    return with_series_id(rows).select(*METRICS.names)


def spans(signals: DataFrame) -> DataFrame:
    rows = signals.where("signal = 'span'").withColumns({"start_ns": F.col("start"), "end_ns": F.col("end"), "kind": _pascal("kind"), "status": _pascal("status"), "service": text_attribute(F.col("resource"), SERVICE_NAME)})
    return rows.select(*SPANS.names)


def logs(signals: DataFrame) -> DataFrame:
    rows = signals.where("signal = 'log'").withColumns({"ts_ns": F.col("timestamp"), "severity_num": severity_number(F.col("severity")), "severity": _pascal("severity"), "service": text_attribute(F.col("resource"), SERVICE_NAME)})
    return rows.select(*LOGS.names)


def store(signals: DataFrame, latest: int | None = None) -> Store:
    return Store(metrics(signals), spans(signals), logs(signals), latest=latest)


def metric_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit("metric").alias("signal"), "name", F.lower("kind").alias("kind"), "labels", F.struct((F.col("ts_ms") * 1_000_000).alias("timestamp"), "value").alias("sample"))).alias("value"), "seq")


def span_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit("span").alias("signal"), "trace_id", "span_id", "parent_span_id", "name", F.lower("kind").alias("kind"), F.col("start_ns").alias("start"), F.col("end_ns").alias("end"), F.lower("status").alias("status"), "attributes", "resource")).alias("value"), "seq")


def log_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit("log").alias("signal"), F.col("ts_ns").alias("timestamp"), F.lower("severity").alias("severity"), "body", "attributes", "resource", "trace_id", "span_id")).alias("value"), "seq")
