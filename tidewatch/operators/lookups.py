"""Lookups and lists over spans and logs: each is a pushed-down filter, a join on trace_id, or a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import DEFAULT_WINDOW_NS
from ..store import Store


def is_root() -> Column:
    return F.col("parent_span_id").isNull()


def is_correlated() -> Column:
    """Logs that belong to a trace."""
    return F.col("trace_id").isNotNull()


def window_ns(store: Store, start_ns: int | None = None, end_ns: int | None = None) -> tuple[int, int]:
    """The default window: five minutes up to the latest time; a start alone or an end alone is kept."""
    end = store.latest_ns if end_ns is None else end_ns
    return (max(end - DEFAULT_WINDOW_NS, 0) if start_ns is None else start_ns), end


def valid_trace_id(text: str) -> str:
    """The id in lower case; upper case is accepted."""
    if len(text) != 32 or any(c not in "0123456789abcdefABCDEF" for c in text):
        raise ValueError("invalid trace id")
    return text.lower()


def trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id).orderBy("start_ns", "seq")


def roots_between(spans: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return spans.where(is_root() & F.col("start_ns").between(start_ns, end_ns))


def logs_of_trace(logs: DataFrame, trace_id: str) -> DataFrame:
    return logs.where(F.col("trace_id") == trace_id).orderBy("seq")


def logs_between(logs: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return logs.where(F.col("ts_ns").between(start_ns, end_ns))


def span_view(spans: DataFrame) -> DataFrame:
    return spans.select("span_id", "parent_span_id", "name", F.coalesce("service", F.lit("?")).alias("service"), "kind", "status", "start_ns", X.duration_ms(F.col("start_ns"), F.col("end_ns")).alias("duration_ms"), "attributes")


def log_view(logs: DataFrame) -> DataFrame:
    return logs.select(F.col("ts_ns").alias("timestamp_ns"), "severity", "body", F.coalesce("service", F.lit("?")).alias("service"), "trace_id", "span_id")


def trace_list(store: Store, start_ns: int | None = None, end_ns: int | None = None, limit: int = 50) -> DataFrame:
    """Root spans of the window, the longest first."""
    rows = roots_between(store.spans, *window_ns(store, start_ns, end_ns))
    rows = rows.select(
        "trace_id", F.col("name").alias("operation"), F.coalesce("service", F.lit("?")).alias("service"), X.duration_ms(F.col("start_ns"), F.col("end_ns")).alias("duration_ms"),
        "start_ns", (F.col("status") == "Error").alias("failed"), "seq",
    )
    return rows.orderBy(F.desc("duration_ms"), "seq").limit(limit).drop("seq")


def trace_detail(store: Store, trace_id: str) -> tuple[DataFrame, DataFrame]:
    """(spans, logs) of one trace; an unknown trace has neither."""
    trace_id = valid_trace_id(trace_id)
    return span_view(trace(store.spans, trace_id)), log_view(logs_of_trace(store.logs, trace_id))


def log_list(store: Store, start_ns: int | None = None, end_ns: int | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """Logs of the window from a severity on, the newest first; an unknown severity filters nothing."""
    rows = logs_between(store.logs, *window_ns(store, start_ns, end_ns))
    rank = X.severity_rank(severity)
    if rank is not None:
        rows = rows.where(F.col("severity_num") >= rank)
    return log_view(rows.orderBy(F.desc("ts_ns"), "seq").limit(limit))


def spans_with_logs(store: Store) -> DataFrame:
    """Every log next to each span of its trace."""
    return store.spans.select("trace_id", "span_id", "name").join(store.logs.where(is_correlated()).select("trace_id", "ts_ns", "severity", "body", F.col("seq").alias("log_seq")), "trace_id")
