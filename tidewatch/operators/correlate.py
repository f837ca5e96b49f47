"""From a time window to causes: slowest traces, the span that took the time in each, and error logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..model import SEVERITIES
from ..store import Store
from .lookups import log_view, roots_between

ERROR = SEVERITIES.index("Error")


def self_times(spans: DataFrame) -> DataFrame:
    """spans with dur_ns and self_ns, the duration without that of the direct children, not under 0. Children are summed
    before the join, so a span with very many children is one row."""
    timed = spans.withColumn("dur_ns", X.duration_ns(F.col("start_ns"), F.col("end_ns")))
    children = timed.where("parent_span_id IS NOT NULL").groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.sum("dur_ns").alias("children_ns"))
    joined = timed.join(children, ["trace_id", "span_id"], "left")
    return joined.withColumn("self_ns", F.greatest(F.col("dur_ns") - F.coalesce("children_ns", F.lit(0)), F.lit(0).cast("bigint"))).drop("children_ns")


def bottlenecks(spans: DataFrame) -> DataFrame:
    """(trace_id, service, name, dur_ns, self_ns) of the span with the largest self time of each trace; of equals the last
    by start and arrival. A partial maximum, not a sort of each trace."""
    best = F.max_by(F.struct(F.coalesce("service", F.lit("?")).alias("service"), "name", "dur_ns", "self_ns"), F.struct("self_ns", "start_ns", "seq"))
    return self_times(spans).groupBy("trace_id").agg(best.alias("b")).select("trace_id", "b.service", "b.name", "b.dur_ns", "b.self_ns")


def slowest_roots(spans: DataFrame, start_ns: int, end_ns: int, top: int) -> DataFrame:
    roots = roots_between(spans, start_ns, end_ns).withColumn("dur_ns", X.duration_ns(F.col("start_ns"), F.col("end_ns")))
    return roots.orderBy(F.desc("dur_ns"), "seq").limit(top)


def explain(store: Store, start_ns: int, end_ns: int, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(slowest, error_logs): the slowest root spans of the window with the bottleneck of their traces, and the error logs
    of these traces by rank. The bottleneck is chosen by self time and reported with its whole duration."""
    roots = slowest_roots(store.spans, start_ns, end_ns, top)
    order = F.row_number().over(Window.orderBy(F.desc("dur_ns"), "seq"))  # over ``top`` rows
    ranked = roots.select("trace_id", F.col("name").alias("root_op"), "dur_ns", "status", "seq", order.alias("rank")).withColumnRenamed("dur_ns", "root_ns")
    worst = bottlenecks(store.spans.join(ranked.select("trace_id").distinct(), "trace_id", "left_semi"))
    slowest = ranked.join(worst, "trace_id").select(
        "rank", "trace_id", "root_op", (F.col("root_ns") / 1e6).alias("duration_ms"), (F.col("status") == "Error").alias("failed"),
        F.col("service").alias("bottleneck_service"), F.col("name").alias("bottleneck_op"), (F.col("dur_ns") / 1e6).alias("bottleneck_ms"),
    )
    logs = store.logs.where(F.col("severity_num") >= ERROR).withColumnRenamed("seq", "log_seq").join(ranked.select("trace_id", "rank"), "trace_id")
    return slowest.orderBy("rank"), log_view(logs.orderBy("rank", "log_seq"))


def waterfall(spans: DataFrame, width: int = 36) -> DataFrame:
    """Each span's bar (offset, size) against the first root of its trace."""
    return placed(spans, width).select("trace_id", "span_id", "offset", "size")


def placed(spans: DataFrame, width: int = 36) -> DataFrame:
    """spans with their bars; those of traces without a root have none and are left out."""
    first = F.min_by(F.struct("start_ns", F.greatest(X.duration_ns(F.col("start_ns"), F.col("end_ns")), F.lit(1).cast("bigint")).alias("total")), F.struct("start_ns", "seq"))
    roots = spans.where("parent_span_id IS NULL").groupBy("trace_id").agg(first.alias("root"))
    share = lambda x: x / F.col("root.total") * width
    rows = spans.join(roots, "trace_id")
    rows = rows.withColumn("offset", F.least(F.floor(share(X.duration_ns(F.col("root.start_ns"), F.col("start_ns")))), F.lit(width - 1)))
    size = F.greatest(F.least(F.round(share(X.duration_ns(F.col("start_ns"), F.col("end_ns")))), width - F.col("offset")), F.lit(1))
    return rows.withColumn("size", size.cast("int")).withColumn("offset", F.col("offset").cast("int")).drop("root")


def service_edges(spans: DataFrame) -> DataFrame:
    """Calls between services, from parents and children in the same trace."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.coalesce("service", F.lit("?")).alias("caller"))
    rows = spans.select("trace_id", "parent_span_id", F.coalesce("service", F.lit("?")).alias("callee")).join(parents, ["trace_id", "parent_span_id"])
    return rows.groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("calls"))
