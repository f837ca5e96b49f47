"""The fixed analytical views: store statistics, services, anomaly report, and JSON forms of results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..functions import exprs as X
from ..plans import compiler, language
from ..store import Store
from . import codec, correlate, detectors
from .lookups import is_correlated, roots_between

SERVICE_WINDOW_NS = 60 * 1_000_000_000


def store_stats(store: Store) -> DataFrame:
    """One row: counts, encoded bytes of the samples, what 16 bytes a sample would take, their ratio (0 for nothing), and the
    latest time."""
    sizes = codec.encoded_sizes(store.metrics)
    m = sizes.agg(F.count(F.lit(1)).alias("series"), F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("metric_bytes"))
    s = store.spans.agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("trace_id").alias("traces"))
    g = store.logs.agg(F.count(F.lit(1)).alias("logs"))
    row = m.crossJoin(s).crossJoin(g)  # one row each
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.try_divide(a.cast("double"), b.cast("double")))
    raw = F.col("samples") * 16
    return row.withColumns({"raw_metric_bytes": raw, "compression_ratio": ratio(raw, F.col("metric_bytes")), "bytes_per_sample": ratio(F.col("metric_bytes"), F.col("samples")), "latest_ns": F.lit(store.latest_ns).cast("long")})


def services(store: Store, latest_ns: int | None = None) -> DataFrame:
    """Calls, rate, error rate and nearest-rank percentiles of every service over the traces whose root started in the last
    minute. A trace with two such roots counts twice."""
    end = store.latest_ns if latest_ns is None else latest_ns
    roots = roots_between(store.spans, max(end - SERVICE_WINDOW_NS, 0), end).select("trace_id")
    spans = store.spans.join(roots, "trace_id")
    named = spans.select(F.coalesce("service", F.lit("?")).alias("service"), X.duration_ms(F.col("start_ns"), F.col("end_ns")).alias("ms"), (F.col("status") == "Error").alias("failed"))
    calls = named.groupBy("service").agg(F.count(F.lit(1)).alias("calls"), F.count_if("failed").alias("errors"))
    ranks = X.nearest_ranks(named, ["service"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).drop("n")
    rates = [(F.col("calls") / (SERVICE_WINDOW_NS / 1e9)).alias("rps"), (F.col("errors") / F.col("calls")).alias("error_rate")]
    return calls.join(ranks, "service").select("service", "calls", *rates, "p50", "p95", "p99").orderBy("service")


def percentile_report(store: Store, metric: str, label: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles of all samples of a metric with the label; zeros for no samples."""
    rows = compiler.matching(store.metrics, language.Select(metric, ((label, "=", value),)))
    names = {f"p{q * 100:g}".replace(".", "_"): q for q in quantiles}
    found = X.nearest_ranks(rows.select(F.lit(0).alias("_g"), "value"), ["_g"], "value", names)
    return found.agg(*(F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in names))


def report_points(store: Store, metric: str, label: str, value: str, pooled: bool = True) -> DataFrame:
    """The samples a report looks at, as one series in order of time and arrival, or each series by itself."""
    rows = compiler.matching(store.metrics, language.Select(metric, ((label, "=", value),)))
    return rows.select((F.lit(0).cast("bigint") if pooled else F.col("series_id")).alias("series_id"), "ts_ms", "seq", "value")


def anomaly_report(store: Store, metric: str = "http_request_duration_ms", value: str = "200", label: str = "status", pooled: bool = True) -> dict[str, object]:
    """Counts of three detectors (one row), the first change point, and what explains it, as DataFrames; the last are None
    without a change point. Only the change point comes to the driver."""
    points = report_points(store, metric, label, value, pooled)
    counts = points.agg(F.count(F.lit(1)).alias("points"))
    found = {n: detectors.detect(points, n) for n in ("ewma", "cusum")} | {"mad": detectors.mad(points)}
    for n in ("ewma", "mad", "cusum"):
        counts = counts.crossJoin(found[n].agg(F.count(F.lit(1)).alias(n)))  # one row each
    change = found["cusum"].orderBy("timestamp_ms", "series_id").limit(1)
    at = change.select("timestamp_ms").first()
    slowest = errors = None
    if at:
        slowest, errors = correlate.explain(store, max(at[0] - 200, 0) * 1_000_000, (at[0] + 1500) * 1_000_000, 5)
    return {"counts": counts, "changepoint": change, "slowest": slowest, "error_logs": errors}


def anomaly_document(store: Store, metric: str = "http_request_duration_ms", value: str = "200", label: str = "status") -> dict[str, object]:
    """The report as one object: metric, label's value, points, counts of the detectors, the first change point and its cause
    (both None without one). Only the counts, the change point and the five slowest traces come to the driver; the error logs
    stay a DataFrame of JSON texts."""
    found = anomaly_report(store, metric, value, label)
    counts = found["counts"].first().asDict()
    points = counts.pop("points")
    change = found["changepoint"].select("timestamp_ms", "observed", "expected", "score").first()
    cause = None
    if change:
        slowest = [r.asDict() for r in found["slowest"].drop("rank").withColumnRenamed("root_op", "operation").collect()]
        cause = {"slowest": slowest, "error_logs": rows_json(found["error_logs"])}
    return {"metric": metric, label: value, "points": points, "detectors": counts, "changepoint": change and change.asDict(), "cause": cause}


def terminal(spans: DataFrame, logs: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(trace_id, part, place, line): each trace as text. Part 0 is its header, from its first root; 1 the spans with their bars;
    2 the logs; 3 one line for each sample of ``metrics``, which has to carry a trace_id. Place orders the lines of a part."""
    ns = X.duration_ns(F.col("start_ns"), F.col("end_ns"))
    first = F.min_by(F.struct(ns.alias("ns"), (F.col("status") == "Error").alias("failed")), F.struct("start_ns", "seq")).alias("r")
    heads = spans.where("parent_span_id IS NULL").groupBy("trace_id").agg(first)
    line = lambda rows, part, text: rows.select("trace_id", F.lit(part).alias("part"), F.col("seq").alias("place"), text.alias("line"))
    header = line(heads.withColumn("seq", F.lit(0).cast("bigint")), 0, display.header_line(F.col("trace_id"), F.col("r.ns"), F.col("r.failed")))
    drawn = correlate.placed(spans)
    bars = line(drawn, 1, display.span_line(F.coalesce("service", F.lit("?")), F.col("offset"), F.col("size"), ns))
    said = line(logs.where(is_correlated()).join(heads.select("trace_id"), "trace_id", "left_semi"), 2, display.log_line(F.col("severity_num"), F.col("body")))
    out = header.unionByName(bars).unionByName(said)
    if metrics is not None:
        out = out.unionByName(line(metrics, 3, F.concat(F.lit("  ▸ "), display.metric_text(F.col("name"), F.col("labels"), F.col("value")))))
    return out


def result_json(result: DataFrame | float) -> object:
    """A query's result in wire form: a dict for a number, a DataFrame of JSON samples for a vector; NaN and infinities are
    null. ``wire`` makes one object of either."""
    finite = lambda v: F.when(F.isnan(v) | (F.abs(v) == X.INF), None).otherwise(v)
    if isinstance(result, DataFrame):
        return result.select(F.to_json(F.struct("labels", finite(F.col("value")).alias("value")), {"ignoreNullFields": "false"}).alias("sample"))
    return {"type": "scalar", "value": result if abs(result) < X.INF else None}


def wire(result: DataFrame | float) -> dict[str, object]:
    """The whole result as one object, samples in the order of their labels: for an answer to a client, which has to hold it."""
    if not isinstance(result, DataFrame):
        return result_json(result)
    rows = result_json(result.orderBy(X.labels_text(F.col("labels")))).collect()
    return {"type": "vector", "samples": [json.loads(r["sample"]) for r in rows]}


def run_query(store: Store, text: str, at_ns: int | None = None) -> dict[str, object]:
    """{query, plan, result} or {query, error}."""
    try:
        node = language.plan(text)
        return {"query": text, "plan": language.explain(node), "result": compiler.compiled(node, store, store.latest_ns if at_ns is None else at_ns)}
    except language.QueryError as e:
        return {"query": text, "error": str(e)}


def first_value(result: DataFrame | float) -> float | None:
    """A number, or the value of a vector's first sample by labels."""
    if not isinstance(result, DataFrame):
        return result
    row = result.orderBy(X.labels_text(F.col("labels"))).select("value").first()
    return row and row[0]


def rows_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
