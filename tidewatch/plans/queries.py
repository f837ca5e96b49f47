"""The queries of this library over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display
from ..functions import exprs as X
from ..operators import codec, correlate, detectors, lookups, views
from ..sources import driver_tables as D
from ..sources import envelope, otlp, simulator
from ..store import scratch, with_series_id
from ..streaming import live
from . import compiler, language

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _flat(result: DataFrame, *labels: str, digits: int = 6) -> DataFrame:
    return result.select(*(F.col("labels")[k].alias(k) for k in labels), F.round("value", digits).alias("value"))


def _register(name: str, text: str, labels: tuple[str, ...], sql: str, digits: int = 6) -> None:
    """A query of the language at the time of the last event."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(compiler.query(D.store(spark, sf_dir), text, D.last_event_ns(spark, sf_dir)), *labels, digits=digits)

    run.__name__, run.__doc__ = name, text
    QUERIES[name], SQL[name] = run, sql


_BOTH = ("event_type", "bucket")
_M = f"WITH {D.M_SQL}, e AS (SELECT max(ts_ms) AS upto FROM m), s AS (SELECT DISTINCT event_type, bucket FROM m)"
_CTR = f"WITH {D.CTR_SQL}, e AS (SELECT max(ts_ms) AS upto FROM ctr), s AS (SELECT DISTINCT event_type FROM ctr)"
_DAY, _HOUR = 86_400_000, 3_600_000


def _over(value: str, ms: int) -> str:
    return f"{_M} SELECT event_type, bucket, round({value}, 6) AS value FROM m, e WHERE ts_ms BETWEEN upto - {ms} AND upto GROUP BY event_type, bucket"


def _over_kept(value: str, ms: int) -> str:
    return f"""{_M}, v AS (SELECT event_type, bucket, {value} AS value FROM m, e WHERE ts_ms BETWEEN upto - {ms} AND upto GROUP BY event_type, bucket)
SELECT s.event_type, s.bucket, round(coalesce(value, 0.0), 6) AS value FROM s LEFT JOIN v ON s.event_type = v.event_type AND s.bucket = v.bucket"""


_register("instant_last", "event_value", _BOTH, f"{_M} SELECT event_type, bucket, round(arg_max(value, seq), 6) AS value FROM m GROUP BY event_type, bucket")
_register(
    "matcher_eq_ne", 'event_value{event_type="click", bucket!="0"}', _BOTH,
    f"{_M} SELECT event_type, bucket, round(arg_max(value, seq), 6) AS value FROM m WHERE event_type = 'click' AND bucket <> '0' GROUP BY event_type, bucket",
)
_register("matcher_absent_label", 'events_total{bucket!="1"}', ("event_type",), f"{_CTR} SELECT event_type, arg_max(value, seq) AS value FROM ctr GROUP BY event_type")
_register("count_over_time", "count_over_time(event_value[31d])", _BOTH, _over_kept("CAST(count(*) AS DOUBLE)", 31 * _DAY))
_register("sum_over_time", "sum_over_time(event_value[31d])", _BOTH, _over_kept("sum(value)", 31 * _DAY))
_register("empty_series", "count_over_time(event_value[1h])", _BOTH, _over_kept("CAST(count(*) AS DOUBLE)", _HOUR))  # most have no sample in it
_register("avg_over_time", "avg_over_time(event_value[31d])", _BOTH, _over("avg(value)", 31 * _DAY))
_register("min_over_time", "min_over_time(event_value[31d])", _BOTH, _over("min(value)", 31 * _DAY))
_register("max_over_time", "max_over_time(event_value[31d])", _BOTH, _over("max(value)", 31 * _DAY))
_register("quantile_over_time", "quantile_over_time(0.95, event_value[31d])", _BOTH, _over("quantile_cont(value, 0.95)", 31 * _DAY))


def _counted(select: str) -> str:
    return f"""{_CTR}, w AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts_ms, seq) AS last FROM ctr, e WHERE ts_ms BETWEEN upto - {31 * _DAY} AND upto),
g AS (SELECT event_type, sum(CASE WHEN last IS NULL THEN 0 WHEN value >= last THEN value - last ELSE value END) AS grown, (max(ts_ms) - min(ts_ms)) / 1000.0 AS secs, count(*) AS n FROM w GROUP BY event_type)
{select}"""


_register("increase", "increase(events_total[31d])", ("event_type",), _counted("SELECT s.event_type, round(coalesce(grown, 0.0), 6) AS value FROM s LEFT JOIN g ON s.event_type = g.event_type"))
_register("rate", "rate(events_total[31d])", ("event_type",), _counted("SELECT event_type, round(grown / secs, 9) AS value FROM g WHERE n >= 2 AND secs > 0"), digits=9)

_COUNTS = f"{_M}, c AS (SELECT event_type, bucket, CAST(count(*) AS DOUBLE) AS v FROM m, e WHERE ts_ms BETWEEN upto - {31 * _DAY} AND upto GROUP BY event_type, bucket)"
_AVERAGES = f"{_M}, c AS (SELECT event_type, bucket, avg(value) AS v FROM m, e WHERE ts_ms BETWEEN upto - {31 * _DAY} AND upto GROUP BY event_type, bucket)"
_register("agg_sum_by", "sum by (event_type) (count_over_time(event_value[31d]))", ("event_type",), f"{_COUNTS} SELECT event_type, sum(v) AS value FROM c GROUP BY event_type")
_register("agg_avg_without", "avg without (event_type) (avg_over_time(event_value[31d]))", ("bucket",), f"{_AVERAGES} SELECT bucket, round(avg(v), 6) AS value FROM c GROUP BY bucket")
_register("agg_min", "min(avg_over_time(event_value[31d]))", (), f"{_AVERAGES} SELECT round(min(v), 6) AS value FROM c")
_register("agg_max", "max by (bucket) (avg_over_time(event_value[31d]))", ("bucket",), f"{_AVERAGES} SELECT bucket, round(max(v), 6) AS value FROM c GROUP BY bucket")
_register("agg_count", "count without (bucket) (event_value)", ("event_type",), f"{_M} SELECT event_type, CAST(count(*) AS DOUBLE) AS value FROM s GROUP BY event_type")
_register("agg_quantile", "quantile by (bucket) (0.5, avg_over_time(event_value[31d]))", ("bucket",), f"{_AVERAGES} SELECT bucket, round(quantile_cont(v, 0.5), 6) AS value FROM c GROUP BY bucket")
_register("arith_vector_scalar", "avg_over_time(event_value[31d]) / 1000 + 2 * 3", _BOTH, f"{_AVERAGES} SELECT event_type, bucket, round(v / 1000 + 6, 6) AS value FROM c")
_register("arith_scalar_vector", "1000 - avg_over_time(event_value[31d]) * 2", _BOTH, f"{_AVERAGES} SELECT event_type, bucket, round(1000 - v * 2, 6) AS value FROM c")
_register("neg", "-avg_over_time(event_value[31d])", _BOTH, f"{_AVERAGES} SELECT event_type, bucket, round(-v, 6) AS value FROM c")


@query("SELECT 'inf' AS zero_divisor, CAST(7.0 AS DOUBLE) AS value")
def arith_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of numbers only is a number."""
    store = D.store(spark, sf_dir)
    return spark.createDataFrame([(str(compiler.query(store, "1 / 0", 0)), compiler.query(store, "1 + 2 * 3", 0))], "zero_divisor string, value double")


# Spans and logs. The windows hold all orders and events.
_SPANS = f"WITH {D.SPANS_SQL}, r AS (SELECT * FROM spans WHERE parent_span_id IS NULL), e AS (SELECT max(start_ns) AS upto FROM r)"
_SPAN_WINDOW, _LOG_WINDOW = 4000 * _DAY * 1_000_000, 31 * _DAY * 1_000_000


def _last_order_ns(spark: SparkSession, sf_dir: str) -> int:
    return D.read(spark, sf_dir, "orders").agg(F.max(D.ns_of("o_orderdate"))).first()[0] or 0


@query(
    f"""{_SPANS} SELECT trace_id, name AS operation, service, dur / 1e6 AS duration_ms, start_ns, status = 'Error' AS failed FROM r, e
WHERE start_ns BETWEEN upto - {_SPAN_WINDOW} AND upto ORDER BY dur DESC, seq LIMIT 50"""
)
def trace_list_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = _last_order_ns(spark, sf_dir)
    return lookups.trace_list(D.store(spark, sf_dir), end - _SPAN_WINDOW, end, 50)


_TRACE = "0" * 31 + "7"


@query(f"{_SPANS} SELECT span_id, parent_span_id, name, 'Internal' AS kind, service, status, start_ns, dur / 1e6 AS duration_ms FROM spans WHERE trace_id = '{_TRACE}'")
def trace_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.trace_detail(D.store(spark, sf_dir), _TRACE)[0].drop("attributes")  # null here


@query(f"WITH {D.LOGS_SQL} SELECT ts_ns AS timestamp_ns, severity, 'events' AS service, body, trace_id, CAST(NULL AS VARCHAR) AS span_id FROM logs WHERE trace_id = '{_TRACE}'")
def trace_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.trace_detail(D.store(spark, sf_dir), _TRACE)[1]


@query(
    f"""WITH {D.SPANS_SQL}, {D.LOGS_SQL} SELECT severity, count(*) AS pairs, count(DISTINCT s.trace_id) AS traces FROM spans s JOIN logs g ON s.trace_id = g.trace_id GROUP BY severity"""
)
def spans_join_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.spans_with_logs(D.store(spark, sf_dir)).groupBy("severity").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("trace_id").alias("traces"))


@query(
    f"""WITH {D.LOGS_SQL}, e AS (SELECT max(ts_ns) AS upto FROM logs) SELECT ts_ns AS timestamp_ns, severity, 'events' AS service, body, trace_id, CAST(NULL AS VARCHAR) AS span_id FROM logs, e
WHERE ts_ns BETWEEN upto - {_LOG_WINDOW} AND upto AND severity_num >= 3 ORDER BY ts_ns DESC, seq LIMIT 100"""
)
def log_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = D.last_event_ns(spark, sf_dir)
    return lookups.log_list(D.store(spark, sf_dir), end - _LOG_WINDOW, end, "WARN", 100)


@query(
    f"""{_SPANS}, w AS (SELECT s.* FROM r JOIN e ON r.start_ns BETWEEN upto - 60000000000 AND upto JOIN spans s ON s.trace_id = r.trace_id),
g AS (SELECT service, count(*) AS calls, count(*) FILTER (status = 'Error') AS errors, list_sort(list(dur / 1e6)) AS d FROM w GROUP BY service)
SELECT service, calls, round(calls / 60.0, 6) AS rps, round(errors / calls, 6) AS error_rate, round(d[CAST(round(0.5 * (calls - 1)) AS BIGINT) + 1], 6) AS p50,
round(d[CAST(round(0.95 * (calls - 1)) AS BIGINT) + 1], 6) AS p95, round(d[CAST(round(0.99 * (calls - 1)) AS BIGINT) + 1], 6) AS p99 FROM g"""
)
def service_red(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.services(D.store(spark, sf_dir), _last_order_ns(spark, sf_dir))
    return rows.select("service", "calls", *(F.round(c, 6).alias(c) for c in ("rps", "error_rate", "p50", "p95", "p99")))


@query(
    f"""{_SPANS}, k AS (SELECT trace_id, parent_span_id, sum(dur) AS kids FROM spans WHERE parent_span_id IS NOT NULL GROUP BY ALL)
SELECT s.trace_id, s.span_id, CAST(greatest(dur - coalesce(kids, 0), 0) AS BIGINT) AS self_ns FROM spans s LEFT JOIN k ON s.trace_id = k.trace_id AND s.span_id = k.parent_span_id"""
)
def self_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.self_times(D.store(spark, sf_dir).spans).select("trace_id", "span_id", "self_ns")


_WORST = """k AS (SELECT trace_id, parent_span_id, sum(dur) AS kids FROM spans WHERE parent_span_id IS NOT NULL GROUP BY ALL),
t AS (SELECT s.*, greatest(dur - coalesce(kids, 0), 0) AS own FROM spans s LEFT JOIN k ON s.trace_id = k.trace_id AND s.span_id = k.parent_span_id),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY own DESC, start_ns DESC, seq DESC) = 1)"""


@query(f"{_SPANS}, {_WORST} SELECT trace_id, service, name, CAST(dur AS BIGINT) AS dur_ns, CAST(own AS BIGINT) AS self_ns FROM b")
def bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.bottlenecks(D.store(spark, sf_dir).spans)


_TOP = f"top AS (SELECT *, row_number() OVER (ORDER BY dur DESC, seq) AS rank FROM r, e WHERE start_ns BETWEEN upto - {_SPAN_WINDOW} AND upto QUALIFY rank <= 5)"


@query(
    f"""{_SPANS}, {_WORST}, {_TOP} SELECT CAST(rank AS INTEGER) AS rank, top.trace_id, top.name AS root_op, top.dur / 1e6 AS duration_ms, top.status = 'Error' AS failed,
b.service AS bottleneck_service, b.name AS bottleneck_op, b.dur / 1e6 AS bottleneck_ms FROM top JOIN b ON top.trace_id = b.trace_id"""
)
def explain_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = _last_order_ns(spark, sf_dir)
    return correlate.explain(D.store(spark, sf_dir), end - _SPAN_WINDOW, end, 5)[0]


@query(
    f"""WITH {D.SPANS_SQL}, {D.LOGS_SQL}, r AS (SELECT * FROM spans WHERE parent_span_id IS NULL), e AS (SELECT max(start_ns) AS upto FROM r), {_TOP.replace("rank <= 5", "rank <= 200")}
SELECT ts_ns AS timestamp_ns, severity, 'events' AS service, body, g.trace_id, CAST(NULL AS VARCHAR) AS span_id FROM top JOIN logs g ON top.trace_id = g.trace_id WHERE severity_num >= 4"""
)
def explain_error_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = _last_order_ns(spark, sf_dir)
    return correlate.explain(D.store(spark, sf_dir), end - _SPAN_WINDOW, end, 200)[1]


@query(
    f"""{_SPANS}, f AS (SELECT trace_id, arg_min(start_ns, seq) AS t0, greatest(arg_min(dur, seq), 1) AS total FROM r GROUP BY trace_id),
o AS (SELECT s.trace_id, span_id, dur, total, least(floor(greatest(start_ns - t0, 0) / total * 36), 35) AS o FROM spans s JOIN f ON s.trace_id = f.trace_id)
SELECT trace_id, span_id, CAST(o AS INTEGER) AS "offset", CAST(greatest(least(round(dur / total * 36), 36 - o), 1) AS INTEGER) AS size FROM o"""
)
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.waterfall(D.store(spark, sf_dir).spans)


_TENTHS = "lpad(CAST({0} // 10 AS VARCHAR) || '.' || CAST({0} % 10 AS VARCHAR), CAST(greatest(7, length(CAST({0} // 10 AS VARCHAR)) + 2) AS INTEGER), ' ') || 'ms'".format("((CAST({0} AS BIGINT) + 50000) // 100000)")
_SIGN = "CASE WHEN severity_num < 2 THEN '·' WHEN severity_num = 2 THEN 'ⓘ' WHEN severity_num = 3 THEN '▲' ELSE '✖' END"


@query(
    f"""WITH {D.SPANS_SQL}, {D.LOGS_SQL}, f AS (SELECT trace_id, arg_min(start_ns, seq) AS t0, greatest(arg_min(dur, seq), 1) AS total FROM spans WHERE parent_span_id IS NULL GROUP BY trace_id),
o AS (SELECT s.*, total, CAST(least(floor(greatest(start_ns - t0, 0) / total * 36), 35) AS BIGINT) AS o FROM spans s JOIN f ON s.trace_id = f.trace_id)
SELECT trace_id, 0 AS part, 0 AS place, '▶ trace ' || substr(trace_id, 1, 8) || '   ' || {_TENTHS.format("dur")} || '   ' || CASE WHEN status = 'Error' THEN '● FAIL' ELSE '● OK' END AS line FROM spans WHERE parent_span_id IS NULL
UNION ALL SELECT trace_id, 1, seq, '  ' || rpad(service, 16, ' ') || ' ' || repeat(' ', o) || repeat('█', CAST(greatest(least(round(dur / total * 36), 36 - o), 1) AS BIGINT)) || ' ' || {_TENTHS.format("dur")} FROM o
UNION ALL SELECT g.trace_id, 2, g.seq, '  ' || {_SIGN} || ' ' || body FROM logs g JOIN f ON f.trace_id = g.trace_id"""
)
def terminal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trace as the lines of a terminal: header, waterfall, logs."""
    store = D.store(spark, sf_dir)
    return views.terminal(store.spans, store.logs)


@query(f"{_SPANS} SELECT p.service AS caller, c.service AS callee, count(*) AS calls FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id GROUP BY ALL")
def service_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.service_edges(D.store(spark, sf_dir).spans)


@query(f"{_SPANS} SELECT 'request' AS kind, trace_id, name AS route, CASE WHEN status = 'Error' THEN 500 ELSE 200 END AS status, dur / 1e6 AS duration_ms, status = 'Error' AS failed, start_ns AS timestamp_ns FROM r")
def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.request_events(D.store(spark, sf_dir).spans)


@query(f"{_SPANS} SELECT max(start_ns) AS latest_ns FROM spans")
def latest_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.latest(D.store(spark, sf_dir).spans)


# Detectors: one series for each event type, in order of time.
def _typed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.gauges(D.read(spark, sf_dir, "events").withColumn("_ns", D.ns_of("ts")))
    return with_series_id(events.withColumn("labels", F.map_filter("labels", lambda k, _: k == "event_type")))


def _detected(points: DataFrame, found: DataFrame) -> DataFrame:
    names = points.select("series_id", F.col("labels")["event_type"].alias("event_type")).distinct()
    return found.join(names, "series_id").select("event_type", "timestamp_ms", "observed", F.round("expected", 6).alias("expected"), F.round("score", 6).alias("score"))


_P = f"WITH RECURSIVE {D.M_SQL}, p AS (SELECT event_type, ts_ms, value, row_number() OVER (PARTITION BY event_type ORDER BY ts_ms, seq) AS i FROM m)"
_FOUND = "SELECT event_type, ts_ms AS timestamp_ms, x AS observed, round(expected, 6) AS expected, round(score, 6) AS score"


@query(
    f"""{_P}, f AS (SELECT event_type, ts_ms, value AS x, i, list(value) OVER (PARTITION BY event_type ORDER BY i ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS base FROM p),
c AS (SELECT *, list_median(base) AS expected FROM f WHERE i > 40), z AS (SELECT *, list_median(list_transform(base, lambda v: abs(v - expected))) AS mad FROM c),
s AS (SELECT *, abs(0.6745 * (x - expected) / mad) AS score FROM z WHERE mad > 0) {_FOUND} FROM s WHERE score > 4"""
)
def mad_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _typed_points(spark, sf_dir)
    return _detected(points, detectors.mad(points))


@query(
    f"""{_P}, r AS (SELECT event_type, ts_ms, value AS x, i, value AS mean, 0.0::DOUBLE AS var, NULL::DOUBLE AS expected, NULL::DOUBLE AS score FROM p WHERE i = 1
UNION ALL SELECT p.event_type, p.ts_ms, p.value, p.i, r.mean + 0.05 * (p.value - r.mean), 0.95 * (r.var + 0.05 * (p.value - r.mean) * (p.value - r.mean)), r.mean,
CASE WHEN p.i > 30 AND r.var > 0 AND abs(p.value - r.mean) > 3.5 * sqrt(r.var) THEN abs(p.value - r.mean) / sqrt(r.var) END FROM r JOIN p ON p.event_type = r.event_type AND p.i = r.i + 1)
{_FOUND} FROM r WHERE score IS NOT NULL"""
)
def ewma_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _typed_points(spark, sf_dir)
    return _detected(points, detectors.detect(points, "ewma"))


@query(
    f"""{_P}, b AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS sd FROM p WHERE i <= 30 GROUP BY event_type),
r AS (SELECT p.event_type, p.ts_ms, p.value AS x, p.i, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo, mu AS expected, NULL::DOUBLE AS score FROM p JOIN b ON p.event_type = b.event_type WHERE i = 30 AND sd > 0
UNION ALL SELECT event_type, ts_ms, x, i, CASE WHEN c > 5 * sd THEN 0 ELSE h END, CASE WHEN c > 5 * sd THEN 0 ELSE l END, mu, CASE WHEN c > 5 * sd THEN c / (5 * sd) END FROM (
  SELECT p.event_type, p.ts_ms, p.value AS x, p.i, mu, sd, greatest(r.hi + (p.value - mu) - 0.5 * sd, 0) AS h, greatest(r.lo + (mu - p.value) - 0.5 * sd, 0) AS l, greatest(h, l) AS c
  FROM r JOIN p ON p.event_type = r.event_type AND p.i = r.i + 1 JOIN b ON b.event_type = p.event_type))
{_FOUND} FROM r WHERE score IS NOT NULL"""
)
def cusum_changepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _typed_points(spark, sf_dir)
    return _detected(points, detectors.detect(points, "cusum"))


@query(
    f"""{_P}, b AS (SELECT event_type, avg(value) FILTER (i <= 12) AS one, avg(value) FILTER (i > 12) AS two, list(value ORDER BY i) AS first FROM p WHERE i <= 24 GROUP BY event_type HAVING count(*) = 24),
r AS (SELECT event_type, 0::BIGINT AS ts_ms, 0::DOUBLE AS x, 12::BIGINT AS i, one AS level, (two - one) / 12 AS trend, list_transform(first[1:12], lambda v: v - one) AS season, 0::DOUBLE AS var, NULL::DOUBLE AS expected, NULL::DOUBLE AS score FROM b
UNION ALL SELECT event_type, ts_ms, x, i, up, 0.05 * (up - level) + 0.95 * trend, list_transform(season, lambda v, k: CASE WHEN k = slot THEN 0.3 * (x - up) + 0.7 * seasonal ELSE v END), 0.95 * var + 0.05 * (x - f) * (x - f), f,
CASE WHEN i > 24 AND var > 0 AND abs(x - f) > 4 * sqrt(var) THEN abs(x - f) / sqrt(var) END FROM (
  SELECT p.event_type, p.ts_ms, p.value AS x, p.i, r.level, r.trend, r.season, r.var, (p.i - 1) % 12 + 1 AS slot, r.season[(p.i - 1) % 12 + 1] AS seasonal, r.level + r.trend + seasonal AS f, 0.3 * (p.value - seasonal) + 0.7 * (r.level + r.trend) AS up
  FROM r JOIN p ON p.event_type = r.event_type AND p.i = r.i + 1))
{_FOUND} FROM r WHERE score IS NOT NULL"""
)
def holt_winters_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _typed_points(spark, sf_dir)
    return _detected(points, detectors.detect(points, "holt_winters"))


_REPORT = ", ".join(f"(SELECT count(*) FROM ({SQL[f'{d}']}) WHERE event_type = 'purchase') AS {n}" for n, d in (("ewma", "ewma_anomalies"), ("mad", "mad_anomalies"), ("cusum", "cusum_changepoints")))


@query(f"SELECT (SELECT count(*) FROM events WHERE event_type = 'purchase') AS points, {_REPORT}")
def anomaly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the three detectors over the pooled purchases."""
    return views.anomaly_report(D.store(spark, sf_dir), "event_value", "purchase", "event_type")["counts"]


@query(f"SELECT timestamp_ms, observed, expected, score FROM ({SQL['cusum_changepoints']}) WHERE event_type = 'purchase' ORDER BY timestamp_ms LIMIT 1")
def anomaly_changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first change point of the report, whose cause it explains."""
    found = views.anomaly_report(D.store(spark, sf_dir), "event_value", "purchase", "event_type")["changepoint"]
    return found.select("timestamp_ms", "observed", F.round("expected", 6).alias("expected"), F.round("score", 6).alias("score"))


@query(f"{_M} SELECT event_type, bucket, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(quantile_cont(value, 0.5), 6) AS median FROM m GROUP BY ALL")
def series_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, population deviation and median of every series."""
    points = D.store(spark, sf_dir).metrics.where("name = 'event_value'")
    v, labels = F.col("value"), F.col("labels")
    rows = points.groupBy("labels").agg(*(F.round(f(v), 6).alias(f.__name__) for f in (X.mean, X.stddev, X.median)))
    return rows.select(labels["event_type"].alias("event_type"), labels["bucket"].alias("bucket"), "mean", "stddev", "median")


@query(
    f"""{_M}, q AS (SELECT list_sort(list(value)) AS d, count(*) AS n FROM m WHERE event_type = 'purchase')
SELECT d[CAST(round(0.5 * (n - 1)) AS BIGINT) + 1] AS p50, d[CAST(round(0.95 * (n - 1)) AS BIGINT) + 1] AS p95, d[CAST(round(0.99 * (n - 1)) AS BIGINT) + 1] AS p99 FROM q"""
)
def percentile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.percentile_report(D.store(spark, sf_dir), "event_value", "event_type", "purchase")


@query(
    f"""WITH {D.M_SQL}, {D.SPANS_SQL} SELECT (SELECT count(*) FROM (SELECT DISTINCT event_type, bucket FROM m)) + (SELECT count(DISTINCT event_type) FROM m) AS series,
2 * (SELECT count(*) FROM m) AS samples, (SELECT count(*) FROM spans) AS spans, (SELECT count(DISTINCT trace_id) FROM spans) AS traces, (SELECT count(*) FROM events) AS logs,
32 * (SELECT count(*) FROM m) AS raw_metric_bytes, (SELECT max(start_ns) FROM spans) AS latest_ns"""
)
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.store_stats(D.store(spark, sf_dir)).select("series", "samples", "spans", "traces", "logs", "raw_metric_bytes", "latest_ns")


@query()
def encoded_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and bytes of each series in the codec."""
    return codec.encoded_sizes(D.store(spark, sf_dir).metrics)


@query(f"{_M} SELECT event_type, bucket, count(*) AS samples, round(sum(value), 6) AS total FROM m GROUP BY ALL")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gauge's samples encoded and decoded again."""
    events = D.gauges(D.read(spark, sf_dir, "events").withColumn("_ns", D.ns_of("ts")))
    labels = events.select("series_id", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["bucket"].alias("bucket")).distinct()
    back = codec.decoded(codec.encoded(events)).groupBy("series_id").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 6).alias("total"))
    return back.join(labels, "series_id").select("event_type", "bucket", "samples", "total")


@query(
    f"""{_M}, d AS (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY event_type, bucket ORDER BY ts_ms, seq) AS delta FROM m),
c AS (SELECT *, delta - coalesce(lag(delta) OVER (PARTITION BY event_type, bucket ORDER BY ts_ms, seq), 0) AS change FROM d)
SELECT event_type, bucket, CAST(sum(CASE WHEN delta IS NULL THEN 64 WHEN change = 0 THEN 1 WHEN change BETWEEN -64 AND 63 THEN 9 WHEN change BETWEEN -256 AND 255 THEN 12
WHEN change BETWEEN -2048 AND 2047 THEN 16 ELSE 68 END) AS BIGINT) AS bits FROM c GROUP BY event_type, bucket"""
)
def gorilla_ts_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.gauges(D.read(spark, sf_dir, "events").withColumn("_ns", D.ns_of("ts")))
    return codec.time_sizes(events).select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["bucket"].alias("bucket"), "bits")


@query(f"{_M} SELECT 'bucket=' || bucket || ',event_type=' || event_type AS labels, count(*) AS samples FROM m GROUP BY ALL")
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.gauges(D.read(spark, sf_dir, "events").withColumn("_ns", D.ns_of("ts")))
    return events.groupBy(X.labels_text(F.col("labels")).alias("labels")).agg(F.count(F.lit(1)).alias("samples"))


#: FNV-1a over the bytes of name, 0xff, then key = value 0x00 by key; the texts here are ASCII.
_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(bytes, lambda b: b::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::UHUGEINT)"
_BYTES = "list_transform(string_split({}, ''), lambda c: ascii(c))"


@query(
    f"""WITH {D.M_SQL}, s AS (SELECT DISTINCT 'event_value' AS name, 'bucket=' || bucket || ',event_type=' || event_type AS labels FROM m UNION ALL SELECT DISTINCT 'events_total', 'event_type=' || event_type FROM m),
t AS (SELECT name, labels, {_BYTES.format("name")} || [255] || flatten(list_transform(string_split(labels, ','), lambda x: {_BYTES.format("x")} || [0])) AS bytes FROM s),
h AS (SELECT name, labels, {_FNV} AS h FROM t)
SELECT name, labels, lpad(lower(to_hex(CAST(h AS UBIGINT))), 16, '0') AS series_id FROM h"""
)
def series_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published id of every series."""
    series = D.store(spark, sf_dir).series
    ids = series.withColumn("series_id", X.fnv_series_id(F.col("name"), F.col("labels")))
    return ids.withColumn("labels", X.labels_text(F.col("labels"))).select("name", "labels", "series_id")


@query(
    f"""WITH {D.SPANS_SQL}, {D.LOGS_SQL}, {D.M_SQL}, {D.CTR_SQL} SELECT 'metric' AS signal, count(*) AS n, CAST(round(sum(value), 4) AS DOUBLE) AS total
FROM (SELECT value FROM m UNION ALL SELECT value FROM ctr) UNION ALL SELECT 'span', count(*), CAST(count(*) FILTER (status = 'Error') AS DOUBLE) FROM spans
UNION ALL SELECT 'log', count(*), CAST(sum(severity_num) AS DOUBLE) FROM logs"""
)
def signal_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal written as an envelope line, parsed once and routed back to its table."""
    store = D.store(spark, sf_dir)
    lines = envelope.metric_lines(store.metrics).unionByName(envelope.span_lines(store.spans)).unionByName(envelope.log_lines(store.logs))
    back = envelope.store(envelope.parsed(lines, seq="seq"))
    count = lambda rows, name, total: rows.agg(F.lit(name).alias("signal"), F.count(F.lit(1)).alias("n"), total.cast("double").alias("total"))
    metrics = count(back.metrics, "metric", F.round(F.sum("value"), 4))
    return metrics.unionByName(count(back.spans, "span", F.count_if(F.col("status") == "Error"))).unionByName(count(back.logs, "log", F.sum("severity_num")))


@query(f"WITH {D.SPANS_SQL} SELECT trace_id, span_id, parent_span_id, name, 'Internal' AS kind, service, status, start_ns, end_ns, seq AS batch FROM spans")
def otlp_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span as an OTLP/JSON export of its own, decoded again."""
    text = lambda c: F.col(c).cast("string")
    attribute = lambda key, kind, value: F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))
    code = F.when(F.col("status") == "Error", 2).otherwise(1)
    one = F.struct(
        F.upper("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", F.lit(1).alias("kind"), text("start_ns").alias("startTimeUnixNano"), text("end_ns").alias("endTimeUnixNano"),
        F.struct(code.alias("code")).alias("status"), F.array(attribute("batch", "intValue", text("seq"))).alias("attributes"),
    )
    resource = F.struct(F.array(attribute("service.name", "stringValue", F.col("service"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(one).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    bodies = D.store(spark, sf_dir).spans.select(F.col("seq").alias("body_id"), F.lit("application/json").alias("content_type"), body.alias("body"))
    back = otlp.spans(bodies).withColumn("batch", X.int_attribute(F.col("attributes"), "batch"))
    return back.select("trace_id", "span_id", "parent_span_id", "name", "kind", "service", "status", "start_ns", "end_ns", "batch")


@query(
    f"""WITH {D.SPANS_SQL}, {D.LOGS_SQL}, {D.M_SQL}, {D.CTR_SQL} SELECT 'metrics' AS what, count(*) AS n, max(ts_ms) AS latest FROM (SELECT ts_ms FROM m UNION ALL SELECT ts_ms FROM ctr)
UNION ALL SELECT 'spans', count(*), max(start_ns) FROM spans UNION ALL SELECT 'logs', count(*), max(ts_ns) FROM logs UNION ALL SELECT 'events', count(*), max(start_ns) FROM spans WHERE parent_span_id IS NULL"""
)
def streamed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal landed as a line, streamed to its table, and the request events of the streamed spans published."""
    store = D.store(spark, sf_dir)
    lines = envelope.metric_lines(store.metrics).unionByName(envelope.span_lines(store.spans)).unionByName(envelope.log_lines(store.logs))
    with scratch(spark, "streamed") as base:
        lines.select("value").write.text(f"{base}/in")
        live.route(live.signal_lines(spark, f"{base}/in"), f"{base}/out").awaitTermination()
        back = live.store(spark, f"{base}/out")
        spans = spark.readStream.schema(back.spans.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out/spans")
        live.publish(spans, f"{base}/out").awaitTermination()
        told = spark.read.schema("value string").parquet(f"{base}/out/events").select(F.get_json_object("value", "$.timestamp_ns").cast("long").alias("at"))
        count = lambda rows, what, at: rows.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"), F.max(at).alias("latest"))
        parts = [count(back.metrics, "metrics", "ts_ms"), count(back.spans, "spans", "start_ns"), count(back.logs, "logs", "ts_ns"), count(told, "events", "at")]
        rows = [tuple(p.first()) for p in parts]
    return spark.createDataFrame(rows, "what string, n long, latest long")


@query(
    """SELECT event_id, event_type AS text, event_id AS whole, value AS fraction, event_id % 2 = 0 AS truth, 0 AS coerced, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '?' END AS service FROM events"""
)
def typed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of four types, each read as what it is; reads as another type give nothing."""
    events = D.read(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    values = {"text": F.col("event_type"), "whole": F.col("event_id"), "fraction": F.col("value"), "truth": even}
    variant = lambda c: c.cast("variant")
    rows = events.withColumn("a", F.create_map(*(x for k, c in values.items() for x in (F.lit(k), variant(c)))))
    rows = rows.withColumn("r", F.create_map(F.lit("service.name"), F.when(even, variant(F.col("event_type"))).otherwise(variant(F.col("event_id")))))
    reads = {"text": X.text_attribute, "whole": X.int_attribute, "fraction": X.double_attribute, "truth": X.bool_attribute}
    coerced = [f(F.col("a"), k).isNotNull().cast("int") for k in values for own, f in reads.items() if own != k]
    total = coerced[0]
    for c in coerced[1:]:
        total = total + c
    return rows.select("event_id", *(f(F.col("a"), k).alias(k) for k, f in reads.items()), total.alias("coerced"), X.service_of(F.col("r")).alias("service"))


@query("SELECT * FROM (VALUES ('spans', 1200), ('metrics', 400), ('roots', 200), ('services', 6)) v(what, n)")
def simulator_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what two hundred simulated requests emit."""
    s = simulator.store(spark, 200)
    count = lambda rows, what: rows.agg(F.lit(what).alias("what"), F.count(F.lit(1)).cast("int").alias("n"))
    roots, names = s.spans.where(lookups.is_root()), s.spans.select("service").distinct()
    return count(s.spans, "spans").unionByName(count(s.metrics, "metrics")).unionByName(count(roots, "roots")).unionByName(count(names, "services"))


@query("SELECT * FROM (VALUES ('api-gateway', 'auth'), ('api-gateway', 'catalog'), ('api-gateway', 'cart'), ('cart', 'payments'), ('payments', 'postgres')) v(caller, callee)")
def service_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulator.topology(spark)


#: Texts of the language and the trees they print as.
_PLANS = {
    'sum by (status) (count_over_time(m{status="200"}[10m]))': 'Aggregate sum by (status)\n  Func count_over_time\n    Select m{status="200"} [10m]\n',
    "-up": "Neg\n  Select up\n",
    "2 * (up + 0.5)": "Binary *\n  Scalar 2\n  Binary +\n    Select up\n    Scalar 0.5\n",
    "quantile(0.9, up)": "Aggregate quantile (φ=0.9)\n  Select up\n",
    "quantile_over_time(0.5, up[90s])": "Func quantile_over_time (φ=0.5)\n  Select up [90s]\n",
    'max without (a, b) (rate(up{a!="x"}[2h]))': 'Aggregate max without (a, b)\n  Func rate\n    Select up{a!="x"} [2h]\n',
    "avg(up[1500ms])": None,
}


def _tree(text: str) -> str | None:
    try:
        return language.explain(language.plan(text))
    except language.QueryError:
        return None


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'" for x in pair) + ")" for pair in _PLANS.items()) + ") v(text, plan)")
def explain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of node as text; null for a text that is refused."""
    return spark.createDataFrame([(text, _tree(text)) for text in _PLANS], "text string, plan string")


@query(
    f"""{_SPANS} SELECT substr(trace_id, 25, 8) AS id, CASE WHEN dur / 1e6 < 10 THEN printf('%.1f', round(dur / 1e6, 1)) ELSE printf('%.0f', round(dur / 1e6, 0)) END AS ms,
printf('%.0f', round(dur / 1e6 / 1024, 0)) AS kb FROM r"""
)
def display_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root durations as texts."""
    roots = D.store(spark, sf_dir).spans.where(lookups.is_root())
    ms = X.duration_ms(F.col("start_ns"), F.col("end_ns"))
    return roots.select(X.short_id(F.substring("trace_id", 25, 8)).alias("id"), display.milliseconds(ms).alias("ms"), display.kilobytes(ms).alias("kb"))


@query(
    """SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE NULL END AS severity_num,
lower(hex(event_type)) AS hex, event_id % 2 = 0 AS is_id FROM events"""
)
def severity_and_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity names in any case to numbers, hex texts, and ids by their length."""
    names = F.create_map(*map(F.lit, ("view", "DEBUG", "click", "info", "purchase", "Warn", "error", "eRRor", "signup", "none")))
    events = D.read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 2 == 0, F.lpad(F.hex("event_id"), 32, "0")).otherwise(F.lpad(F.hex("event_id"), 31, "0"))
    return events.select("event_id", X.severity_number(names[F.col("event_type")]).alias("severity_num"), X.hex_text(F.encode("event_type", "UTF-8")).alias("hex"), X.hex_id(text, 16).isNotNull().alias("is_id"))
