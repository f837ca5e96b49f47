"""Synthetic telemetry of a small shop, from spark.range: every value is a hash of seed, request and purpose, so any request
can be made anywhere, again and alike. Times start at a given instant.

A request calls gateway -> auth, catalog, cart -> payments -> postgres. Children run one after the other; payments slow
down in the last quarter of every sixty requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ATTRIBUTES, LOGS, METRICS, SERVICE_NAME, SEVERITIES, SPANS
from ..store import Store, with_series_id

#: Fixed values of the simulated shop: base ms, jitter ms, error rate of each service, and who calls whom.
PROFILES = {"api-gateway": (6, 3, 0.0), "auth": (13, 7, 0.01), "catalog": (22, 12, 0.015), "cart": (9, 5, 0.01), "payments": (38, 16, 0.05), "postgres": (17, 9, 0.03)}
EDGES = [("api-gateway", "auth"), ("api-gateway", "catalog"), ("api-gateway", "cart"), ("cart", "payments"), ("payments", "postgres")]
ROUTES = ("GET /products", "POST /cart", "POST /checkout", "GET /orders")
CYCLE, SLOW_FROM, SLOW_MS, GAP_MS = 60, 45, 95.0, 0.5
SERVICES = tuple(PROFILES)


#: Fixed values of the simulated shop: what a span of each service carries. Attribute -> constant, or (kind, low, high) drawn for the request; cents are a
#: hundredth of the number drawn.
CARRIES = {
    "api-gateway": {"http.method": "GET", "http.route": "/checkout", "http.scheme": "https", "net.peer.ip": ("address", 0, 255)},
    "auth": {"auth.method": "jwt", "enduser.id": ("user", 1, 1_000_000), "auth.token.ttl_s": ("whole", 60, 3600)},
    "catalog": {"catalog.items": ("whole", 1, 24), "cache.hit": ("chance", 0, 70), "catalog.region": "eu-west-1"},
    "cart": {"cart.id": ("cart", 0, 1 << 32), "cart.items": ("whole", 1, 12), "cart.value_usd": ("cents", 500, 50_000)},
    "payments": {"payment.provider": "stripe", "payment.currency": "USD", "payment.amount_usd": ("cents", 500, 50_000), "payment.card.brand": ("brand", 0, 3), "payment.retries": ("whole", 0, 3)},
    "postgres": {"db.system": "postgresql", "db.statement": "SELECT * FROM orders WHERE cart_id = $1", "db.rows": ("whole", 0, 8), "db.pool.in_use": ("whole", 1, 20)},
}
BRANDS = ("visa", "mastercard", "amex")
#: Fixed values of the simulated shop: what the error log of a service says.
FAILURES = {
    "payments": "card authorization declined by processor", "postgres": "connection pool exhausted", "catalog": "upstream inventory service timed out",
    "auth": "token validation failed", "cart": "cart snapshot is stale",
}


def children_of(service: str) -> list[str]:
    return [b for a, b in EDGES if a == service]


def topology(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "caller string, callee string")


def uniform(seed: int, purpose: str) -> Column:
    """A number in [0, 1) of the request."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("n"), F.lit(purpose)), F.lit(1 << 32)) / float(1 << 32)


def digits(seed: int, purpose: str, size: int) -> Column:
    words = [F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), F.col("n"), F.lit(f"{purpose}{k}")))), 16, "0") for k in range(size // 8)]
    return F.concat(*words)


def requests(spark: SparkSession, count: int, seed: int = 7, start_ns: int = 1_700_000_000_000_000_000, partitions: int | None = None) -> DataFrame:
    """One row a request, numbered from 0; see ``numbered``."""
    return numbered(spark.range(0, count, 1, partitions).withColumnRenamed("id", "n"), seed, start_ns)


def numbered(rows: DataFrame, seed: int = 7, start_ns: int = 1_700_000_000_000_000_000) -> DataFrame:
    """The requests of the numbers ``n``, batch or stream alike: n, trace_id, route, at_ns, and the array ``spans`` of (service,
    depth order, start_ns, end_ns, error)."""
    # Arrivals are 75 ms apart on average and keep their order: a slot of 75 ms each and up to 54 ms within it.
    rows = rows.withColumn("at_ns", F.lit(start_ns) + F.col("n") * 75_000_000 + F.floor(uniform(seed, "gap") * 54_000_000))
    own = {}
    for s, (base, jitter, _) in PROFILES.items():
        slow = F.when(F.pmod("n", F.lit(CYCLE)) >= SLOW_FROM, SLOW_MS).otherwise(0.0) if s == "payments" else F.lit(0.0)
        own[s] = F.greatest(F.lit(float(base)) + (uniform(seed, s + "own") * 2 - 1) * jitter, F.lit(0.5)) + slow
    start, end = {"api-gateway": F.lit(0.0)}, {}

    def place(service: str) -> Column:
        at = start[service]
        for child in children_of(service):
            start[child] = at + 1 + uniform(seed, child + "delay")
            at = place(child) + GAP_MS
        end[service] = at + own[service]
        return end[service]

    place("api-gateway")
    ns = lambda ms: F.col("at_ns") + F.floor(ms * 1e6)
    failed = {s: uniform(seed, s + "error") < rate for s, (_, _, rate) in PROFILES.items()}
    any_failed = F.greatest(*(f.cast("int") for f in failed.values())) == 1
    callers = {b: a for a, b in EDGES}
    spans = F.array(*(
        F.struct(
            F.lit(s).alias("service"), digits(seed, s, 8).alias("span_id"), (digits(seed, callers[s], 8) if s in callers else F.lit(None).cast("string")).alias("parent_span_id"),
            ns(start[s]).alias("start_ns"), ns(end[s]).alias("end_ns"), (any_failed if s not in callers else failed[s]).alias("error"), F.lit("Server" if children_of(s) else "Client").alias("kind"), F.lit(k).alias("k"),
        ) for k, s in enumerate(SERVICES)
    ))
    route = F.get(F.array(*map(F.lit, ROUTES)), F.floor(uniform(seed, "route") * len(ROUTES)).cast("int"))
    return rows.select("n", F.lit(seed).alias("seed"), digits(seed, "trace", 16).alias("trace_id"), route.alias("route"), "at_ns", spans.alias("spans"), any_failed.alias("failed"))


def _variant(value: Column) -> Column:
    return value.cast(T.VariantType())


def _resource(service: Column) -> Column:
    return F.create_map(F.lit(SERVICE_NAME), _variant(service))


def _drawn(key: str, kind: str, low: int, high: int) -> Column:
    """An attribute's value, from the request's number and seed."""
    hashed = lambda part="": F.pmod(F.xxhash64("seed", "n", F.lit(f"{key}{part}")), F.lit(1 << 40))
    number = low + hashed() % (high - low)
    match kind:
        case "whole":
            return number
        case "cents":
            return number / 100.0
        case "chance":
            return hashed() % 100 < high
        case "user":
            return F.concat(F.lit("u_"), F.lpad(number.cast("string"), 6, "0"))
        case "cart":
            return F.concat(F.lit("cart_"), F.lpad(F.lower(F.hex(number)), 8, "0"))
        case "brand":
            return F.get(F.array(*map(F.lit, BRANDS)), number.cast("int"))
        case "address":
            return F.concat_ws(".", F.lit("10"), *((hashed(k) % 254 + 1).cast("string") for k in range(3)))


def span_attributes() -> Column:
    """Typed attributes of a span row with n, seed and service."""
    found = F.lit(None).cast(ATTRIBUTES)
    for service, carried in CARRIES.items():
        values = {k: _drawn(k, *v) if isinstance(v, tuple) else F.lit(v) for k, v in carried.items()}
        made = F.create_map(F.lit(SERVICE_NAME), _variant(F.lit(service)), *(c for k, v in values.items() for c in (F.lit(k), _variant(v))))
        found = F.when(F.col("service") == service, made).otherwise(found)
    return found


def failure(service: Column) -> Column:
    """What the error log of a service's failed span says."""
    found = F.lit("internal error")
    for name, text in FAILURES.items():
        found = F.when(service == name, text).otherwise(found)
    return F.concat(service, F.lit(": "), found)


def spans_of(made: DataFrame) -> DataFrame:
    s = made.select("n", "seed", "trace_id", "route", F.explode("spans").alias("s")).select("n", "seed", "trace_id", "route", "s.*")
    return s.select(
        "trace_id", "span_id", "parent_span_id", F.when(F.col("parent_span_id").isNull(), F.col("route")).otherwise(F.concat("service", F.lit(".call"))).alias("name"), "kind", "start_ns", "end_ns",
        F.when(F.col("error"), "Error").otherwise("Ok").alias("status"), span_attributes().alias("attributes"), _resource(F.col("service")).alias("resource"), "service", (F.col("n") * 8 + F.col("k")).alias("seq"),
    ).select(*SPANS.names)


def metrics_of(made: DataFrame) -> DataFrame:
    """A gauge of the duration and a counter of requests each, labelled by route and status."""
    root = F.get("spans", F.lit(0))
    labels = F.create_map(F.lit("route"), F.col("route"), F.lit("status"), F.when(F.col("failed"), "500").otherwise("200"))
    points = F.array(
        F.struct(F.lit("http_request_duration_ms").alias("name"), F.lit("Gauge").alias("kind"), ((root["end_ns"] - root["start_ns"]) / 1e6).alias("value"), F.lit(0).alias("k")),
        F.struct(F.lit("http_requests_total").alias("name"), F.lit("Counter").alias("kind"), (F.col("n") + 1).cast("double").alias("value"), F.lit(1).alias("k")),
    )
    rows = made.select("n", labels.alias("labels"), root["end_ns"].alias("t"), F.explode(points).alias("p"))
    return with_series_id(rows.select("p.name", "p.kind", "labels", F.expr("t div 1000000").alias("ts_ms"), "p.value", (F.col("n") * 2 + F.col("p.k")).alias("seq"))).select(*METRICS.names)


def logs_of(made: DataFrame) -> DataFrame:
    """A summary of each request, then one error log for each failed span."""
    root = F.get("spans", F.lit(0))
    level = lambda name: (F.lit(name).alias("severity"), F.lit(SEVERITIES.index(name)).alias("severity_num"))
    first = F.when(F.col("failed"), F.struct(*level("Warn"))).otherwise(F.struct(*level("Info")))
    summary = F.struct(root["end_ns"].alias("ts_ns"), first.alias("l"), F.concat("route", F.lit(" finished")).alias("body"), F.lit(SERVICES[0]).alias("service"), root["span_id"].alias("span_id"), F.lit(0).alias("k"))
    errors = F.transform(F.filter("spans", lambda s: s["error"] & (s["k"] > 0)), lambda s: F.struct(s["end_ns"].alias("ts_ns"), F.struct(*level("Error")).alias("l"), failure(s["service"]).alias("body"), s["service"].alias("service"), s["span_id"].alias("span_id"), s["k"].alias("k")))
    rows = made.select("n", "trace_id", F.explode(F.concat(F.array(summary), errors)).alias("g")).select("n", "trace_id", "g.*")
    return rows.select("ts_ns", "l.severity", "l.severity_num", "body", _resource(F.col("service")).alias("attributes"), _resource(F.col("service")).alias("resource"), "service", "trace_id", "span_id", (F.col("n") * 8 + F.col("k")).alias("seq")).select(*LOGS.names)


def store(spark: SparkSession, count: int, seed: int = 7, start_ns: int = 1_700_000_000_000_000_000) -> Store:
    return store_of(requests(spark, count, seed, start_ns))


def store_of(made: DataFrame) -> Store:
    return Store(metrics_of(made), spans_of(made), logs_of(made))
