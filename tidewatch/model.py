"""The telemetry model: schemas of the three signals and their encodings.

Times are integers (nanoseconds for spans and logs, milliseconds for samples) because Spark's timestamps hold no more than
microseconds. ``seq`` is the order of arrival and breaks every tie.
"""

from __future__ import annotations

from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType())
ATTRIBUTES = T.MapType(T.StringType(), T.VariantType())

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "labels": LABELS, "attributes": ATTRIBUTES}


def _schema(text: str) -> T.StructType:
    """Columns as "name:type ..." (no session is needed, unlike for DDL)."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(":") for c in text.split())])


METRICS = _schema("name:string kind:string labels:labels series_id:bigint ts_ms:bigint value:double seq:bigint")
SERIES = _schema("series_id:bigint name:string kind:string labels:labels")
SPANS = _schema(
    "trace_id:string span_id:string parent_span_id:string name:string kind:string start_ns:bigint end_ns:bigint status:string attributes:attributes resource:attributes service:string seq:bigint"
)
LOGS = _schema("ts_ns:bigint severity:string severity_num:int body:string attributes:attributes resource:attributes service:string trace_id:string span_id:string seq:bigint")

#: Fixed values of the signal formats.
SEVERITIES = ("Trace", "Debug", "Info", "Warn", "Error", "Fatal")
METRIC_KINDS = ("Gauge", "Counter", "Histogram")
SPAN_KINDS = {2: "Server", 3: "Client", 4: "Producer", 5: "Consumer"}
SPAN_STATUSES = {1: "Ok", 2: "Error"}
SERVICE_NAME, SERVICE_VERSION, SERVICE_INSTANCE, HOST_NAME, ENVIRONMENT = "service.name", "service.version", "service.instance.id", "host.name", "deployment.environment"

#: The latest time; unsigned 64-bit times beyond it cannot be held.
FOREVER_NS = (1 << 63) - 1
DEFAULT_WINDOW_NS = 5 * 60 * 1_000_000_000
