"""Compiles a typed plan to a DataFrame (labels, value), or to a float where the whole query is a number.

Nothing is evaluated here: every node adds to one logical plan, which Spark optimises and runs. Label matchers and time
bounds are plain predicates on the metric table, so they reach the scan; a left join to the series is added only for the
functions that give a row to a series without samples in the window.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..store import Store
from . import language as L

#: Functions with a value, 0, for a series without samples in the window.
KEEP_EMPTY = ("sum_over_time", "count_over_time", "increase")
#: Parts of the window that a long series is dealt in, for functions of consecutive samples.
PARTS = 64


def query(store: Store, text: str, at_ns: int | None = None) -> DataFrame | float:
    """Runs a query at an instant, by default the store's latest."""
    return compiled(L.plan(text), store, store.latest_ns if at_ns is None else at_ns)


def compiled(node: object, store: Store, at_ns: int) -> DataFrame | float:
    match node:
        case L.Scalar():
            return node.value
        case L.Select():
            return instant(store, node, at_ns)
        case L.Func():
            return over_range(store, node, at_ns)
        case L.Neg():
            inner = compiled(node.input, store, at_ns)
            return inner.withColumn("value", -F.col("value")) if isinstance(inner, DataFrame) else -inner
        case L.Aggregate():
            return aggregated(compiled(node.input, store, at_ns), node.op, node.grouping, node.param)
        case L.Binary():
            return arithmetic(node.op, compiled(node.left, store, at_ns), compiled(node.right, store, at_ns))
    raise L.EvalError(f"no such node: {node!r}")


def matching(rows: DataFrame, select: L.Select) -> DataFrame:
    rows = rows.where(F.col("name") == select.metric)
    for label, op, value in select.matchers:
        rows = rows.where((X.label_is if op == "=" else X.label_is_not)(F.col("labels"), label, value))
    return rows


def between_ns(rows: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Samples whose millisecond lies in the closed range."""
    return rows.where((F.col("ts_ms") >= -(-start_ns // 1_000_000)) & (F.col("ts_ms") <= end_ns // 1_000_000))


def instant(store: Store, select: L.Select, at_ns: int) -> DataFrame:
    """The last sample of each series up to the instant, however old."""
    rows = between_ns(matching(store.metrics, select), 0, at_ns)
    last = rows.groupBy("series_id", "labels").agg(F.max_by("value", F.struct("ts_ms", "seq")).alias("value"))
    return last.select("labels", "value")


def over_range(store: Store, f: L.Func, at_ns: int) -> DataFrame:
    start_ns = max(at_ns - f.input.range_ms * 1_000_000, 0)
    rows = between_ns(matching(store.metrics, f.input), start_ns, at_ns)
    if f.name in ("rate", "increase"):
        found = _counter(rows, f.name, start_ns // 1_000_000, at_ns // 1_000_000)
    elif f.name == "quantile_over_time":
        found = X.linear_ranks(rows, ["series_id", "labels"], ["series_id"], "value", f.param)
    else:
        v = F.col("value")
        value = {
            "avg_over_time": lambda: F.avg(v),
            "sum_over_time": lambda: F.sum(v),
            "min_over_time": lambda: X.min_number(v, X.NAN),
            "max_over_time": lambda: X.max_number(v, X.NAN),
            "count_over_time": lambda: F.count(v).cast("double"),
        }[f.name]()
        # Labels are a group column, not a first(): a map in the buffer would force a sort in place of hashing.
        found = rows.groupBy("series_id", "labels").agg(value.alias("value"))
    if f.name in KEEP_EMPTY:
        series = matching(store.series, f.input).select("series_id", "labels")
        found = series.join(found.drop("labels"), "series_id", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return found.select("labels", "value")


def _counter(rows: DataFrame, name: str, start_ms: int, end_ms: int) -> DataFrame:
    """Increase with resets to zero. A series is dealt in parts of the window: steps within a part are summed there, and the
    steps from part to part come from their ends, so that no task holds a whole long series."""
    width = max(1, (end_ms - start_ms) // PARTS + 1)
    order = F.struct("ts_ms", "seq")
    dealt = rows.withColumn("part", F.expr(f"(ts_ms - {start_ms}) div {width}"))
    before = F.lag("value").over(Window.partitionBy("series_id", "part").orderBy("ts_ms", "seq"))
    grown = lambda now, last: F.when(last.isNull(), F.lit(0.0)).when(now >= last, now - last).otherwise(now)
    steps = dealt.withColumn("last", before)
    # NaN compares above every number in Spark: a step from or to it is NaN, as for any comparison that fails.
    step = F.when(F.isnan("last") | F.isnan("value"), F.when(F.col("last").isNull(), 0.0).otherwise(F.col("value"))).otherwise(grown(F.col("value"), F.col("last")))
    parts = steps.withColumn("step", step).groupBy("series_id", "labels", "part").agg(
        F.sum("step").alias("inside"),
        F.min_by("value", order).alias("head"),
        F.max_by("value", order).alias("tail"),
        F.min("ts_ms").alias("low"),
        F.max("ts_ms").alias("high"),
        F.count(F.lit(1)).alias("n"),
    )
    parts = parts.withColumn("last", F.lag("tail").over(Window.partitionBy("series_id").orderBy("part")))
    link = F.when(F.col("last").isNull(), 0.0).when(F.isnan("last") | F.isnan("head"), F.col("head")).otherwise(grown(F.col("head"), F.col("last")))
    whole = parts.withColumn("link", link).groupBy("series_id", "labels").agg(
        (F.sum("inside") + F.sum("link")).alias("grown"), (F.max("high") - F.min("low")).alias("span"), F.sum("n").alias("n")
    )
    if name == "increase":
        return whole.select("series_id", "labels", F.col("grown").alias("value"))
    return whole.where("n >= 2 AND span > 0").select("series_id", "labels", (F.col("grown") / (F.col("span") / F.lit(1000.0))).alias("value"))


def aggregated(vector: DataFrame, op: str, grouping: tuple[str, tuple[str, ...]] | None = None, param: float | None = None) -> DataFrame:
    """Groups of labels; an empty vector gives an empty vector, also without grouping."""
    if grouping is None:
        labels = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    else:
        how, names = grouping
        within = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
        held = lambda k, _: F.array_contains(within, k)
        labels = F.map_filter("labels", held if how == "by" else lambda k, v: ~held(k, v))
    if op == "quantile":
        # A window needs keys with an order, which maps lack: their entries by key stand for them.
        keyed = vector.select(F.array_sort(F.map_entries(labels)).alias("entries"), "value")
        return X.linear_ranks(keyed, ["entries"], ["entries"], "value", param).select(F.map_from_entries("entries").alias("labels"), "value")
    v = F.col("value")
    value = {
        "sum": lambda: F.sum(v),
        "avg": lambda: F.avg(v),
        "min": lambda: X.min_number(v, X.INF),
        "max": lambda: X.max_number(v, -X.INF),
        "count": lambda: F.count(F.lit(1)).cast("double"),
    }[op]()
    return vector.withColumn("labels", labels).groupBy("labels").agg(value.alias("value"))


def arithmetic(op: str, left: DataFrame | float, right: DataFrame | float) -> DataFrame | float:
    if not isinstance(left, DataFrame) and not isinstance(right, DataFrame):
        if op == "/":
            return X.ieee_div_float(left, right)
        return {"+": left + right, "-": left - right, "*": left * right}[op]
    vector = left if isinstance(left, DataFrame) else right
    a, b = (F.col("value") if isinstance(x, DataFrame) else F.lit(float(x)) for x in (left, right))
    value = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: X.ieee_div(a, b)}[op]()
    return vector.withColumn("value", value)
