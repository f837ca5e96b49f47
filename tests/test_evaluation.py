"""The language over small stores, against a plain Python evaluator and fixed facts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.model import LOGS, METRICS, SPANS
from tidewatch.operators import views
from tidewatch.plans import compiler
from tidewatch.store import Store, append, empty_store, with_series_id

MS = 1_000_000


def store_of(spark, points):
    """points: (name, labels, ts_ms, value) in order of arrival."""
    rows = [(n, "Gauge", labels, 0, t, float(v), k) for k, (n, labels, t, v) in enumerate(points)]
    metrics = with_series_id(spark.createDataFrame(rows, METRICS))
    return Store(metrics, spark.createDataFrame([], SPANS), spark.createDataFrame([], LOGS), latest=10_000 * MS)


def vector(result):
    return {tuple(sorted(r["labels"].items())): r["value"] for r in result.collect()}


def test_rate_of_a_line_and_sum(spark):
    s = store_of(spark, [("reqs", {"svc": "a"}, 1000 * (i + 1), i) for i in range(6)])
    assert vector(compiler.query(s, "rate(reqs[1m])", 6000 * MS)) == {(("svc", "a"),): 1.0}
    s = store_of(spark, [("reqs", {"svc": "a"}, 1000, 3), ("reqs", {"svc": "b"}, 1000, 7)])
    assert vector(compiler.query(s, "sum(reqs)", 1000 * MS)) == {(): 10.0}


def test_increase_with_reset_and_quantile(spark):
    s = store_of(spark, [("c", {}, t, v) for t, v in ((0, 8), (1, 10), (2, 1), (3, 4))] + [("q", {}, t, v) for t, v in enumerate((10, 20, 30, 40))])
    assert vector(compiler.query(s, "increase(c[1m])", 10 * MS)) == {(): 6.0}
    assert vector(compiler.query(s, "quantile_over_time(0.5, q[1m])", 10 * MS)) == {(): 25.0}


def test_windows_are_closed_and_empty_series_stay(spark):
    s = store_of(spark, [("m", {"a": "1"}, 1000, 1), ("m", {"a": "1"}, 2000, 2), ("m", {"a": "2"}, 9000, 5)])
    assert vector(compiler.query(s, "count_over_time(m[1s])", 2000 * MS)) == {(("a", "1"),): 2.0, (("a", "2"),): 0.0}
    assert vector(compiler.query(s, "increase(m[1s])", 2000 * MS))[("a", "2"),] == 0.0
    assert vector(compiler.query(s, "avg_over_time(m[1s])", 2000 * MS)) == {(("a", "1"),): 1.5}
    assert vector(compiler.query(s, "m", 2000 * MS)) == {(("a", "1"),): 2.0}
    assert vector(compiler.query(s, "sum(nothing)", 2000 * MS)) == {}
    assert vector(compiler.query(s, "rate(m[1ms])", 2000 * MS)) == {}


def test_missing_is_not_empty(spark):
    s = store_of(spark, [("m", {"a": ""}, 1, 1), ("m", {"b": "x"}, 1, 2)])
    assert vector(compiler.query(s, 'm{a=""}')) == {(("a", ""),): 1.0}
    assert vector(compiler.query(s, 'm{a!=""}')) == {(("b", "x"),): 2.0}
    assert vector(compiler.query(s, "count by (a) (m)")) == {(("a", ""),): 1.0, (): 1.0}
    assert set(vector(compiler.query(s, "sum without () (m)"))) == {(("a", ""),), (("b", "x"),)}


def test_numbers_that_are_none(spark):
    nan = math.nan
    s = store_of(spark, [("m", {"a": "1"}, 1, nan), ("m", {"a": "1"}, 2, 4), ("m", {"a": "2"}, 1, nan)])
    low, high = vector(compiler.query(s, "min_over_time(m[1m])")), vector(compiler.query(s, "max_over_time(m[1m])"))
    assert low[("a", "1"),] == high[("a", "1"),] == 4.0 and math.isnan(low[("a", "2"),]) and math.isnan(high[("a", "2"),])
    only = 'm{a="2"}'
    assert vector(compiler.query(s, f"min({only})")) == {(): math.inf} and vector(compiler.query(s, f"max({only})")) == {(): -math.inf}
    assert vector(compiler.query(s, 'm{a="1"} / 0')) == {(("a", "1"),): math.inf}
    assert vector(compiler.query(s, '-m{a="1"} / 0')) == {(("a", "1"),): -math.inf}
    assert compiler.query(s, "1 / 0") == math.inf and math.isnan(compiler.query(s, "0 / 0")) and compiler.query(s, "-1 / 0") == -math.inf
    assert views.run_query(s, "rate(m)")["error"].startswith("unsupported: ")
    rows = [r.sample for r in views.result_json(compiler.query(s, only)).collect()]
    assert rows == ['{"labels":{"a":"2"},"value":null}']


def test_division_signs(spark):
    cases = [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (0.0, 0.0), (math.nan, 0.0), (6.0, 3.0), (math.inf, 0.0)]
    got = [r[0] for r in spark.createDataFrame([(*c, k) for k, c in enumerate(cases)], "a double, b double, k int").orderBy("k").select(X.ieee_div(F.col("a"), F.col("b"))).collect()]
    want = [math.inf, -math.inf, -math.inf, math.nan, math.nan, 2.0, math.inf]
    assert all(g == w or (math.isnan(g) and math.isnan(w)) for g, w in zip(got, want, strict=True))


def brute(points, name, q=None):
    """One range function over (ts, value) pairs in order."""
    v = [x for _, x in points]
    grown = sum(b - a if b >= a else b for a, b in zip(v, v[1:], strict=False))
    if name == "increase":
        return grown
    if name == "sum_over_time":
        return sum(v)
    if name == "count_over_time":
        return float(len(v))
    if not v:
        return None
    if name == "rate":
        span = points[-1][0] - points[0][0]
        return grown / (span / 1000) if len(v) > 1 and span else None
    if name == "quantile_over_time":
        v, at = sorted(v), q * (len(v) - 1)
        return v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at))
    return {"avg_over_time": sum(v) / len(v), "min_over_time": min(v), "max_over_time": max(v)}[name]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_series(spark, seed):
    r = random.Random(seed)
    points = sorted((("m", {"s": str(r.randrange(4))}, r.randrange(0, 3000), r.randrange(100)) for _ in range(200)), key=lambda p: p[2])
    s, at, width = store_of(spark, points), 2000, 700
    for name in ("rate", "increase", "avg_over_time", "sum_over_time", "min_over_time", "max_over_time", "count_over_time", "quantile_over_time"):
        got = vector(compiler.query(s, f"{name}({'0.3, ' if name[0] == 'q' else ''}m[{width}ms])", at * MS))
        want = {}
        for k in "0123":
            own = [(t, v) for _, labels, t, v in points if labels["s"] == k and at - width <= t <= at]
            value = brute(own, name, 0.3)
            if value is not None and any(labels["s"] == k for _, labels, _, _ in points):
                want[("s", k),] = value
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want), name


def test_predicates_reach_the_scan(spark, tmp_path):
    s = store_of(spark, [("m", {"a": "1"}, 1, 1)])
    s.metrics.write.parquet(str(tmp_path / "m"))
    stored = Store(spark.read.parquet(str(tmp_path / "m")), s.spans, s.logs, latest=5 * MS)
    plan = compiler.query(stored, "avg_over_time(m[1s])")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,m)" in plan and "LessThanOr" in plan and "HashAggregate" in plan and "SortAggregate" not in plan and "Join" not in plan


def test_empty_store_and_append(spark):
    s = empty_store(spark)
    assert vector(compiler.query(s, "sum(m)")) == {} and s.latest_ns == 0
    a = store_of(spark, [("m", {}, 1, 1)]).metrics
    assert [x.seq for x in append(a, a).orderBy("seq").collect()] == [0, 1]
    assert views.store_stats(s).first().compression_ratio == 0.0


def test_series_ids_are_fnv(spark):
    def fnv(name, labels):
        h = 0xCBF29CE484222325
        data = name.encode() + b"\xff" + b"".join(f"{k}={v}".encode() + b"\0" for k, v in sorted(labels.items()))
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    cases = [("cpu", {"b": "2", "a": "1"}), ("cpu", {}), ("ü", {"k": "ñ"})]
    df = spark.createDataFrame(cases, "name string, labels map<string,string>")
    assert [r[0] for r in df.select(X.fnv_series_id(F.col("name"), F.col("labels"))).collect()] == [fnv(*c) for c in cases]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0, 7.0])
def test_quantiles_of_groups(spark, q):
    r = random.Random(5)
    held = min(max(q, 0.0), 1.0)
    points = [("m", {"a": a, "b": str(k)} if a else {"b": str(k)}, 1, float(r.choice([1, 2, 2, 2, 7, 100, -3]))) for k, a in enumerate(["x"] * 31 + ["y"] * 8 + ["z"] + [""] * 6)]
    s = store_of(spark, points)
    for text, key in ((f"quantile by (a) ({q}, m)", lambda labels: tuple((k, v) for k, v in labels.items() if k == "a")), (f"quantile({q}, m)", lambda labels: ())):
        want = {}
        for _, labels, _, value in points:
            want.setdefault(key(labels), []).append(value)
        got = vector(compiler.query(s, text))
        assert got == {k: pytest.approx(brute([(0, x) for x in v], "quantile_over_time", held)) for k, v in want.items()}
    nan = store_of(spark, [("m", {"a": "1"}, 1, math.nan), ("m", {"a": "1"}, 2, 4.0), ("m", {"a": "2"}, 1, math.inf), ("m", {"a": "2"}, 2, 1.0), ("m", {"a": "3"}, 1, -math.inf), ("m", {"a": "3"}, 2, 1.0)])
    found = vector(compiler.query(nan, "quantile_over_time(0, m[1m])"))
    assert found == {(("a", "1"),): 4.0, (("a", "2"),): 1.0, (("a", "3"),): -math.inf}
    top = vector(compiler.query(nan, "quantile_over_time(0.5, m[1m])"))
    assert math.isnan(top[("a", "1"),]) and top[("a", "2"),] == math.inf and top[("a", "3"),] == -math.inf
