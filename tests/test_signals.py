"""Spans, logs, detectors, codec, sources and streams."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import exprs as X
from tidewatch.model import LOGS, SPANS
from tidewatch.operators import codec, correlate, detectors, lookups, views
from tidewatch.sources import envelope, otlp, simulator
from tidewatch.store import Store
from tidewatch.streaming import live

T1, S1, S2 = "0a" * 16, "01" * 8, "02" * 8


def span(trace, sid, parent, start, end, seq, service="svc", status="Ok", name="op"):
    return (trace, sid, parent, name, "Internal", start, end, status, None, None, service, seq)


def log(ts, severity, seq, trace=None, body="b"):
    return (ts, severity, X.severity_rank(severity), body, None, None, "svc", trace, None, seq)


@pytest.fixture(scope="module")
def shop(spark):
    s = simulator.store(spark, 120)
    return s


def test_self_time_ties_and_orphans(spark):
    rows = [
        span("t", "r", None, 0, 100, 0), span("t", "a", "r", 0, 60, 1), span("t", "b", "r", 60, 120, 2), span("t", "c", "gone", 5, 45, 3), span("t", "d", "a", 10, 5, 4),
        span("u", "r", None, 0, 10, 5, "one"), span("u", "x", "r", 1, 11, 6, None),
    ]
    spans = spark.createDataFrame(rows, SPANS)
    own = {(r.trace_id, r.span_id): r.self_ns for r in correlate.self_times(spans).collect()}
    assert own["t", "r"] == 0 and own["t", "a"] == 60 and own["t", "c"] == 40 and own["t", "d"] == 0
    worst = {r.trace_id: r for r in correlate.bottlenecks(spans).collect()}
    assert worst["t"].self_ns == 60 and worst["u"].service == "?" and worst["u"].dur_ns == 10


def test_lists_and_details(spark):
    spans = spark.createDataFrame([span(T1, S1, None, 1000, 4_001_000, 0), span(T1, S2, S1, 900, 950, 1)], SPANS)
    logs = spark.createDataFrame([log(5, "Error", 0, T1), log(7, "Info", 1), log(7, "Fatal", 2)], LOGS)
    store = Store(spark.createDataFrame([], "name string, kind string, labels map<string,string>, series_id long, ts_ms long, value double, seq long"), spans, logs)
    assert store.latest_ns == 1000
    assert [r.duration_ms for r in lookups.trace_list(store).collect()] == [4.0]
    found, lines = lookups.trace_detail(store, T1.upper())
    assert [r.span_id for r in found.collect()] == [S2, S1] and lines.count() == 1
    with pytest.raises(ValueError, match="invalid trace id"):
        lookups.trace_detail(store, "0g" * 16)
    assert lookups.trace_detail(store, "0b" * 16)[0].count() == 0
    assert [r.severity for r in lookups.log_list(store, severity="error").collect()] == ["Fatal", "Error"]
    assert lookups.log_list(store, severity="what").count() == 3
    assert views.services(store).first().calls == 2


def test_detectors(spark):
    series = {
        1: [100 + i % 3 for i in range(200)] + [180] * 20,
        2: [50 + i % 5 for i in range(100)] + [500],
        3: [100 + i % 3 for i in range(100)] + [200] * 60,
        4: [100 + 20 * math.sin(i % 12 / 12 * 2 * math.pi) + i % 5 - 2 for i in range(120)] + [250],
    }
    df = spark.createDataFrame([(k, i, i, float(v)) for k, s in series.items() for i, v in enumerate(s)], "series_id long, ts_ms long, seq long, value double")
    of = lambda f, k: sorted(r.timestamp_ms for r in f.where(F.col("series_id") == k).collect())
    ewma = of(detectors.detect(df, "ewma"), 1)
    assert ewma and min(ewma) >= 200
    assert of(detectors.mad(df), 2) == [100]
    assert 100 <= of(detectors.detect(df, "cusum"), 3)[0] < 110
    assert of(detectors.detect(df, "holt_winters"), 4) == [120]
    assert detectors.detect(df.where("ts_ms < 20"), "ewma").count() == 0


def samples(kind):
    r = random.Random(3)
    if kind == "regular":
        return [(1000 * i, 100.0) for i in range(1000)]
    if kind == "walk":
        out, t, v = [], 0, 100.0
        for _ in range(2000):
            t, v = t + r.choice([1, 10, 100, 1000, 5000]), v + r.uniform(-1, 1)
            out.append((t, v))
        return out
    return {"empty": [], "one": [(5, 1.5)], "odd": [(0, 1.0), (1, 2.0), (2, 1.7976931348623157e308), (3, -0.0), (4, 0.0), (5, math.inf)]}[kind]


@pytest.mark.parametrize("kind", ["empty", "one", "regular", "walk", "odd"])
def test_codec_round_trip(kind):
    w = codec.Writer()
    for t, v in samples(kind):
        w.push(t, v)
    back = codec.decode(w.data(), w.count)
    assert [(t, struct.pack(">d", v)) for t, v in back] == [(t, struct.pack(">d", v)) for t, v in samples(kind)]
    assert len(w.data()) == w.bytes_used
    if kind == "regular":
        assert w.size == 2141 and w.bytes_used == 268
    assert codec.decode(w.data()[:10], w.count) == []


EXPORT = {
    "resourceSpans": [{
        "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "checkout"}}]},
        "scopeSpans": [{"spans": [
            {"traceId": T1, "spanId": S1, "name": "payments.charge", "kind": 3, "startTimeUnixNano": "1000", "endTimeUnixNano": "4000", "status": {"code": 2}, "parentSpanId": "",
             "attributes": [{"key": "payment.provider", "value": {"stringValue": "stripe"}}, {"key": "n", "value": {"intValue": "3"}}, {"key": "x", "value": {"kvlistValue": {}}},
                            {"key": "a", "value": {"arrayValue": {"values": [{"boolValue": True}, {"arrayValue": {"values": [{"doubleValue": 1.5}]}}, {"bytesValue": ""}]}}}]},
            {"traceId": "short", "spanId": S2, "name": "dropped"},
            {"traceId": T1.upper(), "spanId": S2, "parentSpanId": S1, "name": "child", "kind": "SPAN_KIND_SERVER"},
        ]}],
    }]
}


def proto(number, value):
    """One field: int (varint), bytes or str (length-delimited), or fixed 64 as (int,)."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, tuple):
        return varint(number << 3 | 1) + struct.pack("<Q", value[0])
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def test_otlp_json_and_protobuf(spark):
    attribute = lambda k, v: proto(1, k) + proto(2, v)
    one = proto(1, bytes.fromhex(T1)) + proto(2, bytes.fromhex(S1)) + proto(5, "payments.charge") + proto(6, 3) + proto(7, (1000,)) + proto(8, (4000,))
    one += proto(9, attribute("payment.provider", proto(1, "stripe"))) + proto(9, attribute("n", proto(3, 3))) + proto(9, attribute("x", proto(6, b""))) + proto(15, proto(3, 2))
    bad = proto(1, b"\1") + proto(2, bytes.fromhex(S2))
    body = proto(1, proto(1, proto(1, attribute("service.name", proto(1, "checkout")))) + proto(2, proto(2, one) + proto(2, bad)))
    bodies = spark.createDataFrame([(1, "application/json; charset=utf-8", json.dumps(EXPORT).encode()), (2, None, body), (3, "application/json", b"{"), (4, "x", b"\x0a\xff")], "body_id long, content_type string, body binary")
    rows = otlp.spans(bodies).select("*", X.text_attribute(F.col("attributes"), "payment.provider").alias("provider"), X.int_attribute(F.col("attributes"), "n").alias("n"), F.to_json(F.struct("attributes")).alias("j")).orderBy("seq").collect()
    assert [(r.name, r.kind, r.status, r.service, r.provider, r.n) for r in rows] == [("payments.charge", "Client", "Error", "checkout", "stripe", 3), ("child", "Server", "Unset", "checkout", None, None), ("payments.charge", "Client", "Error", "checkout", "stripe", 3)]
    assert rows[0].parent_span_id is None and rows[1].parent_span_id == S1 and rows[1].trace_id == T1
    assert json.loads(rows[0].j)["attributes"]["a"] == [True, [1.5]] and "x" not in json.loads(rows[0].j)["attributes"]
    errors = [r.error[:8] for r in otlp.decoded(bodies).where("error IS NOT NULL").orderBy("body_id").collect()]
    assert [e.split(":")[0] for e in errors] == ["json", "protobuf"]
    assert otlp.reply("application/json") == b"{}" and otlp.reply(None) == b""


def test_simulated_requests(spark, shop):
    assert shop.spans.count() == 720 and shop.metrics.count() == 240 and shop.logs.count() >= 120
    roots = shop.spans.where("parent_span_id IS NULL")
    assert roots.count() == 120 and shop.spans.select("trace_id").distinct().count() == 120
    inside = shop.spans.alias("c").join(shop.spans.alias("p"), F.expr("c.trace_id = p.trace_id AND c.parent_span_id = p.span_id"))
    assert inside.count() == 600 and inside.where("c.start_ns < p.start_ns OR c.end_ns > p.end_ns").count() == 0
    again = simulator.store(spark, 120)
    assert again.spans.select("span_id", "start_ns", "end_ns").exceptAll(shop.spans.select("span_id", "start_ns", "end_ns")).count() == 0
    report = views.anomaly_report(shop)
    assert report["counts"].first().points > 0
    if report["slowest"] is not None:
        assert report["slowest"].count() <= 5


def test_stream_equals_batch(spark, shop, tmp_path):
    lines = envelope.metric_lines(shop.metrics).unionByName(envelope.span_lines(shop.spans)).unionByName(envelope.log_lines(shop.logs))
    lines.select("value").write.text(str(tmp_path / "in"))
    live.route(live.signal_lines(spark, str(tmp_path / "in")), str(tmp_path / "out")).awaitTermination(120)
    stored = live.store(spark, str(tmp_path / "out"))
    for name, columns in (("metrics", ["name", "ts_ms", "value"]), ("spans", ["trace_id", "span_id", "start_ns", "status", "service", "kind"]), ("logs", ["ts_ns", "severity", "severity_num", "body", "service"])):
        a, b = getattr(stored, name).select(*columns), getattr(shop, name).select(*columns)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0, name
    assert stored.latest_ns == shop.latest_ns == live.latest(shop.spans).first()[0]
    events = live.request_events(stored.spans)
    assert events.count() == 120 and live.recent(events, 7).count() == 7
    assert json.loads(live.event_json(events).first().value)["kind"] == "request"


def test_waterfall_fits(spark, shop):
    bars = correlate.waterfall(shop.spans)
    assert bars.where("offset < 0 OR offset > 35 OR size < 1 OR offset + size > 36").count() == 0


def test_display_forms(spark):
    from tidewatch.functions import display

    cases = [(None, "—", "—", "—"), (9.96, "10.0", "10", "996.0"), (3.21, "3.2", "3.2", "321.0"), (1234.0, "1234", "1.2K", "123400.0"), (999_999.0, "999999", "1M", None), (2.5e9, None, "2.5B", None), (1.0, "1.0", "1", "100.0")]
    df = spark.createDataFrame([(k, x) for k, (x, *_) in enumerate(cases)], "k int, x double")
    c = F.col("x")
    got = df.orderBy("k").select(display.milliseconds(c), display.compact(c), display.percent(c)).collect()
    for row, (_, *want) in zip(got, cases, strict=True):
        assert all(w is None or w == g for g, w in zip(row, want, strict=True)), (row, want)
    assert spark.range(1).select(display.waterfall_bar(F.lit(2), F.lit(3))).first()[0] == "  ███"
    ids = spark.createDataFrame([("AB" * 16,), ("ab" * 15 + "a",), ("g" * 32,), (None,)], "t string").select(X.hex_id(F.col("t"), 16)).collect()
    assert [r[0] for r in ids] == ["ab" * 16, None, None, None]


def test_no_body_kills_its_batch(spark):
    """Bodies that don't decode give an error each; the spans of the others are there, in their order."""
    span = lambda **more: {"traceId": "ab" * 16, "spanId": "cd" * 8, "name": "x", "startTimeUnixNano": "5", "endTimeUnixNano": "9", **more}
    body = lambda *spans: json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": list(spans)}]}]}).encode()
    bad = [body({"traceId": 5}), body(span(kind=[1])), b'{"resourceSpans": ' + b"[" * 100_000, body(span(name=7)), b"[]", body(span(startTimeUnixNano="x"))]
    good = body(*(span(name=f"n{k}") for k in range(5)), span(startTimeUnixNano=str(2**64 - 1)), span(name="\ud800", attributes=[{"key": "a", "value": {"doubleValue": "NaN"}}]))
    rows = [(k, "application/json", b) for k, b in enumerate([*bad, good])]
    bodies = spark.createDataFrame(rows, "body_id long, content_type string, body binary")
    errors = otlp.decoded(bodies).where("error IS NOT NULL").select("body_id", "error").collect()
    assert sorted(r.body_id for r in errors) == list(range(len(bad))) and all(r.error.startswith("json: ") for r in errors)
    found = otlp.spans(bodies).orderBy("seq").collect()
    assert [r.name for r in found][:5] == [f"n{k}" for k in range(5)] and len(found) == 7 and found[5].start_ns == 2**63 - 1
    assert [r.seq for r in found] == [len(bad) * (1 << 20) + k for k in range(7)]


def test_arrival_keeps_micro_batches_apart(spark):
    rows = spark.createDataFrame([(0,), (7,), (128 << 33,), ((128 << 33) + 1,), (16_383 << 33,)], "seq long")
    one, two = ([r[0] for r in rows.select(live.arrival(F.col("seq"), k)).collect()] for k in (3, 4))
    assert one == sorted(one) and len({*one, *two}) == 10 and max(one) < min(two)
    with pytest.raises(Exception, match="too many rows"):
        spark.createDataFrame([(1 << 26,)], "seq long").select(live.arrival(F.col("seq"), 0)).collect()


def test_long_series_are_cut_into_chunks(spark):
    rows = [(s, k * 1000, float(k % 7), k) for s in (1, 2) for k in range(25 * s)]
    points = spark.createDataFrame(rows, "series_id long, ts_ms long, value double, seq long")
    chunks = codec.encoded(points, most=10)
    assert sorted((r.series_id, r.samples) for r in chunks.collect()) == [(1, 5), (1, 10), (1, 10), *[(2, 10)] * 5]
    assert sorted(tuple(r) for r in codec.decoded(chunks).collect()) == [(s, t, v) for s, t, v, _ in rows]


def test_simulated_attributes_and_failures(shop):
    a = F.col("attributes")
    reads = {"api-gateway": X.text_attribute(a, "net.peer.ip"), "auth": X.int_attribute(a, "auth.token.ttl_s"), "catalog": X.bool_attribute(a, "cache.hit"), "payments": X.double_attribute(a, "payment.amount_usd")}
    for service, read in reads.items():
        found = [r[0] for r in shop.spans.where(F.col("service") == service).select(read).collect()]
        assert len(found) == 120 and None not in found and len(set(found)) > 1, service
    assert shop.spans.where(X.text_attribute(a, "service.name") != F.col("service")).count() == 0
    said = {r.body for r in shop.logs.where("severity = 'Error'").collect()}
    assert said and said <= {f"{k}: {v}" for k, v in simulator.FAILURES.items()}


def test_terminal_lines(spark):
    spans = spark.createDataFrame([span(T1, S1, None, 0, 100_000_000, 1, "web"), span(T1, S2, S1, 50_000_000, 75_050_000, 2, "a-service-of-a-long-name", "Error"), span("0b" * 16, S1, S2, 0, 5, 3)], SPANS)
    logs = spark.createDataFrame([log(1, "Warn", 1, T1, "slow"), log(2, "Info", 2, None, "alone"), log(3, "Error", 3, "0c" * 16, "no spans")], LOGS)
    metrics = spark.createDataFrame([(T1, "reqs", {"b": "2", "a": "1"}, 2.6, 1), (T1, "up", {}, 1.0, 2)], "trace_id string, name string, labels map<string,string>, value double, seq long")
    rows = views.terminal(spans, logs, metrics).orderBy("trace_id", "part", "place").collect()
    assert {r.trace_id for r in rows} == {T1}  # a trace without a root has no lines
    assert [r.line for r in rows] == [
        "▶ trace 0a0a0a0a     100.0ms   ● OK",
        "  web              " + "█" * 36 + "   100.0ms",
        "  a-service-of-a-long-name " + " " * 18 + "█" * 9 + "    25.1ms",
        "  ▲ slow",
        "  ▸ reqs{a=1,b=2} 3",
        "  ▸ up 1",
    ]


def test_anomaly_document(spark, shop):
    found = views.anomaly_document(shop)
    assert found["metric"] == "http_request_duration_ms" and found["status"] == "200" and set(found["detectors"]) == {"ewma", "mad", "cusum"}
    assert found["points"] > 0 and (found["changepoint"] is None) == (found["cause"] is None)
    steps = [(1, k, k, 100.0 + k % 3 if k < 60 else 300.0) for k in range(90)]
    points = spark.createDataFrame([("m", "Gauge", {"status": "200"}, *p[:2], p[3], p[2]) for p in steps], "name string, kind string, labels map<string,string>, series_id long, ts_ms long, value double, seq long")
    ms = 1_000_000
    spans = spark.createDataFrame([span(T1, S1, None, 61 * ms, 90 * ms, 1, "web", "Error"), span(T1, S2, S1, 62 * ms, 82 * ms, 2, "db")], SPANS)
    logs = spark.createDataFrame([log(70 * ms, "Error", 1, T1, "down"), log(71 * ms, "Info", 2, T1, "fine")], LOGS)
    found = views.anomaly_document(Store(points, spans, logs), "m")
    assert found["changepoint"]["timestamp_ms"] == 60 and found["changepoint"]["observed"] == 300.0
    assert found["cause"]["slowest"] == [{"trace_id": T1, "operation": "op", "duration_ms": 29.0, "failed": True, "bottleneck_service": "db", "bottleneck_op": "op", "bottleneck_ms": 20.0}]
    assert [json.loads(r.json)["body"] for r in found["cause"]["error_logs"].collect()] == ["down"]
    nothing = views.anomaly_document(Store(points, spans, logs), "absent")
    assert nothing["points"] == 0 and nothing["changepoint"] is None and nothing["cause"] is None


def test_statistics_of_nothing(spark):
    numbers = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 9.0), (2, 5.0), (3, None)], "k int, x double")
    rows = numbers.groupBy("k").agg(X.mean(F.col("x")), X.stddev(F.col("x")), X.median(F.col("x"))).orderBy("k").collect()
    assert tuple(rows[0])[1:] == pytest.approx((5.0, math.sqrt(26 / 3), 4.0))
    assert tuple(rows[1])[1:] == (5.0, 0.0, 5.0) and tuple(rows[2])[1:] == (0.0, 0.0, 0.0)


def test_feed_backfills_and_tells_subscribers(spark, tmp_path):
    base, numbers = str(tmp_path / "feed"), str(tmp_path / "numbers")
    read = lambda: spark.readStream.schema("value long").parquet(numbers)
    run = lambda: live.feed(read(), base, backfill=20)
    spark.range(5).withColumnRenamed("id", "value").write.parquet(numbers)
    for size in (5, 12):
        following = run()
        following.processAllAvailable()
        following.stop()
        stored = live.store(spark, base)
        assert stored.spans.count() == 6 * (20 + size) and stored.metrics.count() == 2 * (20 + size)
        spark.range(size, 12).withColumnRenamed("id", "value").write.mode("append").parquet(numbers)
    want = simulator.store(spark, 32)
    columns = ["trace_id", "span_id", "start_ns", "status"]
    assert stored.spans.select(*columns).exceptAll(want.spans.select(*columns)).count() == 0
    told = []
    live.subscribe(live.events(spark, base), told.append, str(tmp_path / "all")).awaitTermination(60)
    events = [json.loads(t) for batch in told for t in batch]
    assert len(events) == 12 and [e["timestamp_ns"] for e in events] == sorted(e["timestamp_ns"] for e in events)
    few = []
    live.subscribe(live.events(spark, base), few.append, str(tmp_path / "few"), backlog=3).awaitTermination(60)
    times = sorted(e["timestamp_ns"] for e in events)
    assert [json.loads(t)["timestamp_ns"] for t in few[-1]] == times[-3:] and sum(map(len, few)) < 12
