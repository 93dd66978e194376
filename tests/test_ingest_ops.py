"""Validation, flatten and metadata rules on small requests (the reference's
mapper, service and integration cases re-expressed as DataFrame tests)."""

from pyspark.sql import functions as F

from metricmart.operators.flatten import dropped_points, flatten_points, gauge_rows, sum_rows
from metricmart.operators.metadata import metadata_rows, series_current
from metricmart.operators.validate import split_valid
from metricmart.plans.store import MetricTables
from metricmart.sources.samples import (NOW, gauge, histogram, i, kv, point, request, s,
                                        sample_request, sum_metric)

SVC = [kv("service.name", s("my-service"))]


def _tables(reqs, *docs):
    return MetricTables.from_requests(reqs(*docs))


def test_sample_request(reqs):
    t = _tables(reqs, sample_request())
    g, sm = t.gauge.collect(), t.sum.collect()
    assert len(g) == 1 and g[0].value == 42.5
    assert len(sm) == 1 and sm[0].value == 1234.0 and sm[0].aggregation_temporality == 2
    meta = t.metadata.collect()
    assert {m.metric_name for m in meta} == {"cpu.utilization", "requests.total"}
    assert {m.metric_hash for m in meta} == {g[0].metric_hash, sm[0].metric_hash}
    by_name = {m.metric_name: m for m in meta}
    assert by_name["cpu.utilization"].metric_hash == -3196380439279096565
    assert by_name["requests.total"].metric_hash == 5193599659133778942
    assert by_name["cpu.utilization"].service_name == "my-test-service"
    assert by_name["cpu.utilization"].scope_name == "sample-scope"


def test_gauge_fields_copied(reqs):
    doc = request([gauge("cpu.usage", [point(NOW, 42.5, [kv("cpu", i(0))], start=NOW - 60 * 10**9,
                                              flags=3)], "CPU usage", "{unit}")],
                  resource_attrs=SVC, scope=("test-scope", "1.0"))
    t = _tables(reqs, doc)
    g = t.gauge.first()
    assert (g.start_time_unix_nano, g.time_unix_nano, g.value, g.flags) == \
        (NOW - 60 * 10**9, NOW, 42.5, 3)
    m = t.metadata.first()
    assert (m.metric_description, m.metric_unit, m.metric_type, m.scope_version) == \
        ("CPU usage", "{unit}", "Gauge", "1.0")
    assert m.attributes == {"cpu": "0"} and m.metric_hash == g.metric_hash
    assert m.metric_hash == 1230990460350513695


def test_three_points_one_metadata(reqs):
    doc = request([gauge("g", [point(NOW), point(NOW + 1), point(NOW + 2)])], SVC)
    t = _tables(reqs, doc)
    assert t.gauge.count() == 3 and t.metadata.count() == 1
    assert t.gauge.select("metric_hash").distinct().count() == 1


def test_int_and_unset_values(reqs):
    doc = request([gauge("a", [point(NOW, 42)]), gauge("b", [point(NOW)])], resource=False)
    vals = {r.metric_name: r.value for r in _tables(reqs, doc).points.collect()}
    assert vals == {"a": 42.0, "b": 0.0}


def test_sum_fields(reqs):
    doc = request([sum_metric("requests.total", [point(NOW, 100.0)], temporality=2,
                              monotonic=True)], SVC)
    r = _tables(reqs, doc).sum.first()
    assert (r.value, r.aggregation_temporality, r.is_monotonic) == (100.0, 2, True)


def test_type_routing(reqs):
    doc = request([sum_metric("s", [point(NOW, 1.0)])], SVC)
    t = _tables(reqs, doc)
    assert t.gauge.count() == 0 and t.sum.count() == 1


def test_unimplemented_types_dropped_and_counted(reqs):
    only_hist = request([histogram("h")], SVC)
    mixed = request([gauge("g", [point(NOW, 7.0)]), histogram("h")], SVC, seq=2)
    r = reqs(only_hist, mixed)
    t = MetricTables.from_requests(r)
    assert t.gauge.count() == 1 and t.sum.count() == 0 and t.metadata.count() == 1
    assert t.rejected.count() == 0
    d = dropped_points(r).groupBy("metric_type").agg(F.sum("points")).collect()
    assert [(x[0], x[1]) for x in d] == [("Histogram", 2)]


def test_validation_rules(reqs):
    ok = request([gauge("ok", [point(NOW)])], SVC, seq=1)
    empty_name = request([gauge("fine", [point(NOW)]), gauge("", [point(NOW)])], SVC, seq=2)
    gauge_zero = request([gauge("cpu.usage", [point(NOW), point(0)])], SVC, seq=3)
    sum_zero = request([sum_metric("requests.total", [point(0)])], SVC, seq=4)
    temporality = request([sum_metric("requests.total", [point(0)], temporality=0)], SVC, seq=5)
    delta = request([sum_metric("d", [point(NOW)], temporality=1)], SVC, seq=6)
    empty = {"request_seq": 7, "request_part": 0, "resourceMetrics": []}
    hist_zero = request([histogram("h", t=0)], SVC, seq=8)
    acc, rej = split_valid(reqs(ok, empty_name, gauge_zero, sum_zero, temporality, delta, empty,
                                hist_zero))
    errors = {r.request_seq: r.error for r in rej.collect()}
    assert errors == {
        2: "metric name must not be empty",
        3: 'metric "cpu.usage": data point 1 has time_unix_nano=0 (required by OTLP spec)',
        4: 'metric "requests.total": data point 0 has time_unix_nano=0 (required by OTLP spec)',
        5: 'sum metric "requests.total": aggregation_temporality must not be UNSPECIFIED',
    }
    assert sorted(r.request_seq for r in acc.collect()) == [1, 6, 7, 8]
    # a rejected request writes nothing, not even its valid metric
    t = MetricTables.from_requests(reqs(empty_name))
    assert t.gauge.count() == 0 and t.metadata.count() == 0


def test_service_name_edge_cases(reqs):
    docs = [request([gauge("a", [point(NOW)])], resource=False, seq=1),
            request([gauge("b", [point(NOW)])], resource_attrs=[], seq=2),
            request([gauge("c", [point(NOW)])], resource_attrs=[kv("host.name", s("h"))], seq=3),
            request([gauge("d", [point(NOW)])], resource_attrs=[kv("service.name", i(5))], seq=4)]
    got = {r.metric_name: r.service_name for r in _tables(reqs, *docs).metadata.collect()}
    assert got == {"a": "", "b": "", "c": "", "d": ""}


def test_nil_resource_golden_hash(reqs):
    doc = request([gauge("nil.resource.gauge", [point(NOW, 1.0)])], resource=False)
    assert _tables(reqs, doc).gauge.first().metric_hash == 3023003608998065792


def test_keep_first_within_request_last_across(reqs):
    # same series twice in one request with different scope versions: first wins
    doc1 = request([gauge("g", [point(NOW)])], SVC, scope=("sc", "v1"), seq=1)
    doc1["resourceMetrics"][0]["scopeMetrics"].append(
        {"scope": {"name": "sc", "version": "v2"}, "metrics": [gauge("g", [point(NOW + 1)])]})
    t = _tables(reqs, doc1)
    assert [m.scope_version for m in t.metadata.collect()] == ["v1"]
    # across requests the last inserted description wins
    a = request([gauge("last.gauge", [point(NOW, 1.0)], "v1 description")], SVC, seq=1)
    b = request([gauge("last.gauge", [point(NOW, 1.0)], "v2 description")], SVC, seq=2)
    cur = series_current(_tables(reqs, b, a).metadata).collect()
    assert len(cur) == 1 and cur[0].metric_description == "v2 description"


def test_idempotent_metadata(reqs):
    doc = request([gauge("idempotency.gauge", [point(NOW, 1.0)])], SVC)
    t = _tables(reqs, doc, dict(doc, request_seq=2))
    assert t.gauge.count() == 2                       # points at-least-once (S20)
    assert series_current(t.metadata).count() == 1    # metadata merges


def test_host_evolution_two_series(reqs):
    def mk(host, seq):
        return request([gauge("evo.cpu.usage", [point(NOW, 1.0)])],
                       [kv("service.name", s("evo-service")), kv("host.name", s(host))], seq=seq)
    cur = series_current(_tables(reqs, mk("host-1", 1), mk("host-2", 2)).metadata).collect()
    assert len(cur) == 2
    assert sorted(c.resource_attributes["host.name"] for c in cur) == ["host-1", "host-2"]


def test_same_identity_gauge_and_sum(reqs):
    doc = request([gauge("x", [point(NOW, 1.0)]), sum_metric("x", [point(NOW, 2.0)])], SVC)
    t = _tables(reqs, doc)
    assert t.gauge.count() == 1 and t.sum.count() == 1
    assert t.gauge.first().metric_hash == t.sum.first().metric_hash
    cur = series_current(t.metadata).collect()
    assert len(cur) == 1 and cur[0].metric_type == "Sum"


def test_late_point_own_day(reqs):
    late = NOW - 60 * 86_400 * 10**9
    doc = request([gauge("g", [point(NOW, 1.0), point(late, 2.0)])], SVC)
    t = _tables(reqs, doc)
    days = sorted(str(r.dt) for r in t.gauge.collect())
    assert days == ["2023-09-15", "2023-11-14"]
    assert t.metadata.count() == 2


def test_flatten_matches_stored_columns(reqs):
    t = _tables(reqs, sample_request())
    assert gauge_rows(t.points).columns == ["metric_hash", "start_time_unix_nano",
                                            "time_unix_nano", "ts", "value", "flags", "dt"]
    assert sum_rows(t.points).columns[-3:] == ["aggregation_temporality", "is_monotonic", "dt"]
    assert metadata_rows(flatten_points(reqs(sample_request()))).columns[-2:] == ["ord", "month"]


def test_zero_time_forms(reqs):
    def with_times(seq, *times):
        pts = []
        for t in times:
            p = {"asDouble": 1.0}
            if t is not None:
                p["timeUnixNano"] = t
            pts.append(p)
        return request([gauge("g", pts)], SVC, seq=seq)
    docs = [with_times(1, str(NOW), "00"), with_times(2, str(NOW), ""),
            with_times(3, None), with_times(4, str(NOW), str(NOW + 10)),
            with_times(5, str(NOW), "100")]
    _, rej = split_valid(reqs(*docs))
    got = {r.request_seq: r.error for r in rej.collect()}
    msg = 'metric "g": data point {} has time_unix_nano=0 (required by OTLP spec)'
    assert got == {1: msg.format(1), 2: msg.format(1), 3: msg.format(0)}


def test_times_outside_64_bits_are_rejected(reqs):
    def doc(seq, time, start=None):
        p = {"asDouble": 1.0, "timeUnixNano": time}
        if start is not None:
            p["startTimeUnixNano"] = start
        return request([gauge("g", [point(NOW), p])], SVC, seq=seq)
    good = [doc(1, "18446744073709551615"), doc(2, "00000000000000000000000000000000000000000007"),
            doc(3, str(NOW), "0"), doc(4, str(NOW), "18446744073709551615"), doc(5, str(NOW), "")]
    bad = [doc(11, "18446744073709551616"), doc(12, "9" * 25), doc(13, "9" * 60), doc(14, "-5"), doc(15, "1e3"),
           doc(16, "12x"), doc(17, str(NOW), "1" * 20 + "9"), doc(18, str(NOW), "x")]
    requests = reqs(*good, *bad)
    accepted, rejected = split_valid(requests)
    msg = 'metric "g": data point 1 has a time outside unsigned 64 bits'
    assert {r.request_seq: r.error for r in rejected.collect()} == {d: msg for d in range(11, 19)}
    # the others of the same batch are flattened
    assert gauge_rows(flatten_points(accepted)).count() == 10


def test_undecodable_bodies_are_rejected(spark, scratch):
    import json

    from metricmart.sources.requests import MSG_UNDECODABLE, parse_requests, read_requests
    good = json.dumps(request([gauge("g", [point(NOW)])], SVC, seq=1))
    with open(scratch + "/in.json", "w") as f:
        f.write("\n".join([good, "{not json", '{"request_seq": 2}', '{"request_seq": 3, "resourceMetrics": "x"}']) + "\n")
    accepted, rejected = split_valid(read_requests(spark, scratch + "/in.json"))
    assert [r.error for r in rejected.collect()] == [MSG_UNDECODABLE] * 2
    assert accepted.count() == 2 and gauge_rows(flatten_points(accepted)).count() == 1
    bodies = spark.createDataFrame([(1, good), (2, "{"), (3, None), (4, "{}")], "seq long, value string")
    accepted, rejected = split_valid(parse_requests(bodies, "value", "seq"))
    assert sorted(r.request_seq for r in rejected.collect()) == [2, 3] and accepted.count() == 2


def test_repeated_attribute_keys_keep_the_last(reqs):
    from metricmart.functions import attribute_entries, entries_to_map
    attrs = [{"key": k, "value": {"stringValue": v}} for k, v in [("a", "1"), ("b", "2"), ("a", "3"), ("c", "4"), ("b", "5")]]
    df = reqs(request([gauge("g", [point(NOW)])], attrs))
    got = df.select(F.explode("resourceMetrics").alias("rm")).select(
        attribute_entries("rm.resource.attributes").alias("e")).select(entries_to_map("e").alias("m")).first().m
    assert got == {"a": "3", "b": "5", "c": "4"}


def test_requests_without_sequence_stay_distinct(reqs):
    a = request([gauge("g", [point(NOW)])], SVC, scope=("sc", "v1"))
    b = request([gauge("g", [point(NOW)])], SVC, scope=("sc", "v2"))
    for d in (a, b):
        d.pop("request_seq")
    meta = _tables(reqs, a, b).metadata.collect()
    assert sorted(m.scope_version for m in meta) == ["v1", "v2"]
    assert len({m.ord.request_seq for m in meta}) == 2


def test_random_identities_match_python_model(reqs):
    import random

    import xxhash
    rnd = random.Random(2024)
    alphabet = ["a", "b", "é", "✓", "\x01", "\x02", " ", "Z", "0"]

    def word():
        return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 4)))

    def attrs():
        return [kv(rnd.choice(["k", "K", "ké", "z", "a.b"]), s(word()))
                for _ in range(rnd.randint(0, 5))]

    def text(lst):
        m = {}
        for a in lst:
            m[a["key"]] = a["value"]["stringValue"]            # last duplicate wins
        return "\x01".join(f"{k}\x02{v}" for k, v in sorted(m.items()))

    docs, expected = [], {}
    for seq in range(60):
        res, pt = attrs(), attrs()
        svc = next((a["value"]["stringValue"] for a in res if a["key"] == "service.name"), "")
        name = "m" + word()
        docs.append(request([gauge(name, [point(NOW, 1.0, pt)])], res, seq=seq))
        canon = "\x00".join([name, svc, text(res), "", text(pt)])
        u = xxhash.xxh64_intdigest(canon.encode("utf-8"))
        expected[seq] = u - (1 << 64) if u >= 1 << 63 else u
    got = {r.request_seq: r.metric_hash for r in _tables(reqs, *docs).points.collect()}
    assert got == expected


def _shuffled_types(df):
    """Types of the columns that a repartition of the plan moves."""
    plan, found = df._jdf.queryExecution().optimizedPlan(), []

    def visit(node):
        if "RepartitionByExpression" in node.getClass().getSimpleName():
            found.append(node.schema().catalogString())
        for i in range(node.children().size()):
            visit(node.children().apply(i))
    visit(plan)
    return found


def test_bridge_shuffles_events_not_points(spark):
    import datetime

    from metricmart.sources.events_bridge import requests_from_events
    events = spark.createDataFrame([(5, datetime.datetime(2024, 1, 1, 0, 0, 5), 3, "click", 1.5, '{"k": 12}')],
                                   "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    moved = _shuffled_types(requests_from_events(events))
    assert len(moved) == 1 and "props:string" in moved[0] and "array<" not in moved[0]


def test_no_level_is_copied_with_its_elements(reqs):
    from metricmart.operators.flatten import flatten_batch
    from metricmart.operators.validate import with_validation
    plan = flatten_batch(with_validation(reqs(request([gauge("g", [point(NOW)])], [kv("service.name", s("a"))]))))._jdf.queryExecution().sparkPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate posexplode" in line]
    kept = [line.split(", [", 1)[1].split("]", 1)[0] for line in generates]
    assert len(kept) == 4
    assert not any(c.split("#")[0].strip() in ("rm", "sm", "m", "points", "metrics", "scopes") for k in kept for c in k.split(","))
