"""Scalar functions D1–D8 (table-driven, like the reference's unit tests)."""

import json
import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from metricmart.functions import (attribute_entries, entries_text, entries_to_map, go_float_text,
                                  go_quote, identity_text, metric_hash, nanos_to_date,
                                  service_name, unsigned_nanos)
from metricmart.schemas import ATTRS

# Golden keys: name, service, resource attrs, scope attrs, point attrs -> unsigned xxHash64.
GOLDEN = [
    ("cpu.utilization", "my-test-service", {"service.name": "my-test-service", "host.name": "local"},
     {}, {"cpu": "0"}, 15250363634430455051),
    ("requests.total", "my-test-service", {"service.name": "my-test-service", "host.name": "local"},
     {}, {"method": "GET", "status": "200"}, 5193599659133778942),
    ("m", "svc", {}, {}, {}, 14768412055427045665),
    ("m", "svc", {}, {"scope": "v"}, {}, 6836614085559519660),
    ("m", "svc", {}, {}, {"attr": "v"}, 13341950757063106607),
    ("cpu.usage", "my-service", {"env": "prod", "region": "us-east-1"}, {}, {},
     15338472948829893009),
    ("cpu.usage", "my-service", {"service.name": "my-service"}, {}, {"cpu": "0"},
     1230990460350513695),
    ("e2e.gauge", "e2e-service", {"service.name": "e2e-service"}, {}, {}, 13546633831585390285),
    ("nil.resource.gauge", "", {}, {}, {}, 3023003608998065792),
]


def _text(m):
    return "\x01".join(f"{k}\x02{v}" for k, v in sorted(m.items()))


def _signed(u):
    return u - (1 << 64) if u >= 1 << 63 else u


def test_golden_hashes(spark):
    rows = [(n, s, _text(r), _text(sc), _text(a)) for n, s, r, sc, a, _ in GOLDEN]
    df = spark.createDataFrame(rows, "n string, s string, r string, sc string, a string")
    got = [r.h for r in df.select(metric_hash(identity_text(
        F.col("n"), F.col("s"), F.col("r"), F.col("sc"), F.col("a"))).alias("h")).collect()]
    assert got == [_signed(g[-1]) for g in GOLDEN]


def test_hash_matches_independent_xxhash(spark):
    rnd = random.Random(7)
    texts = ["", "a", "\x00\x01\x02", "héllo ✓", "x" * 5000] + [
        "".join(chr(rnd.randint(0, 0x2FF)) for _ in range(rnd.randint(0, 60))) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.h for r in df.select(metric_hash(F.col("t")).alias("h")).collect()]
    assert got == [_signed(xxhash.xxh64_intdigest(t.encode("utf-8"))) for t in texts]


def _attrs_df(spark, lists):
    docs = [json.dumps({"a": a}) for a in lists]
    return spark.read.schema("a " + ATTRS.simpleString()).json(spark.sparkContext.parallelize(docs))


def test_attribute_values_as_text(spark):
    # null, string, int, double, bool true/false, bytes
    attrs = [{"key": "null"}, {"key": "s", "value": {"stringValue": "hello"}},
             {"key": "i", "value": {"intValue": "42"}}, {"key": "d", "value": {"doubleValue": 3.14}},
             {"key": "t", "value": {"boolValue": True}}, {"key": "f", "value": {"boolValue": False}},
             {"key": "b", "value": {"bytesValue": "AAE="}}, {"key": "n", "value": {"intValue": 7}}]
    m = _attrs_df(spark, [attrs]).select(attribute_entries("a").alias("e")) \
        .select(entries_to_map("e")).first()[0]
    assert m["null"] == "" and m["s"] == "hello" and m["i"] == "42" and m["d"] == "3.14"
    assert m["t"] == "true" and m["f"] == "false" and m["b"] != "" and m["n"] == "7"


def test_duplicate_keys_last_wins_and_null_is_empty(spark):
    dup = [{"key": "k", "value": {"stringValue": "first"}}, {"key": "x", "value": {"intValue": "1"}},
           {"key": "k", "value": {"stringValue": "last"}}]
    rows = _attrs_df(spark, [dup, None, []]).select(attribute_entries("a").alias("e")).select(
        entries_to_map("e").alias("m"), entries_text("e").alias("t")).collect()
    assert rows[0].m == {"k": "last", "x": "1"}
    assert rows[0].t == "k\x02last\x01x\x021"
    assert rows[1].m == {} and rows[2].m == {} and rows[1].t == "" == rows[2].t


def test_attribute_order_does_not_change_text(spark):
    rnd = random.Random(3)
    base = [{"key": f"k{j}", "value": {"stringValue": f"v{j}"}} for j in range(8)]
    lists = []
    for _ in range(10):
        b = base[:]
        rnd.shuffle(b)
        lists.append(b)
    texts = {r.t for r in _attrs_df(spark, lists).select(attribute_entries("a").alias("e"))
             .select(entries_text("e").alias("t")).collect()}
    assert len(texts) == 1


def test_service_name_cases(spark):
    cases = [None, [], [{"key": "other", "value": {"stringValue": "x"}}],
             [{"key": "service.name", "value": {"stringValue": "my-svc"}},
              {"key": "service.name", "value": {"stringValue": "second"}}],
             [{"key": "service.name", "value": {"intValue": "5"}}]]
    got = [r[0] for r in _attrs_df(spark, cases).select(service_name("a")).collect()]
    assert got == ["", "", "", "my-svc", ""]


def _go_g(x):
    """Reference model of Go's %g (shortest repr) for the comparison."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if x == 0:
        return "-0" if math.copysign(1, x) < 0 else "0"
    r = repr(abs(x))
    mant, _, e = r.partition("e")
    ip, _, fp = mant.partition(".")
    raw = ip + fp
    nl = raw.lstrip("0")
    digits = nl.rstrip("0")
    dp = len(ip) + (int(e) if e else 0) - (len(raw) - len(nl))
    exp = dp - 1
    if exp < -4 or exp >= 6:
        out = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + \
            "e" + ("-" if exp < 0 else "+") + "%02d" % abs(exp)
    elif dp <= 0:
        out = "0." + "0" * -dp + digits
    elif dp >= len(digits):
        out = digits + "0" * (dp - len(digits))
    else:
        out = digits[:dp] + "." + digits[dp:]
    return ("-" if x < 0 else "") + out


@pytest.mark.parametrize("x,text", [(42.0, "42"), (3.14, "3.14"), (1e6, "1e+06"),
                                    (1e-5, "1e-05"), (123456.0, "123456"),
                                    (1234567.0, "1.234567e+06"), (0.0001, "0.0001"),
                                    (-2.5, "-2.5"), (1e21, "1e+21"), (float("inf"), "+Inf"),
                                    (float("-inf"), "-Inf"), (float("nan"), "NaN"),
                                    (-0.0, "-0"), (0.0, "0")])
def test_go_float_golden(spark, x, text):
    df = spark.createDataFrame([(x,)], "d double")
    assert df.select(go_float_text("d")).first()[0] == text


def test_go_float_random(spark):
    rnd = random.Random(11)
    vals = [rnd.uniform(-1e3, 1e3) * 10 ** rnd.randint(-15, 15) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "d double")
    got = [(r.d, r.g) for r in df.select("d", go_float_text("d").alias("g")).collect()]
    assert [g for _, g in got] == [_go_g(d) for d, _ in got]


def test_go_quote(spark):
    df = spark.createDataFrame([("cpu.usage",), ('a"b\\c',), ("\n\t\x01",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(go_quote("s")).collect()]
    assert got == ['"cpu.usage"', '"a\\"b\\\\c"', '"\\n\\t\\x01"', '""', '""']


def test_nanos(spark):
    df = spark.createDataFrame([("1704067207179575000",), ("18446744073709551615",), (None,),
                                ("0",), ("86399999999999",)], "s string")
    rows = df.select(unsigned_nanos(F.col("s")).alias("n")) \
        .select("n", nanos_to_date(F.col("n")).alias("d")).collect()
    assert [r.n for r in rows] == [1704067207179575000, -1, 0, 0, 86399999999999]
    assert [str(r.d) for r in rows] == ["2024-01-01", "1969-12-31", "1970-01-01", "1970-01-01",
                                        "1970-01-01"]
