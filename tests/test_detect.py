import hashlib
import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import rules, values
from emberline.operators import detect

NOW = 1_700_000_000_000  # ms
SCHEMA = "instance int, batch_id long, ord long, arrival_us long, trace_id string, name string, start_ns long, end_ns long, status_code int, attrs array<struct<key:string,json:string>>"


def span(**k):
    base = {"instance": 0, "batch_id": 0, "ord": 0, "arrival_us": NOW * 1000, "trace_id": "0" * 31 + "1", "name": "op", "start_ns": 0, "end_ns": 0, "status_code": 1, "attrs": {}}
    row = base | k
    row["attrs"] = list(row["attrs"].items())
    return tuple(row.values())


@pytest.fixture()
def spans(spark):
    def make(rows):
        table = spark.createDataFrame(rows, SCHEMA)
        return table.withColumn("attributes", F.transform("attrs", lambda a: F.struct(a["key"].alias("key"), F.parse_json(a["json"]).alias("value")))).drop("attrs")

    return make


MS, S, MIN = 10**6, 10**9, 60 * 10**9
T0, EL = "baggage.t0", "baggage.elapsed_ms"


@pytest.mark.parametrize(
    "chain, given, reason, clamped, malformed, divergence",
    [
        ({}, {"status_code": 2}, 1, 0, 0, None), ({}, {}, 0, 0, 0, None), ({"on_error": False}, {"status_code": 2}, 0, 0, 0, None),
        ({"span_latency": 100 * MS}, {"end_ns": 99 * MS}, 0, 0, 0, None), ({"span_latency": 100 * MS}, {"end_ns": 101 * MS}, 2, 0, 0, None), ({"span_latency": 100 * MS}, {"end_ns": 100 * MS}, 0, 0, 0, None),
        ({"span_latency": 1}, {"start_ns": S, "end_ns": 0}, 0, 1, 0, None),
        ({"trace_latency": 2 * S}, {"attrs": {EL: "1999"}}, 0, 0, 0, None), ({"trace_latency": 2 * S}, {"attrs": {EL: '"2001"'}}, 3, 0, 0, None), ({"trace_latency": 2 * S}, {"attrs": {EL: "2000"}}, 0, 0, 0, None),
        ({"trace_age": MIN}, {"attrs": {T0: str(NOW - 120_000)}}, 4, 0, 0, None), ({"trace_age": MIN}, {"attrs": {T0: str(NOW - 60_000)}}, 0, 0, 0, None),
        ({"trace_age": 1}, {"attrs": {T0: str(NOW + 3_600_000)}}, 0, 1, 0, None), ({"trace_latency": 1}, {"attrs": {EL: "-100"}}, 0, 1, 0, None), ({"trace_latency": 1}, {"attrs": {EL: "1"}}, 0, 0, 0, None),
        ({"trace_latency": 3600 * S}, {"attrs": {T0: str(NOW - 10_000), EL: "4000"}}, 0, 0, 0, 6000), ({"trace_latency": 3600 * S}, {"attrs": {T0: str(NOW + 3_600_000), EL: "4000"}}, 0, 1, 0, -4000),
        ({"trace_latency": S}, {"attrs": {EL: '"not-a-number"'}}, 0, 0, 1, None), ({"trace_latency": S}, {"attrs": {EL: "true", T0: '"x"'}}, 0, 0, 1, None),
        ({"span_latency": MS}, {"status_code": 2, "end_ns": S}, 1, 0, 0, None),
    ],
)
def test_chain(spans, chain, given, reason, clamped, malformed, divergence):
    r = detect.detect(spans([span(**given)]), detect.Chain(**chain)).first()
    assert (r.reason, r.clamped, r.malformed, r.divergence) == (reason, clamped, malformed, divergence)


def test_millis(spark):
    cases = [("1234", 1234, True, False), ('"56789"', 56789, True, False), (None, 0, False, False), ("-5", -5, True, False), ('""', 0, False, True), ('"12x4"', 0, False, True), ('"-5"', 0, False, True), ('"99999999999999999999"', 0, False, True), ('"9223372036854775807"', 2**63 - 1, True, False), ('"9223372036854775808"', 0, False, True), ("true", 0, False, True), ('" 5"', 0, False, True), ('"007"', 7, True, False), ("1.5", 0, False, True), ('{"a":1}', 0, False, True)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, j string")
    for r in rows.select("i", values.read_millis(F.parse_json("j")).alias("m")).collect():
        assert tuple(r.m) == cases[r.i][1:], cases[r.i]


def test_thresholds():
    assert [values.threshold_millis(x) for x in (0, 1, 999_999, 1_500_000, 2 * S)] == [0, 1, 1, 1, 2000]
    assert [values.baseline_threshold(x) for x in (0, -1, math.nan, 1, 0.5)] == [0, 0, 0, 1 << 56, 1 << 55]


def test_baseline(spark):
    ids = spark.createDataFrame([("ff" * 8 + "ff" + "00" * 7,), ("00" * 9 + "7fffffffffffff",), ("00" * 9 + "80000000000000",), ("00" * 9 + "ffffffffffffff",)], "t string")
    assert [r[0] for r in ids.select(values.in_baseline(F.col("t"), 0.5)).collect()] == [True, True, False, False]
    assert [r[0] for r in ids.select(values.in_baseline(F.col("t"), 1.0)).collect()] == [True] * 4
    many = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("t"))
    assert 1800 < many.where(values.in_baseline(F.col("t"), 0.01)).count() < 2200


def test_policies(spans):
    rows = [span(), span(ord=1, attrs={"db.system": '"postgres"', "a": '{"k":"v"}'}), span(ord=2, name="hit", attrs={"a": "7"}), span(ord=3, name="kept", attrs={"a": '"x"'}), span(ord=4, end_ns=200 * MS, attrs={"a": '"6"'})]

    def run(*policies):
        out = detect.detect(spans(rows), detect.Chain(False, policies=[(str(i), p) for i, p in enumerate(policies)])).orderBy("ord").collect()
        return [(r.policy, r.policy_errors) for r in out]

    assert [p for p, _ in run('span.attributes["db.system"] == "postgres"')] == [None, 0, None, None, None]
    assert [p for p, _ in run('span.name == "hit"', 'span.name != ""')] == [1, 1, 0, 1, 1]
    assert run('Int(span.attributes["a"]) > 5', 'span.name == "kept"') == [(None, []), (None, [0]), (0, []), (1, []), (0, [])]
    assert [p for p, _ in run("span.end_time_unix_nano - span.start_time_unix_nano > 100000000")] == [None, None, None, None, 0]
    assert [p for p, _ in run('IsMatch(span.name, "^(hit|kept)$") and not (span.name == "kept")')] == [None, None, 0, None, None]
    assert [p for p, _ in run('span.attributes["a"] == nil or resource.attributes["r"] != nil')] == [0, None, None, None, None]
    assert [p for p, _ in run('span.attributes["a"] > 6 or span.attributes["a"] == "x"')] == [None, None, 0, 0, None]
    errors = detect.detect(spans([span(status_code=2)]), detect.Chain(policies=[("any", 'span.name != ""')])).first()
    assert errors.reason == 1 and errors.policy is None


def test_functions(spans):
    """Each condition holds for the first span, and doesn't for the second, where its function fails or differs."""
    a = {"t": '" Ab-cd "', "n": "-7", "m": '{"k":1}', "l": "[1]", "d": '"x"'}
    rows = [span(name="Checkout", start_ns=1_700_000_000 * S, end_ns=1_700_000_005 * S + 7, attrs=a), span(ord=1, name="x", start_ns=5, end_ns=6, attrs={"t": "3", "n": '"y"', "m": "1", "l": '"[]"'})]
    conditions = [
        'HasPrefix(span.name, "Check")', 'HasSuffix(span.name, "out")', 'HasPrefix(span.attributes["t"], " A")', 'Substring(span.name, 0, 5) == "Check"', 'Substring(span.name, 5, 3) == "out"',
        'ToUpperCase(span.name) == "CHECKOUT"', 'ToLowerCase(span.name) == "checkout"', 'ConvertCase(span.name, "upper") == "CHECKOUT"', 'Trim(span.attributes["t"]) == "Ab-cd"', 'Index(span.name, "out") == 5',
        'Abs(span.attributes["n"]) == 7', 'IsMap(span.attributes["m"])', 'IsList(span.attributes["l"])', f'MD5(span.name) == "{hashlib.md5(b"Checkout").hexdigest()}"', f'SHA1(span.name) == "{hashlib.sha1(b"Checkout").hexdigest()}"',
        f'SHA256(span.name) == "{hashlib.sha256(b"Checkout").hexdigest()}"', 'span.end_time_unix_nano - span.start_time_unix_nano > Duration("5s")', 'Seconds(span.end_time_unix_nano - span.start_time_unix_nano) == 5',
        'Milliseconds(span.end_time_unix_nano - span.start_time_unix_nano) == 5000', "UnixSeconds(span.start_time_unix_nano) == 1700000000", "UnixMilli(span.start_time_unix_nano) == 1700000000000", "Unix(1700000000) == span.start_time_unix_nano",
        "UnixNano(span.start_time_unix_nano) > 1000", "UnixMicro(span.start_time_unix_nano) == 1700000000000000", "Microseconds(span.end_time_unix_nano) > 1000", "Nanoseconds(span.end_time_unix_nano) > 1000", 'Len(Concat(span.name, "!")) == 9',
    ]
    table = spans(rows)
    look = detect.lookup(table)
    compiled = [rules.compile_condition(c).columns(look) for c in conditions]
    first, second = table.select("ord", F.array(*[m for m, _ in compiled]).alias("m")).orderBy("ord").collect()
    assert [c for c, m in zip(conditions, first.m) if not m] == [] and [c for c, m in zip(conditions, second.m) if m] == []
    failing = ['Substring(span.name, 5, 3) == "out"', 'Trim(span.attributes["t"]) == ""', 'Abs(span.attributes["n"]) > 0', 'HasPrefix(span.attributes["m"], "x")']
    errors = table.where("ord = 1").select(F.array(*[rules.compile_condition(c).columns(look)[1] for c in failing]).alias("e")).first().e
    assert errors == [True] * 4
    for bad in ('ConvertCase(span.name, "title") == ""', 'Duration(span.name) > 1', 'Duration("soon") > 1', 'Substring(span.name, span.kind, 1) == ""', "HasPrefix(span.name)"):
        with pytest.raises(ValueError):
            rules.compile_condition(bad)


@pytest.mark.parametrize("text", ["span.name ==", "nonsense(((", 'IsMatch(span.name, "(")', "span.colour == 1", "Int()", "1 + 2", "span.name", 'span.attributes[name] == "x"', "true true", '"open', ""])
def test_bad_conditions(text):
    with pytest.raises(ValueError):
        rules.compile_condition(text)


def test_groups(spans):
    a, b, c = ("0" * 31 + x for x in "123")
    rows = [span(ord=i, trace_id=t, arrival_us=i, status_code=2 if i in (2, 4) else 1, end_ns=S if i == 0 else 0) for i, t in enumerate([a, b, a, c, b, a])]
    out = detect.detect(spans(rows), detect.Chain(span_latency=MS))
    got = {r.trace_id: (r.reason, r.ord, r.spans, r.at_us) for r in detect.verdicts(out).collect()}
    # The first hit in order counts, not the strongest.
    assert got == {a: (2, 0, 3, 0), b: (1, 4, 2, 4), c: (0, 3, 1, 3)}
    got = {r.trace_id: (r.reason, r.base) for r in detect.verdicts(out, 1.0).collect()}
    assert got == {a: (2, True), b: (1, True), c: (6, True)}


def test_wire(spark):
    rows = spark.createDataFrame([("ab" * 16, 3)], "t string, r int").select(values.encode_keep(F.col("t"), F.col("r")).alias("p"))
    assert rows.first().p == bytes.fromhex("ab" * 16) + b"\x03"
    lengths = spark.createDataFrame([(bytes(16),), (bytes(17),), (bytes(15),), (bytes(18),)], "p binary").select(values.decode_keep(F.col("p")).alias("k")).collect()
    assert [None if r.k is None else tuple(r.k) for r in lengths] == [("00" * 16, 0), ("00" * 16, 0), None, None]
