import json

import numpy as np
from pyspark.sql import functions as F

from emberline.operators import detect
from emberline.sources import generator, otlp_json, tables


def test_splitmix_vectors():
    assert [f"{x:016X}" for x in generator.splitmix_sequence(0, 0, 3).tolist()] == ["E220A8397B1DCDAF", "6E789E6AA1B965F4", "06C45D188009454F"]
    assert generator.splitmix_sequence(9, 5, 2).tolist() == generator.splitmix_sequence(9, 0, 7).tolist()[5:]
    assert generator.percent_bounds(10, 33, 33, 34) == [3, 4, 3]


def test_generated_load(spark):
    made = generator.generate(spark, 10, 4, 2, errors=3, slow=2, late=1)
    assert {r.instance: r["count"] for r in made.groupBy("instance").count().collect()} == {0: 20, 1: 20}
    hits = detect.detect(made, detect.Chain(span_latency=500_000_000, trace_latency=1_000_000_000)).where("reason > 0")
    assert {(r["class"], r.reason): r["count"] for r in hits.groupBy("class", "reason").count().collect()} == {("error", 1): 3, ("slow", 2): 2, ("trace_latency", 3): 1}
    assert made.select("trace_id").distinct().count() == 10
    assert generator.generate(spark, 0, 4, 2).count() == 0


def _span(t, name, **more):
    return {"traceId": t * 32, "spanId": "ab" * 8, "name": name, "startTimeUnixNano": "5", "endTimeUnixNano": "9"} | more


def test_otlp_json_round_trip(spark, tmp_path):
    attributes = [{"key": "s", "value": {"stringValue": "x"}}, {"key": "b", "value": {"boolValue": True}}, {"key": "i", "value": {"intValue": "-7"}}, {"key": "z", "value": {"intValue": "0"}}, {"key": "d", "value": {"doubleValue": 3.5}}, {"key": "l", "value": {"arrayValue": {"values": [{"stringValue": "in"}]}}}]
    a = {"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "a"}}]}, "scopeSpans": [{"scope": {"name": "lib", "version": "1"}, "spans": [_span("1", "p", attributes=attributes, status={"code": 2, "message": "boom"}, kind=2), _span("2", "q")]}]}
    b = {"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "b"}}]}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [_span("1", "r")]}], "schemaUrl": "u"}
    (tmp_path / "in.json").write_text(json.dumps({"resourceSpans": [a, b]}) + "\nnot json\n")
    spans = otlp_json.read(spark, str(tmp_path / "in.json"))
    rows = {r.name: r for r in spans.withColumn("seen", F.transform("attributes", lambda x: F.concat(x["key"], F.lit("="), F.to_json(x["value"])))).drop("attributes", "resource_attributes", "scope_attributes").collect()}
    assert set(rows) == {"p", "q", "r"} and rows["p"].status_code == 2 and rows["p"].kind == 2 and rows["p"].parent_span_id is None and rows["r"].resource_schema_url == "u"
    assert rows["p"].seen[:5] == ['s="x"', "b=true", "i=-7", "z=0", "d=3.5"]
    kept = detect.detect(spans.withColumn("arrival_us", F.lit(0)), detect.Chain(policies=[("a", 'resource.attributes["service.name"] == "b"')]))
    assert {r.name: r.reason for r in kept.select("name", "reason").collect()} == {"p": 1, "q": 0, "r": 5}
    out = {r.trace_id: json.loads(r.payload) for r in otlp_json.regrouped(spans, ["trace_id"], ["resource_pos", "scope_pos", "pos"]).collect()}
    one = out["1" * 32]["resourceSpans"]
    assert [[s["name"] for s in x["scopeSpans"][0]["spans"]] for x in one] == [["p"], ["r"]] and one[1]["schemaUrl"] == "u"
    assert one[0]["scopeSpans"][0]["spans"][0]["attributes"][:5] == attributes[:5]


def test_tables(spark, tmp_path):
    hour = tables.HOUR_US
    spans = spark.createDataFrame([(0, "a", 5), (0, "b", hour + 1), (1, "c", 3 * hour)], "instance int, trace_id string, arrival_us long")
    path = str(tmp_path / "spans")
    tables.append_spans(spans, path)
    assert {r.trace_id for r in tables.read_spans(spark, path, hour, 3 * hour).collect()} == {"b"}
    assert {r.arrival_hour for r in tables.expired_partitions(spark, path, 4 * hour, 2 * hour).collect()} == {0, 1}
    keeps = spark.createDataFrame([("a", 10), ("a", 10), ("b", 90)], "trace_id string, decided_us long")
    for _ in range(2):  # a retry
        tables.publish(keeps, str(tmp_path / "keeps"), 1)
    got = tables.subscribe(spark, str(tmp_path / "keeps"), 100, 50)
    assert [(r.trace_id) for r in got.collect()] == ["b"] and tables.subscribe(spark, str(tmp_path / "keeps"), 100, 95).count() == 2


def test_otlp_protobuf_round_trip(spark):
    from emberline.sources import otlp_proto

    value = {"kvlistValue": {"values": [{"key": "k", "value": {"bytesValue": "AQI="}}]}}
    span = _span("a", "p", attributes=[{"key": "z", "value": {"intValue": "0"}}, {"key": "m", "value": value}, {"key": "e", "value": {"stringValue": ""}}], flags=257, status={"message": "boom", "code": 2}, events=[{"timeUnixNano": "3", "name": "x"}], links=[{"traceId": "cd" * 16, "spanId": "ef" * 8}], droppedAttributesCount=3)
    tree = {"resourceSpans": [{"resource": {"attributes": [{"key": "s", "value": {"stringValue": "a"}}]}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span]}], "schemaUrl": "u"}]}
    payload = otlp_proto.from_json(json.dumps(tree))
    assert json.loads(otlp_proto.to_json(payload)) == tree and otlp_proto.to_json(b"\xff\xff\xff") is None
    # Field 1 of the outermost message, then its length.
    assert payload[0] == 0x0A and payload[1:3] == bytes([(len(payload) - 3) & 0x7F | 0x80, (len(payload) - 3) >> 7])
    messages = spark.createDataFrame([(1, payload), (2, b"\xff\xff\xff")], "batch_id long, payload binary")
    spans = otlp_proto.spans(messages)
    row = spans.select("batch_id", "trace_id", "status_code", "n_events", "n_links", "flags").collect()
    assert [tuple(r) for r in row] == [(1, "a" * 32, 2, 1, 1, 257)]
    back = otlp_proto.encode(otlp_json.regrouped(spans, ["trace_id"], ["pos"])).first().payload
    got = json.loads(otlp_proto.to_json(bytes(back)))["resourceSpans"][0]["scopeSpans"][0]["spans"][0]
    assert got["traceId"] == "a" * 32 and got["attributes"][0] == span["attributes"][0] and got["status"] == span["status"]


def test_segment_files(spark, tmp_path):
    from emberline.sources import segments

    assert segments.crc32c(b"123456789") == 0xE3069283
    parts = [(bytes([i] * 16), bytes([65 + i]) * (i * 7 + 1)) for i in range(4)]
    whole = segments.finish(parts, 5, 9, 0xABCD)
    (tmp_path / "1.seg").write_bytes(whole)
    body = b"".join(segments.record(*p) for p in parts)
    bounds = [sum(len(segments.record(*p)) for p in parts[:k]) for k in range(5)]
    for cut in range(len(body) + 1):  # torn anywhere, what is whole remains
        found, end = segments.records(body[:cut])
        assert len(found) == sum(b <= cut for b in bounds[1:]) and end == bounds[len(found)]
    (tmp_path / "2.seg").write_bytes(body[:-1])
    damaged = bytearray(body)
    damaged[bounds[1] + segments.HEADER.size] ^= 1
    (tmp_path / "3.seg").write_bytes(bytes(damaged))
    rows = segments.read(spark, str(tmp_path), 0xABCD).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path[-5], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"1": 4, "2": 3, "3": 1}
    assert all(r.finalized and (r.t_min_ns, r.t_max_ns) == (5, 9) for r in by["1"]) and by["2"][0].t_min_ns is None and by["2"][0].bytes_lost > 0
    assert bytes(by["1"][2].fragment) == parts[2][1] and by["1"][2].trace_id == "02" * 16
