"""OTLP trace messages in protobuf, by way of their JSON form.

The messages are described from OTLP's published field numbers, so no generated code is needed; the protobuf
runtime has to be installed where Python runs.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import ship
from emberline.sources import otlp_json

# Messages with the names, numbers and types of their fields; a trailing * repeats.
MESSAGES = {
    "TracesData": "resource_spans 1 ResourceSpans*",
    "ResourceSpans": "resource 1 Resource, scope_spans 2 ScopeSpans*, schema_url 3 string",
    "ScopeSpans": "scope 1 InstrumentationScope, spans 2 Span*, schema_url 3 string",
    "Resource": "attributes 1 KeyValue*, dropped_attributes_count 2 uint32",
    "InstrumentationScope": "name 1 string, version 2 string, attributes 3 KeyValue*, dropped_attributes_count 4 uint32",
    "Span": "trace_id 1 bytes, span_id 2 bytes, trace_state 3 string, parent_span_id 4 bytes, name 5 string, kind 6 int32, start_time_unix_nano 7 fixed64, end_time_unix_nano 8 fixed64, "
    "attributes 9 KeyValue*, dropped_attributes_count 10 uint32, events 11 Event*, dropped_events_count 12 uint32, links 13 Link*, dropped_links_count 14 uint32, status 15 Status, flags 16 fixed32",
    "Event": "time_unix_nano 1 fixed64, name 2 string, attributes 3 KeyValue*, dropped_attributes_count 4 uint32",
    "Link": "trace_id 1 bytes, span_id 2 bytes, trace_state 3 string, attributes 4 KeyValue*, dropped_attributes_count 5 uint32, flags 6 fixed32",
    "Status": "message 2 string, code 3 int32",
    "KeyValue": "key 1 string, value 2 AnyValue",
    "AnyValue": "string_value 1 string, bool_value 2 bool, int_value 3 int64, double_value 4 double, array_value 5 ArrayValue, kvlist_value 6 KeyValueList, bytes_value 7 bytes",
    "ArrayValue": "values 1 AnyValue*",
    "KeyValueList": "values 1 KeyValue*",
}
IDS = ("traceId", "spanId", "parentSpanId")


@functools.cache
def traces_data():
    """The class of the outermost message."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    file = descriptor_pb2.FileDescriptorProto(name="emberline_otlp.proto", package="emberline.otlp", syntax="proto3")
    for name, fields in MESSAGES.items():
        m = file.message_type.add(name=name)
        if name == "AnyValue":
            m.oneof_decl.add(name="value")
        for field in fields.split(", "):
            label, number, kind = field.split(" ")
            f = m.field.add(name=label, number=int(number), label=3 if kind.endswith("*") else 1)
            kind = kind.rstrip("*")
            if kind in MESSAGES:
                f.type, f.type_name = descriptor_pb2.FieldDescriptorProto.TYPE_MESSAGE, f".emberline.otlp.{kind}"
            else:
                f.type = getattr(descriptor_pb2.FieldDescriptorProto, f"TYPE_{kind.upper()}")
            if name == "AnyValue":
                f.oneof_index = 0
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("emberline.otlp.TracesData"))


def _ids(tree, change) -> None:
    """Applies change to every id below."""
    if isinstance(tree, dict):
        for k, v in tree.items():
            if k in IDS and isinstance(v, str):
                tree[k] = change(v)
            else:
                _ids(v, change)
    elif isinstance(tree, list):
        for x in tree:
            _ids(x, change)


def to_json(payload: bytes) -> str | None:
    """A message as OTLP's JSON, whose ids are hexadecimal; None for what isn't a message."""
    from google.protobuf import json_format

    m = traces_data()()
    try:
        m.ParseFromString(payload)
    except Exception:  # the runtime's own error types differ by version
        return None
    tree = json_format.MessageToDict(m)
    _ids(tree, lambda x: base64.b64decode(x).hex())
    return json.dumps(tree)


def from_json(text: str) -> bytes:
    from google.protobuf import json_format

    tree = json.loads(text)
    _ids(tree, lambda x: base64.b64encode(bytes.fromhex(x)).decode())
    return json_format.ParseDict(tree, traces_data()(), ignore_unknown_fields=True).SerializeToString()


def _decoded(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in column:
        yield x.map(lambda p: None if p is None else to_json(bytes(p)))


def _encoded(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in column:
        yield x.map(lambda t: None if t is None else from_json(t))


def decode(messages: DataFrame, column: str = "payload") -> DataFrame:
    """messages with a column json; null where the bytes aren't a message, to be counted as corrupt."""
    ship(messages.sparkSession)
    return messages.withColumn("json", F.pandas_udf(_decoded, "string")(column))


def spans(messages: DataFrame, column: str = "payload") -> DataFrame:
    """One row per span of messages (batch_id and the bytes)."""
    return otlp_json.parsed(decode(messages, column).select("batch_id", "json"))


def encode(groups: DataFrame) -> DataFrame:
    """What otlp_json.regrouped gives, with payload as protobuf bytes."""
    ship(groups.sparkSession)
    return groups.withColumn("payload", F.pandas_udf(_encoded, "binary")("payload"))
