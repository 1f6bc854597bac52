"""Spans from and to OTLP in JSON, one export request per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string,arrayValue:variant,kvlistValue:variant>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_EVENT = f"struct<timeUnixNano:string,name:string,attributes:{_ATTRIBUTES},droppedAttributesCount:bigint>"
_LINK = f"struct<traceId:string,spanId:string,traceState:string,attributes:{_ATTRIBUTES},droppedAttributesCount:bigint,flags:bigint>"
_SPAN = (
    f"struct<traceId:string,spanId:string,parentSpanId:string,traceState:string,flags:bigint,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},"
    f"droppedAttributesCount:bigint,events:array<{_EVENT}>,droppedEventsCount:bigint,links:array<{_LINK}>,droppedLinksCount:bigint,status:struct<code:int,message:string>>"
)
_SCOPE = f"struct<scope:struct<name:string,version:string,attributes:{_ATTRIBUTES},droppedAttributesCount:bigint>,spans:array<{_SPAN}>,schemaUrl:string>"
SCHEMA = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES},droppedAttributesCount:bigint>,scopeSpans:array<{_SCOPE}>,schemaUrl:string>>"


def _variant(v: Column) -> Column:
    """A value as a variant; one that is there but empty is a variant null."""
    plain = F.coalesce(
        v["stringValue"].cast("variant"), v["boolValue"].cast("variant"), v["intValue"].cast("bigint").cast("variant"), v["doubleValue"].cast("variant"),
        F.unbase64(v["bytesValue"]).cast("variant"), v["arrayValue"], v["kvlistValue"],
    )
    return F.coalesce(plain, F.parse_json(F.lit("null")))


def _attributes(column: Column) -> Column:
    return F.transform(F.coalesce(column, F.array().cast(_ATTRIBUTES)), lambda a: F.struct(a["key"].alias("key"), _variant(a["value"]).alias("value")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per span, in the order of files' lines; a line that isn't JSON gives none."""
    return parsed(spark.read.text(path).select(F.monotonically_increasing_id().alias("batch_id"), F.col("value").alias("json")))


def parsed(requests: DataFrame) -> DataFrame:
    """One row per span of requests (batch_id, json)."""
    lines = requests.select("batch_id", F.from_json("json", SCHEMA).alias("r"))
    resources = lines.select("batch_id", F.posexplode("r.resourceSpans").alias("rp", "rs"))
    scopes = resources.select("batch_id", "rp", "rs", F.posexplode("rs.scopeSpans").alias("sp", "ss"))
    spans = scopes.select("batch_id", "rp", "rs", "sp", "ss", F.posexplode("ss.spans").alias("p", "s"))
    return spans.select(
        "batch_id", F.col("rp").alias("resource_pos"), F.col("sp").alias("scope_pos"), F.col("p").alias("pos"),
        F.lower("s.traceId").alias("trace_id"), F.lower("s.spanId").alias("span_id"), F.nullif(F.lower("s.parentSpanId"), F.lit("")).alias("parent_span_id"),
        F.col("s.traceState").alias("trace_state"), F.col("s.name").alias("name"), F.coalesce("s.kind", F.lit(0)).alias("kind"),
        F.coalesce(F.col("s.startTimeUnixNano").cast("bigint"), F.lit(0)).alias("start_ns"), F.coalesce(F.col("s.endTimeUnixNano").cast("bigint"), F.lit(0)).alias("end_ns"),
        F.coalesce("s.flags", F.lit(0)).alias("flags"), F.coalesce("s.status.code", F.lit(0)).alias("status_code"), F.coalesce("s.status.message", F.lit("")).alias("status_message"),
        _attributes(F.col("s.attributes")).alias("attributes"), _attributes(F.col("rs.resource.attributes")).alias("resource_attributes"),
        F.coalesce("ss.scope.name", F.lit("")).alias("scope_name"), F.coalesce("ss.scope.version", F.lit("")).alias("scope_version"), _attributes(F.col("ss.scope.attributes")).alias("scope_attributes"),
        F.coalesce(F.size("s.events"), F.lit(0)).alias("n_events"), F.coalesce(F.size("s.links"), F.lit(0)).alias("n_links"),
        F.to_json("s").alias("span_json"), F.to_json("rs.resource").alias("resource_json"), F.to_json("ss.scope").alias("scope_json"),
        F.coalesce("rs.schemaUrl", F.lit("")).alias("resource_schema_url"), F.coalesce("ss.schemaUrl", F.lit("")).alias("scope_schema_url"),
    )


def regrouped(spans: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and payload (JSON of an export request): a group's spans in order; runs of the same resource, and within
    them of the same scope, are written once. Resources that come again later aren't merged."""
    by = Window.partitionBy(*keys).orderBy(*order)
    r, s = ["resource_json", "resource_schema_url"], ["scope_json", "scope_schema_url"]
    moved = lambda columns: F.coalesce(F.greatest(*[(~F.col(c).eqNullSafe(F.lag(c).over(by))).cast("int") for c in columns]), F.lit(1))
    runs = spans.withColumn("__place", F.row_number().over(by)).withColumn("__r", moved(r)).withColumn("__s", F.greatest(F.col("__r"), moved(s)))
    runs = runs.withColumn("__rr", F.sum("__r").over(by)).withColumn("__ss", F.sum("__s").over(by))
    joined = lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))
    ordered = lambda at, x: F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), x.alias("x")))), lambda y: y["x"])
    scope = runs.groupBy(*keys, "__rr", "__ss").agg(joined(ordered("__place", F.col("span_json"))).alias("spans"), *[F.min(c).alias(c) for c in r + s])
    url = lambda c: F.when(F.col(c) != "", F.concat(F.lit(',"schemaUrl":'), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))).otherwise("")
    scope = scope.withColumn("x", F.concat(F.lit('{"scope":'), F.coalesce("scope_json", F.lit("{}")), F.lit(',"spans":'), F.col("spans"), url("scope_schema_url"), F.lit("}")))
    resource = scope.groupBy(*keys, "__rr").agg(joined(ordered("__ss", F.col("x"))).alias("scopes"), *[F.min(c).alias(c) for c in r])
    resource = resource.withColumn("x", F.concat(F.lit('{"resource":'), F.coalesce("resource_json", F.lit("{}")), F.lit(',"scopeSpans":'), F.col("scopes"), url("resource_schema_url"), F.lit("}")))
    return resource.groupBy(*keys).agg(F.concat(F.lit('{"resourceSpans":'), joined(ordered("__rr", F.col("x"))), F.lit("}")).alias("payload"))


def write(spans: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    regrouped(spans, keys, order).select("payload").write.mode("append").text(path)
