"""Queries over the driver's tables, each with equivalent SQL.

Events are spans (see sources.spans); a user's events are a trace and the retention window is a day. "Now" is the
last arrival. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import values
from emberline.operators import decide, delivery, detect, metrics, retain, retention
from emberline.sources import spans as source

W = 86_400_000_000
SEGMENT = 4000
SHARDS = 4
#: An instance's byte limit of the ladder's queries, and its floor.
LIMIT, FLOOR = 20_000, 20 * W
POLICIES = (
    ("purchases", 'span.name == "purchase"'),
    ("long views", 'span.name == "view" and span.end_time_unix_nano - span.start_time_unix_nano > 20000000'),
    ("high k", 'Int(span.attributes["k"]) > 90'),
)
FULL = detect.Chain(span_latency=100_000_000, trace_latency=50_000_000, trace_age=60_000_000_000, policies=POLICIES, baseline_rate=0.2)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SPANS = """
spans as (
  select cast(event_id % 3 as integer) as instance, event_id // 50 as batch_id, event_id as ord, epoch_us(ts) as arrival_us,
    md5(cast(user_id as varchar)) as trace_id, event_type as name, epoch_us(ts) * 1000 as start_ns,
    case when event_id % 23 = 0 then epoch_us(ts) * 1000 - 1000 else epoch_us(ts) * 1000 + cast(floor(value * 1000) as bigint) * 1000 end as end_ns,
    case when event_type = 'error' then 2 else 1 end as status_code, 100 + strlen(props) + strlen(event_type) as size_bytes,
    cast(event_id % 4 as integer) as shard, concat('svc-', event_id % 4) as service, cast(json_extract_string(props, '$.k') as bigint) as k,
    case when event_id % 13 = 0 then null when event_id % 11 = 0 then concat(json_extract_string(props, '$.k'), 'x')
      when event_id % 7 = 0 then concat('-', json_extract_string(props, '$.k')) else json_extract_string(props, '$.k') end as elapsed_raw,
    case when event_id % 5 = 0 then null when event_id % 31 = 0 then 'soon' else cast(epoch_us(ts) // 1000
      - case when event_id % 29 = 0 then -3600000 else cast(json_extract_string(props, '$.k') as bigint) * 1000 end as varchar) end as t0_raw
  from events)"""
_DETECTED = (
    _SPANS
    + """,
parsed as (
  select *, case when regexp_full_match(elapsed_raw, '[0-9]+') then try_cast(elapsed_raw as bigint) end as spent,
    arrival_us // 1000 - case when regexp_full_match(t0_raw, '[0-9]+') then try_cast(t0_raw as bigint) end as age,
    status_code = 2 as h1, end_ns >= start_ns and end_ns - start_ns > 100000000 as h2
  from spans),
detected as (
  select *, case when h1 then 1 when h2 then 2 when greatest(spent, 0) > 50 and spent is not null then 3 when age is not null and greatest(age, 0) > 60000 then 4
      when name = 'purchase' or (name = 'view' and end_ns - start_ns > 20000000) or k > 90 then 5 else 0 end as reason,
    case when h1 or h2 or (spent is not null and greatest(spent, 0) > 50) or (age is not null and greatest(age, 0) > 60000) then null
      when name = 'purchase' then 0 when name = 'view' and end_ns - start_ns > 20000000 then 1 when k > 90 then 2 end as policy,
    case when not h1 and end_ns < start_ns then 1 else 0 end + case when not h1 and not h2 and age < 0 then 1 else 0 end
      + case when not h1 and not h2 and spent < 0 then 1 else 0 end as clamped,
    case when not h1 and not h2 and ((elapsed_raw is not null and spent is null) or (t0_raw is not null and age is null)) then 1 else 0 end as malformed,
    case when not h1 and not h2 and age is not null and spent is not null then greatest(age, 0) - greatest(spent, 0) end as divergence
  from parsed)"""
)
_BASE = "cast(concat('0x', substr(trace_id, 19, 14)) as bigint) < {t}"
_VERDICTS = (
    _DETECTED
    + """,
verdicts as (
  select instance, batch_id, trace_id, coalesce(arg_min(reason, ord) filter (where reason <> 0), case when """
    + _BASE.format(t=values.baseline_threshold(0.2))
    + """ then 6 end, 0) as reason,
    """
    + _BASE.format(t=values.baseline_threshold(0.2))
    + """ as base, nullif(arg_min(coalesce(policy, -1), ord) filter (where reason <> 0), -1) as policy,
    coalesce(arg_min(arrival_us, ord) filter (where reason <> 0), min(arrival_us)) as at_us, coalesce(min(ord) filter (where reason <> 0), min(ord)) as ord, count(*) as spans
  from detected group by instance, batch_id, trace_id)"""
)


def _greedy(keys: str, source_: str, name: str = "d") -> str:
    """A recursive table of decisions: keys and dt, from rows (keys, dt) of source_."""
    on = " and ".join(f"v.{k} = {name}.{k}" for k in keys.split(", "))
    own = ", ".join(f"v.{k}" for k in keys.split(", "))
    return f"""{name}({keys}, dt) as (
  select {keys}, min(dt) from {source_} group by {keys}
  union all
  select {own}, min(v.dt) from {name} join {source_} v on {on} and v.dt >= {name}.dt + {W} group by {own}, {name}.dt)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.events(spark, sf_dir)


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(_events(spark, sf_dir), FULL)


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.verdicts(_detected(spark, sf_dir), FULL.baseline_rate)


def _errors(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Verdicts of error spans."""
    return _events(spark, sf_dir).where("status_code = 2").select(*keys, F.col("arrival_us").alias("at_us"), "ord", F.lit(1).alias("reason"))


def _now(spans: DataFrame) -> Column:
    """The last arrival, as a scalar subquery of the plan that uses it."""
    return F.coalesce(spans.agg(F.max("arrival_us")).scalar(), F.lit(0))


def _segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.with_segments(_events(spark, sf_dir), (F.col("ord") % SHARDS).cast("int"), SEGMENT)


# --- The flagship: decisions on errors, and what they retain.

_FLAG = f"with recursive {_SPANS},\nerr as (select distinct trace_id, arrival_us as dt from spans where status_code = 2),\n{_greedy('trace_id', 'err')}"
_KEPT = "from spans s join d on s.trace_id = d.trace_id and s.arrival_us >= d.dt - {w} and s.arrival_us < d.dt + {w}".format(w=W)


@query("retained_spans_error", f"{_FLAG} select s.trace_id, s.ord, s.arrival_us, s.name, d.dt as decided_us, 1 as keep_reason, s.arrival_us >= d.dt as late {_KEPT}")
def retained_spans_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _events(spark, sf_dir).select("trace_id", "ord", "arrival_us", "name")
    decided = decide.decisions(_errors(spark, sf_dir, "trace_id"), W, ("trace_id",))
    return retain.retained(spans, decided, W, ("trace_id",)).select("trace_id", "ord", "arrival_us", "name", "decided_us", "keep_reason", "late")


@query("retained_spans_distinct", f"{_FLAG} select distinct s.trace_id, s.ord, s.arrival_us, s.name {_KEPT}")
def retained_spans_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained_spans_error(spark, sf_dir).select("trace_id", "ord", "arrival_us", "name").distinct()


@query("late_forwarded", f"{_FLAG} select s.trace_id, s.ord, d.dt as decided_us {_KEPT} where s.arrival_us >= d.dt")
def late_forwarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained_spans_error(spark, sf_dir).where("late").select("trace_id", "ord", "decided_us")


@query("flushed_from_buffer", f"{_FLAG} select s.trace_id, s.ord, d.dt as decided_us {_KEPT} where s.arrival_us < d.dt")
def flushed_from_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retained_spans_error(spark, sf_dir).where("not late").select("trace_id", "ord", "decided_us")


@query("expired_unkept", f"{_FLAG} select s.trace_id, s.ord, s.arrival_us from spans s where not exists (select 1 from d where s.trace_id = d.trace_id and s.arrival_us >= d.dt - {W} and s.arrival_us < d.dt + {W})")
def expired_unkept(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decide.decisions(_errors(spark, sf_dir, "trace_id"), W, ("trace_id",))
    return retain.expired(_events(spark, sf_dir).select("trace_id", "ord", "arrival_us"), decided, W, ("trace_id",))


@query("retained_traces", f"{_FLAG} select s.trace_id, count(distinct s.ord) as spans, count(distinct d.dt) as decisions, min(s.arrival_us) as first_us, max(s.arrival_us) as last_us {_KEPT} group by s.trace_id")
def retained_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = retained_spans_error(spark, sf_dir)
    return kept.groupBy("trace_id").agg(F.countDistinct("ord").alias("spans"), F.countDistinct("decided_us").alias("decisions"), F.min("arrival_us").alias("first_us"), F.max("arrival_us").alias("last_us"))


# --- Detection, condition by condition.


@query("detect_error", f"with {_SPANS} select trace_id, ord, arrival_us from spans where status_code = 2")
def detect_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(_events(spark, sf_dir), detect.Chain()).where("reason = 1").select("trace_id", "ord", "arrival_us")


@query("detect_span_latency", f"with {_SPANS} select trace_id, ord, end_ns - start_ns as duration_ns from spans where end_ns >= start_ns and end_ns - start_ns > 100000000")
def detect_span_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(_events(spark, sf_dir), detect.Chain(False, span_latency=100_000_000)).where("reason = 2").select("trace_id", "ord", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"))


@query("detect_trace_latency", f"with {_DETECTED} select trace_id, ord, spent as elapsed_ms from parsed where greatest(spent, 0) > 50 and spent is not null")
def detect_trace_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.detect(_events(spark, sf_dir), detect.Chain(False, trace_latency=50_000_000)).where("reason = 3")
    return out.select("trace_id", "ord", F.col("attr_baggage_elapsed_ms").cast("bigint").alias("elapsed_ms"))


@query("detect_trace_age", f"with {_DETECTED} select trace_id, ord, age as age_ms from parsed where age is not null and greatest(age, 0) > 60000")
def detect_trace_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect.detect(_events(spark, sf_dir), detect.Chain(False, trace_age=60_000_000_000)).where("reason = 4")
    return out.select("trace_id", "ord", (F.floor(F.col("arrival_us") / 1000).cast("bigint") - F.col("attr_baggage_t0").cast("bigint")).alias("age_ms"))


@query("detect_first_reason_per_span", f"with {_DETECTED} select ord, trace_id, cast(reason as integer) as reason, cast(coalesce(policy, -1) as integer) as policy, cast(clamped as integer) as clamped, cast(malformed as integer) as malformed, coalesce(divergence, -1) as divergence from detected")
def detect_first_reason_per_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("ord", "trace_id", F.col("reason").cast("int").alias("reason"), F.coalesce("policy", F.lit(-1)).alias("policy"), "clamped", "malformed", F.coalesce("divergence", F.lit(-1)).alias("divergence"))


@query(
    "detect_order_lines",
    """with s as (select l.l_orderkey as order_key, l.l_linenumber as line, l.l_partkey as part, l.l_suppkey as supplier, l.l_quantity as quantity, l.l_returnflag = 'R' as e,
      (epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) * 1000 as d from lineitem l join orders o on l.l_orderkey = o.o_orderkey)
    select order_key, line, part, supplier, quantity, case when e then 1 when d > 7776000000000000 then 2 else 0 end as reason, case when not e and d < 0 then 1 else 0 end as clamped from s
    where e or d > 7776000000000000 or d < 0""",
)
def detect_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were returned or shipped more than 90 days after their order, and those shipped before it."""
    out = detect.detect(source.order_lines(spark, sf_dir), detect.Chain(span_latency=90 * 86_400_000_000_000))
    return out.where("reason <> 0 or clamped > 0").select("order_key", "line", "part", "supplier", "quantity", F.col("reason").cast("int").alias("reason"), "clamped")


@query(
    "order_trace_verdicts",
    """with s as (select l.l_orderkey as order_key, l.l_returnflag = 'R' as e, epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate) as d from lineitem l join orders o on l.l_orderkey = o.o_orderkey)
    select order_key, count(*) as spans, count(*) filter (where e) as errors, count(*) filter (where not e and d > 7776000000000) as slow, bool_or(e or d > 7776000000000) as kept from s group by order_key""",
)
def order_trace_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its lines' hits and whether it is kept."""
    out = detect.detect(source.order_lines(spark, sf_dir), detect.Chain(span_latency=90 * 86_400_000_000_000))
    return out.groupBy("order_key").agg(F.count("*").alias("spans"), F.count_if(F.col("reason") == 1).alias("errors"), F.count_if(F.col("reason") == 2).alias("slow"), F.bool_or(F.col("reason") != 0).alias("kept"))


@query("first_reason_per_trace", f"with {_VERDICTS} select instance, batch_id, trace_id, cast(reason as integer) as reason, base, cast(coalesce(policy, -1) as integer) as policy, at_us, ord, spans from verdicts")
def first_reason_per_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).withColumn("policy", F.coalesce("policy", F.lit(-1)))


@query(
    "trace_groups",
    f"with {_SPANS} select instance, batch_id, trace_id, count(*) as spans, min(ord) as first_ord, max(ord) as last_ord, sum(size_bytes)::bigint as bytes, arg_min(name, ord) as first_name, string_agg(name, ',' order by ord) as names from spans group by instance, batch_id, trace_id",
)
def trace_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's fragments: the spans of each trace in order of arrival."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "name")))
    out = _events(spark, sf_dir).groupBy("instance", "batch_id", "trace_id").agg(
        F.count("*").alias("spans"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.sum("size_bytes").alias("bytes"), ordered.alias("o")
    )
    return out.select("instance", "batch_id", "trace_id", "spans", "first_ord", "last_ord", "bytes", F.get(F.col("o"), 0)["name"].alias("first_name"), F.array_join(F.transform("o", lambda x: x["name"]), ",").alias("names"))


@query("conversation_groups", "select conv_id as trace, count(*) as spans, min(turn) as first_ord, arg_min(role, turn) as first_name, string_agg(role, '>' order by turn) as path, sum(length(text))::bigint as bytes from conversations group by conv_id")
def conversation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = source.turns(spark, sf_dir).groupBy("trace").agg(F.count("*").alias("spans"), F.min("ord").alias("first_ord"), F.min_by("name", "ord").alias("first_name"), F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("o"), F.sum("size_bytes").alias("bytes"))
    return held.select("trace", "spans", "first_ord", "first_name", F.array_join(F.transform("o", lambda x: x["name"]), ">").alias("path"), "bytes")


# --- Baseline and baggage.


@query("baseline_sample", f"with {_SPANS} select distinct trace_id from spans where {_BASE.format(t=values.baseline_threshold(0.05))}")
def baseline_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("trace_id").where(values.in_baseline(F.col("trace_id"), 0.05)).distinct()


_RATES = (0.0, 0.01, 0.05, 0.2, 0.5, 1.0)


@query("baseline_rate_report", f"with {_SPANS}, t as (select distinct trace_id from spans) " + " union all ".join(f"select cast({r} as double) as rate, count(*) filter (where {_BASE.format(t=values.baseline_threshold(r))}) as kept, count(*) as traces from t" for r in _RATES))
def baseline_rate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir).select("trace_id").distinct()
    counts = t.agg(F.count("*").alias("traces"), *[F.count_if(values.in_baseline(F.col("trace_id"), r)).alias(f"k{i}") for i, r in enumerate(_RATES)])
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(f"k{i}").alias("kept")) for i, r in enumerate(_RATES)]))
    return counts.select("traces", rows.alias("x")).select("x.rate", "x.kept", "traces")


@query("baggage_parse", f"with {_DETECTED} select ord, coalesce(spent, 0) as v, spent is not null as ok, elapsed_raw is not null and spent is null as malformed from parsed")
def baggage_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("ord", values.read_millis(F.col("attr_baggage_elapsed_ms"), "string").alias("m")).select("ord", "m.v", "m.ok", "m.malformed")


@query("baggage_parse_variant", f"with {_DETECTED} select ord, coalesce(spent, 0) as v, spent is not null as ok, elapsed_raw is not null and spent is null as malformed from parsed")
def baggage_parse_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same out of the array of attributes."""
    value = values.attribute(F.col("attributes"), source.ELAPSED)
    return _events(spark, sf_dir).select("ord", values.read_millis(value).alias("m")).select("ord", "m.v", "m.ok", "m.malformed")


@query("baggage_malformed", f"with {_DETECTED} select service, sum(malformed)::bigint as malformed, count(*) as spans from detected group by service")
def baggage_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).groupBy("service").agg(F.sum("malformed").alias("malformed"), F.count("*").alias("spans"))


@query("skew_clamps", f"with {_DETECTED} select instance, sum(clamped)::bigint as clamped from detected group by instance")
def skew_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).groupBy("instance").agg(F.sum("clamped").alias("clamped"))


@query("divergence_last", f"with {_DETECTED} select instance, arg_max(divergence, ord) filter (where divergence is not null) as divergence_ms from detected group by instance")
def divergence_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.when(F.col("divergence").isNotNull(), F.struct("ord", "divergence")))
    return _detected(spark, sf_dir).groupBy("instance").agg(last["divergence"].alias("divergence_ms"))


# --- Policies.


def _policy(name: str, condition: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = detect.detect(_events(spark, sf_dir), detect.Chain(False, policies=((name, condition),)))
        return out.where("reason = 5").select("ord", "trace_id", "name")

    run.__doc__ = f"Spans for which {condition}"
    query(name, f"with {_SPANS} select ord, trace_id, name from spans where {where}")(run)


_policy("policy_eq", 'span.attributes["event"] == "purchase"', "name = 'purchase'")
_policy("policy_ne", 'span.name != "view" and not (span.name == "click")', "name not in ('view', 'click')")
_policy("policy_cmp", 'Int(span.attributes["k"]) > 5', "k > 5")
_policy("policy_cmp_any", 'span.attributes["k"] >= 40 or span.attributes["k"] < 3', "k >= 40 or k < 3")
_policy("policy_regex", 'IsMatch(span.name, "^(pur|sign).*e?$")', "regexp_matches(name, '^(pur|sign).*e?$')")
_policy("policy_arith", "(span.end_time_unix_nano - span.start_time_unix_nano) / 1000000 > 30", "end_ns >= start_ns and (end_ns - start_ns) // 1000000 > 30")
_policy("policy_status", "span.status.code == STATUS_CODE_ERROR", "status_code = 2")
_policy("policy_string_number", 'Int(span.attributes["baggage.elapsed_ms"]) > 30', "try_cast(case when regexp_full_match(elapsed_raw, '[+-]?[0-9]+') then elapsed_raw end as bigint) > 30")
_policy("policy_missing", 'span.attributes["no.such"] == nil and span.attributes["baggage.t0"] != nil', "t0_raw is not null")


@query("policy_first_match", f"with {_DETECTED} select cast(coalesce(policy, -1) as integer) as policy, count(*) as spans from (select case when name = 'purchase' then 0 when name = 'view' and end_ns - start_ns > 20000000 then 1 when k > 90 then 2 end as policy from spans) group by 1")
def policy_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(_events(spark, sf_dir), detect.Chain(False, policies=POLICIES)).groupBy(F.coalesce("policy", F.lit(-1)).alias("policy")).agg(F.count("*").alias("spans"))


_SEEN = _DETECTED + ", f as (select *, min(ord) filter (where reason <> 0) over (partition by instance, batch_id, trace_id) as hit from detected), seen as (select * from f where hit is null or ord <= hit), sampled as (select distinct instance, batch_id, trace_id from detected where " + _BASE.format(t=values.baseline_threshold(FULL.baseline_rate)) + ")"


@query("policy_matches_by_name", f"with {_SEEN} select case policy when 0 then 'purchases' when 1 then 'long views' else 'high k' end as policy, count(*) as matches from seen where policy is not null group by 1")
def policy_matches_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.chain_counts(_detected(spark, sf_dir), [n for n, _ in POLICIES]).where("instrument = 'policy.matches'")
    return rows.select(F.col("label").alias("policy"), F.col("value").alias("matches"))


@query("policy_errors_by_name", f"with {_SPANS} select 'size of a number' as policy, count(*) as errors from spans where k is not null")
def policy_errors_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy that always fails doesn't keep the next one from matching."""
    policies = (("size of a number", 'Len(span.attributes["k"]) > 1'), ("all", 'span.name != ""'))
    out = detect.detect(_events(spark, sf_dir), detect.Chain(False, policies=policies)).where("policy = 1")
    return out.select(F.explode("policy_errors").alias("i")).groupBy(F.lit("size of a number").alias("policy")).agg(F.count("*").alias("errors"))


# --- Decisions.

_LOCAL = f"with recursive {_VERDICTS},\nv as (select instance, trace_id, at_us as dt, ord, reason from verdicts where reason <> 0),\n{_greedy('instance, trace_id', 'v')}"
_NAMED = "(select d.instance, d.trace_id, d.dt, arg_min(v.reason, v.ord) as reason from d join v on v.instance = d.instance and v.trace_id = d.trace_id and v.dt = d.dt group by all)"


@query("decisions", f"{_LOCAL} select instance, trace_id,  dt as decided_us, dt + {W} as deadline_us, cast(reason as integer) as reason from {_NAMED}")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.decisions(_verdicts(spark, sf_dir).where("reason <> 0"), W).select("instance", "trace_id", "decided_us", "deadline_us", "reason")


@query("duplicate_keeps", f"{_LOCAL} select x.instance, x.trace_id, n as verdicts, m as decisions, n - m as duplicates from (select instance, trace_id, count(*) as n from v group by all) x join (select instance, trace_id, count(*) as m from d group by all) y using (instance, trace_id)")
def duplicate_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir).where("reason <> 0")
    return decide.duplicates(v, decide.decisions(v, W))


@query("decided_live", f"{_LOCAL} select instance, count(*) as entries from d, (select max(arrival_us) as now from spans) where dt <= now and dt + {W} > now group by instance")
def decided_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _now(_events(spark, sf_dir))
    d = decide.decisions(_verdicts(spark, sf_dir).where("reason <> 0"), W)
    return d.where((F.col("decided_us") <= now) & (F.col("deadline_us") > now)).groupBy("instance").agg(F.count("*").alias("entries"))


# --- Several instances: keeps reach all at once.

_ALL = f"with recursive {_SPANS},\nv as (select trace_id, arrival_us as dt, ord, instance from spans where status_code = 2),\n{_greedy('trace_id', 'v')},\nown as (select d.trace_id, d.dt, arg_min(v.instance, v.ord) as o from d join v on v.trace_id = d.trace_id and v.dt = d.dt group by all),\nx as (select own.*, cast(i.i as integer) as instance, case when i.i = o then 'local' else 'bus' end as origin from own, range(3) i(i))"


def _shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.across_instances(_errors(spark, sf_dir, "instance", "trace_id"), W, 3)


@query("broadcast_keeps", f"{_ALL} select trace_id, dt as decided_us, cast(o as integer) as origin_instance, 1 as reason from own")
def broadcast_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide.keeps(_shared(spark, sf_dir)).select("trace_id", "decided_us", "origin_instance", "reason")


@query("kept_by_origin", f"{_ALL} select instance, origin, count(*) as decisions from x group by instance, origin")
def kept_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir).groupBy("instance", "origin").agg(F.count("*").alias("decisions"))


_CROSS = "from spans s join x on s.trace_id = x.trace_id and s.instance = x.instance and s.arrival_us >= x.dt - {w} and s.arrival_us < x.dt + {w}".format(w=W)


@query("cross_instance_retained", f"{_ALL} select s.instance, s.trace_id, s.ord, x.dt as decided_us, s.arrival_us >= x.dt as late {_CROSS}")
def cross_instance_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _events(spark, sf_dir).select("instance", "trace_id", "ord", "arrival_us")
    return retain.retained(spans, _shared(spark, sf_dir), W).select("instance", "trace_id", "ord", "decided_us", "late")


@query("completeness_by_instance", f"{_ALL}, k as (select distinct s.instance, s.ord {_CROSS}) select s.instance, count(*) as spans, count(k.ord) as kept from spans s left join k using (instance, ord) group by s.instance")
def completeness_by_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cross_instance_retained(spark, sf_dir).select("instance", "ord").distinct().withColumn("kept", F.lit(1))
    return _events(spark, sf_dir).select("instance", "ord").join(kept, ["instance", "ord"], "left").groupBy("instance").agg(F.count("*").alias("spans"), F.count("kept").alias("kept"))


@query("instance_completeness_gain", f"{_ALL}, l as (select distinct s.ord from spans s join x on x.origin = 'local' and s.trace_id = x.trace_id and s.instance = x.instance and s.arrival_us >= x.dt - {W} and s.arrival_us < x.dt + {W}), k as (select distinct s.ord {_CROSS}) select (select count(*) from l) as local_only, (select count(*) from k) as with_bus")
def instance_completeness_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bus adds: spans kept by instances' own decisions, and by all."""
    spans, d = _events(spark, sf_dir).select("instance", "trace_id", "ord", "arrival_us"), _shared(spark, sf_dir)
    kept = retain.retained(spans, d.withColumn("reason", (F.col("origin") == "local").cast("int")), W)
    each = kept.groupBy("ord").agg(F.max("keep_reason").alias("local"))
    return each.agg(F.count_if(F.col("local") == 1).alias("local_only"), F.count("*").alias("with_bus"))


def _absorbing() -> str:
    """Verdicts of a trace one by one; l0 to l2 are when each instance last decided, t0 to t2 whether it does now."""
    last = "case n.instance when 0 then l0 when 1 then l1 else l2 end"
    takes = [f"(n.dt >= {last} + {W} and (n.instance = {k} or (n.reason <> 6 and n.dt >= l{k} + {W})))" for k in range(3)]
    step = ", ".join(f"case when {t} then n.dt else l{k} end" for k, t in enumerate(takes))
    never = -(1 << 61)
    made = " union all ".join(f"select {k} as instance, * from r where t{k}" for k in range(3))
    return f"""with recursive {_VERDICTS},
v as (select trace_id, at_us as dt, instance, min(ord) as ord, arg_min(reason, ord) as reason from verdicts where reason <> 0 group by trace_id, at_us, instance),
n as (select *, row_number() over (partition by trace_id order by dt, ord, instance) as i from v),
r(trace_id, i, dt, own, reason, l0, l1, l2, t0, t1, t2) as (
  select distinct trace_id, 0::bigint, 0::bigint, 0, 0, {never}::bigint, {never}::bigint, {never}::bigint, false, false, false from n
  union all
  select n.trace_id, n.i, n.dt, n.instance, n.reason, {step}, {", ".join(takes)} from r join n on n.trace_id = r.trace_id and n.i = r.i + 1)
select cast(instance as integer) as instance, trace_id, dt as decided_us, cast(reason as integer) as reason,
  case when instance <> own then 'bus' when reason = 6 then 'baseline' else 'local' end as origin from ({made})"""


@query("baseline_absorbs", _absorbing())
def baseline_absorbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of all instances, with baseline ones, which aren't broadcast and absorb later verdicts of their window."""
    v = _verdicts(spark, sf_dir).where("reason <> 0").select("instance", "trace_id", "at_us", "ord", "reason")
    return decide.across_instances(v, W, 3).select("instance", "trace_id", "decided_us", "reason", "origin")


@query("detected_by_reason", f"with {_SEEN} select case reason when 1 then 'error' when 2 then 'span_latency' when 3 then 'trace_latency' when 4 then 'trace_age' else 'policy' end as reason, count(*) as hits from seen where reason <> 0 group by 1 union all select 'baseline', count(*) from sampled having count(*) > 0")
def detected_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = metrics.before_first_hit(_detected(spark, sf_dir))
    counted = metrics.detected_keeps(seen, FULL.baseline_rate)
    rows = F.array(*[F.struct(F.lit(k).alias("reason"), F.col(k).alias("hits")) for k, _ in counted])
    return seen.agg(*[n.alias(k) for k, n in counted]).select(F.explode(rows).alias("r")).select("r.*").where("hits > 0")


@query("flushed_span_counts", f"{_LOCAL} select s.instance, count(*) as spans from spans s join d on s.instance = d.instance and s.trace_id = d.trace_id and s.arrival_us >= d.dt - {W} and s.arrival_us < d.dt + {W} group by s.instance")
def flushed_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decide.decisions(_verdicts(spark, sf_dir).where("reason <> 0"), W)
    kept = retain.retained(_events(spark, sf_dir).select("instance", "trace_id", "ord", "arrival_us"), d, W)
    return kept.groupBy("instance").agg(F.count("*").alias("spans"))


# --- The buffer.

_SEG = f"""{_SPANS},
placed as (select *, cast(coalesce(sum(size_bytes) over (partition by instance, shard order by arrival_us, ord rows between unbounded preceding and 1 preceding), 0) // {SEGMENT} as integer) as gen from spans),
seg as (select instance, shard, gen, min(arrival_us) as t_min_us, max(arrival_us) as t_max_us, sum(size_bytes)::bigint as bytes, count(*) as n,
  row_number() over (partition by instance, shard order by gen desc) > 1 as finalized from placed group by instance, shard, gen),
clock as (select max(arrival_us) as now from spans)"""


@query("segments_by_bytes", f"with {_SEG} select * from seg")
def segments_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.segments(_segmented(spark, sf_dir))


@query("segment_expiry", f"with {_SEG} select instance, shard, gen, bytes, n from seg, clock where t_max_us < now - {10 * W}")
def segment_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _segmented(spark, sf_dir)
    return retention.expired_segments(retention.segments(held), _now(held), 10 * W).select("instance", "shard", "gen", "bytes", "n")


_LADDER = f"""{_SEG},
l as (select seg.*, sum(bytes) over (partition by instance) as total, finalized and t_max_us < now - {FLOOR} as may from seg, clock),
m as (select *, coalesce(sum(case when may then bytes end) over w, 0) as gone, coalesce(max(case when finalized and not may then 1 end) over w, 0) as stopped from l
  window w as (partition by instance order by t_max_us, shard, gen rows between unbounded preceding and 1 preceding)),
ladder as (select *, may and stopped = 0 and total - gone > {LIMIT} as sacrificed from m)"""


@query("watermark_sacrifice", f"with {_LADDER} select instance, shard, gen, t_max_us, bytes, sacrificed from ladder")
def watermark_sacrifice(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _segmented(spark, sf_dir)
    return retention.early_expiry(retention.segments(held), _now(held), FLOOR, LIMIT).select("instance", "shard", "gen", "t_max_us", "bytes", "sacrificed")


@query("shed_causes", f"with {_LADDER}, k as (select *, sum(bytes) over (partition by instance) as b from ladder where not sacrificed) select instance, shard, max(b)::bigint as bytes_left, case when max(b) <= {LIMIT} then null when bool_or(finalized) then 'floor_protected' else 'nothing_reclaimable' end as cause from k group by instance, shard")
def shed_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _segmented(spark, sf_dir)
    return retention.shed_causes(retention.segments(held), _now(held), FLOOR, LIMIT)


@query("effective_window", f"with {_SEG}, o as (select instance, shard, arg_min(t_max_us, gen) filter (where finalized) as t from seg group by instance, shard) select instance, cast(coalesce(min(case when t is not null then least(greatest(now - t, 0), {25 * W}) end), {25 * W}) // 1000000 as bigint) as effective_window_s from o, clock group by instance")
def effective_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _segmented(spark, sf_dir)
    return retention.effective_window(retention.segments(held), _now(held), 25 * W)


@query(
    "retained_by_segment",
    f"with recursive {_SEG},\nerr as (select distinct instance, trace_id, arrival_us as dt from spans where status_code = 2),\n{_greedy('instance, trace_id', 'err')} select p.instance, p.trace_id, p.ord, d.dt as decided_us, p.arrival_us >= d.dt as late from placed p join seg using (instance, shard, gen) join d on d.instance = p.instance and d.trace_id = p.trace_id where (p.arrival_us < d.dt and seg.t_max_us >= d.dt - {W}) or (p.arrival_us >= d.dt and p.arrival_us < d.dt + {W})",
)
def retained_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _segmented(spark, sf_dir)
    d = decide.decisions(_errors(spark, sf_dir, "instance", "trace_id"), W)
    out = retain.retained_by_segment(held.select("instance", "trace_id", "ord", "arrival_us", "shard", "gen"), d, retention.segments(held), W)
    return out.select("instance", "trace_id", "ord", "decided_us", "late")


@query("age_ratio_histogram", f"{_FLAG}, fl as (select s.trace_id, d.dt, min(nullif(s.start_ns, 0)) as st {_KEPT} where s.arrival_us < d.dt group by all), r as (select greatest(dt - st // 1000, 0) / {float(W)} as ratio from fl) select case " + " ".join(f"when ratio <= {b} then {b}" for b in metrics.AGE_BOUNDS) + " end::double as bound, count(*) as n from r group by 1")
def age_ratio_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _events(spark, sf_dir).select("trace_id", "ord", "arrival_us", "start_ns")
    kept = retain.retained(spans, decide.decisions(_errors(spark, sf_dir, "trace_id"), W, ("trace_id",)), W, ("trace_id",))
    return metrics.age_ratio(metrics.flushes(kept, ("trace_id",)), W)


# --- Owed work.

_INTENTS = f"""{_SPANS},
intents as (select instance, trace_id, ord, cast(1 + ord % 2 as integer) as need, cast(ord % 3 as integer) as reason, case when ord % 4 = 0 then 0 else arrival_us + {W} end as deadline_us from spans where status_code = 2)"""


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that error spans left parked: 1 to publish, 2 to flush."""
    o = F.col("ord")
    return _events(spark, sf_dir).where("status_code = 2").select("instance", "trace_id", "ord", (1 + o % 2).cast("int").alias("need"), (o % 3).cast("int").alias("reason"), F.when(o % 4 == 0, 0).otherwise(F.col("arrival_us") + W).alias("deadline_us"))


@query("pending_merge", f"with {_INTENTS} select instance, trace_id, bit_or(need) as need, cast(coalesce(arg_min(reason, ord) filter (where reason <> 0), 0) as integer) as reason, coalesce(arg_min(deadline_us, ord) filter (where deadline_us <> 0), 0) as deadline_us, min(ord) as ord from intents group by instance, trace_id")
def pending_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.merged_intents(_intents(spark, sf_dir)).withColumn("deadline_us", F.coalesce("deadline_us", F.lit(0)))


@query("abandoned_publishes", f"with {_INTENTS}, m as (select instance, trace_id, bit_or(need) as need, arg_min(deadline_us, ord) filter (where deadline_us <> 0) as deadline_us from intents group by instance, trace_id) select instance, trace_id, deadline_us from m where need % 2 = 1 and deadline_us <= (select max(arrival_us) from spans) - {15 * W}")
def abandoned_publishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _now(_events(spark, sf_dir)) - 15 * W
    return retention.abandoned(retention.merged_intents(_intents(spark, sf_dir)), now).select("instance", "trace_id", "deadline_us")


@query("drain_oldest_first", f"with {_INTENTS} select instance, trace_id, ord, cast(row_number() over (partition by instance order by ord) as integer) as place from intents qualify place <= 16")
def drain_oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 oldest intents of each instance: a queue takes no more at once."""
    return retention.drained(_intents(spark, sf_dir), 16).select("instance", "trace_id", "ord", "place")


# --- Delivery: queues, publications and flushes that fail.

_OFFER = f"{_SPANS}, fr as (select instance, shard, batch_id, trace_id, min(ord) as ord from spans group by all), q as (select *, row_number() over (partition by instance, shard, batch_id order by ord) <= 3 as admitted from fr)"
_PUBLISH = """, kp as (select trace_id, dt as decided_us, o as origin_instance, dt // 1000000 % 5 = 0 as lost from own)"""
_FLUSH = """, fo as (select instance, ord, case ord % 11 when 0 then 'dropped' when 1 then 'retry' else 'delivered' end as outcome from spans where status_code = 2)"""


def _offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's fragments at a queue of three."""
    spans = _events(spark, sf_dir).withColumn("shard", (F.col("ord") % SHARDS).cast("int"))
    return delivery.offered(spans.groupBy("instance", "shard", "batch_id", "trace_id").agg(F.min("ord").alias("ord")), 3)


def _publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps, of which those decided in every fifth second weren't acknowledged."""
    keeps = decide.keeps(_shared(spark, sf_dir))
    failed = keeps.where(F.floor(F.col("decided_us") / 1_000_000) % 5 == 0)
    return delivery.published(keeps, failed, W)


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("ord") % 11 == 0, "permanent").when(F.col("ord") % 11 == 1, "retryable")
    return delivery.settled(_events(spark, sf_dir).where("status_code = 2").select("instance", "ord"), error)


@query("offer_accounting", f"with {_OFFER} select instance, shard, count(*) as offered, count(*) filter (where admitted) as buffered, count(*) filter (where not admitted) as shed from q group by instance, shard")
def offer_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.accounting(_offered(spark, sf_dir))


@query("publish_outcomes", f"{_ALL}{_PUBLISH} select trace_id, decided_us, cast(origin_instance as integer) as origin_instance, case when lost then 'parked' else 'published' end as outcome, case when lost then decided_us + {W} else 0 end as deadline_us from kp")
def publish_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _publications(spark, sf_dir).select("trace_id", "decided_us", "origin_instance", "outcome", "deadline_us")


@query("publish_chunks", f"{_ALL}{_PUBLISH}, ch as (select *, decided_us // {10 * W} as st, (row_number() over (partition by origin_instance, decided_us // {10 * W} order by decided_us, trace_id) - 1) // {delivery.CHUNK} as chunk from kp) select cast(origin_instance as integer) as origin_instance, cast(st as bigint) as stretch, cast(chunk as integer) as chunk, count(*) as keeps from ch group by all")
def publish_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keeps each chunk of an instance's publications holds, over stretches of ten windows."""
    keeps = delivery.chunked(decide.keeps(_shared(spark, sf_dir)), 10 * W)
    return keeps.groupBy("origin_instance", F.floor(F.col("decided_us") / (10 * W)).cast("bigint").alias("stretch"), "chunk").agg(F.count("*").alias("keeps"))


@query("flush_outcomes", f"with {_SPANS}{_FLUSH} select instance, outcome, count(*) as flushes from fo group by all")
def flush_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir).groupBy("instance", "outcome").agg(F.count("*").alias("flushes"))


@query(
    "delivery_counters",
    f"{_ALL}, {_OFFER.removeprefix(_SPANS + ', ')}{_PUBLISH}{_FLUSH} select 'shed.queue_full' as instrument, '' as label, count(*) filter (where not admitted) as value from q union all select 'publish.errors', '', count(*) filter (where lost) from kp "
    "union all select 'flush.retries', '', count(*) filter (where outcome = 'retry') from fo union all select 'flush.errors', '', count(*) filter (where outcome = 'dropped') from fo "
    "union all select 'pending.flushes', '', count(*) filter (where outcome = 'retry') from fo union all select 'bus.malformed', '', count(*) filter (where ord % 17 = 0) from spans where status_code = 2",
)
def delivery_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What delivery counts; every 17th keep is cut short on its way."""
    e = _events(spark, sf_dir).where("status_code = 2")
    payload = F.when(F.col("ord") % 17 == 0, F.unhex(F.substring("trace_id", 1, 20))).otherwise(values.encode_keep(F.col("trace_id"), F.lit(1)))
    return delivery.delivery_counts(_offered(spark, sf_dir), _publications(spark, sf_dir), _settled(spark, sf_dir), e.select(values.decode_keep(payload).alias("keep")))


@query("fragment_lookup", f"with {_SPANS} select instance, trace_id, ord, arrival_us, name from spans where trace_id in (md5('1'), md5('2'), md5('3'))")
def fragment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything of three traces."""
    import hashlib

    ids = [hashlib.md5(x).hexdigest() for x in (b"1", b"2", b"3")]
    return delivery.of_trace(_events(spark, sf_dir).select("instance", "trace_id", "ord", "arrival_us", "name"), *ids)


@query("dead_traces", f"with {_SEG}, t as (select instance, shard, trace_id, max(gen) as gen from placed group by all) select t.instance, t.shard, t.trace_id, t.gen as last_gen from t join seg using (instance, shard, gen), clock where t_max_us < now - {10 * W}")
def dead_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _segmented(spark, sf_dir)
    return delivery.dead_traces(held, retention.segments(held), _now(held), 10 * W)


@query("kept_ids_capped", f"{_FLAG} select distinct s.trace_id {_KEPT} order by 1 limit 100")
def kept_ids_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred least ids of kept traces: a summary lists no more than it is told to."""
    return delivery.kept_ids(retained_spans_error(spark, sf_dir), 100)


@query("kept_union", f"with {_SPANS} select distinct trace_id from spans where status_code = 2 and ord % 2 = 0 union select distinct trace_id from spans where status_code = 2 and ord % 2 = 1")
def kept_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids kept by either of two waves."""
    e = _events(spark, sf_dir).where("status_code = 2")
    first, second = (e.where(F.col("ord") % 2 == k).select("trace_id") for k in (0, 1))
    return first.union(second).distinct()


@query("rate_and_peak", f"with {_SPANS}, m as (select instance, arrival_us // 3600000000 as h, count(*) as n, sum(size_bytes) as b from spans group by all) select instance, sum(n)::bigint as spans, sum(b)::bigint as bytes, max(n) as peak_spans_per_hour from m group by instance")
def rate_and_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _events(spark, sf_dir).groupBy("instance", F.floor(F.col("arrival_us") / 3_600_000_000).alias("h")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    return hours.groupBy("instance").agg(F.sum("n").alias("spans"), F.sum("b").alias("bytes"), F.max("n").alias("peak_spans_per_hour"))


# --- Segment files with damaged records.

_MAGIC = 0x5EA15EA1
_FILES = "files as (select cast(event_id % 3 as integer) as instance, event_id // 500 as gen, event_id as ord, event_id % 7 = 3 as bad from events)"


def _segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as finished segments of 500 event ids, with a damaged byte in every fragment whose id is 3 modulo 7, as they are read back."""
    import pandas as pd

    from emberline.session import ship
    from emberline.sources import segments

    def written(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ord")
        parts = [(bytes.fromhex(t), str(o).encode()) for t, o in zip(g["trace_id"], g["ord"])]
        data = bytearray(segments.finish(parts, int(g["arrival_us"].min()) * 1000, int(g["arrival_us"].max()) * 1000, _MAGIC))
        at = 0
        for o, (_, fragment) in zip(g["ord"], parts):
            at += segments.HEADER.size + len(fragment)
            if o % 7 == 3:
                data[at - 1] ^= 255
        return pd.DataFrame([(f"{key[0]}/{key[1]}", bytes(data))], columns=["path", "content"])

    ship(spark)
    gen = F.floor(F.col("ord") / 500).cast("bigint").alias("gen")
    return segments.decoded(_events(spark, sf_dir).select("instance", gen, "trace_id", "ord", "arrival_us").groupBy("instance", "gen").applyInPandas(written, "path string, content binary"), _MAGIC)


@query("segment_fragments", f"with {_FILES} select concat(instance, '/', gen) as path, ord from files where not bad")
def segment_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be read of segments with damaged records: all others."""
    from emberline.sources import segments

    return segments.fragments(_segment_rows(spark, sf_dir)).select("path", F.col("fragment").cast("string").cast("bigint").alias("ord"))


@query("corrupt_fragments", f"with {_FILES} select 'corrupt.fragments' as instrument, '' as label, count(*)::bigint as value from files where bad")
def corrupt_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberline.sources import segments

    return segments.corrupt_fragments(_segment_rows(spark, sf_dir))


# --- The wire, counters and load.


@query("wire_codec", f"with {_SPANS}, e as (select ord, concat(trace_id, '01') as payload from spans where status_code = 2 and ord % 5 <> 0 union all select ord, trace_id from spans where status_code = 2 and ord % 5 = 0) select ord, payload, substr(payload, 1, 32) as trace_id, case when length(payload) = 34 then 1 else 0 end as reason from e")
def wire_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keeps as they are sent, some without reason as older senders do, and what is read back."""
    e = _events(spark, sf_dir).where("status_code = 2")
    payload = F.when(F.col("ord") % 5 != 0, values.encode_keep(F.col("trace_id"), F.lit(1))).otherwise(F.unhex("trace_id"))
    out = e.select("ord", payload.alias("p")).withColumn("k", values.decode_keep(F.col("p")))
    return out.select("ord", F.lower(F.hex("p")).alias("payload"), F.col("k.trace_id").alias("trace_id"), F.col("k.reason").cast("int").alias("reason"))


_LABEL = {"detected.keeps": "case reason when 1 then 'error' when 2 then 'span_latency' when 3 then 'trace_latency' when 4 then 'trace_age' else 'policy' end", "policy.matches": "case policy when 0 then 'purchases' when 1 then 'long views' else 'high k' end"}


@query(
    "chain_counters",
    f"with {_SEEN} select 'detected.keeps' as instrument, {_LABEL['detected.keeps']} as label, count(*)::bigint as value from seen where reason <> 0 group by 2 union all select 'detected.keeps', 'baseline', count(*) from sampled having count(*) > 0 union all select 'policy.matches', {_LABEL['policy.matches']}, count(*) from seen where policy is not null group by 2 "
    "union all select 'skew.clamped', '', sum(clamped)::bigint from seen union all select 'baggage.malformed', '', sum(malformed)::bigint from seen union all select 'baggage.divergence_ms', '', arg_max(divergence, ord) from seen where divergence is not null",
)
def chain_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chain_counts(_detected(spark, sf_dir), [n for n, _ in POLICIES], FULL.baseline_rate)


@query(
    "decision_counters",
    f"{_ALL}, k as (select s.ord {_CROSS}) select 'duplicate.keeps' as instrument, '' as label, (select count(*) from v) - count(*) filter (where origin <> 'bus') as value from x union all select 'kept.local', '', count(*) filter (where origin <> 'bus') from x "
    "union all select 'kept.bus', '', count(*) filter (where origin = 'bus') from x union all select 'published.keeps', '', count(*) filter (where origin = 'local') from x union all select 'flushed.spans', '', count(*) from k",
)
def decision_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, d = _errors(spark, sf_dir, "instance", "trace_id"), _shared(spark, sf_dir)
    kept = retain.retained(_events(spark, sf_dir).select("instance", "trace_id", "ord", "arrival_us"), d, W)
    return metrics.decision_counts(v, d, kept)


@query("buffer_gauges", f"{_LOCAL}, seg2 as (select * from (with {_SEG} select seg.* from seg)) select 'expired.bytes' as instrument, '' as label, coalesce(sum(bytes), 0)::bigint as value from seg2, (select max(arrival_us) as now from spans) where t_max_us < now - {10 * W} union all select 'disk.bytes', '', coalesce(sum(bytes), 0)::bigint from seg2, (select max(arrival_us) as now from spans) where t_max_us >= now - {10 * W} union all select 'decided.entries', '', count(*) from d, (select max(arrival_us) as now from spans) where dt <= now and dt + {W} > now")
def buffer_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _segmented(spark, sf_dir)
    d = decide.decisions(_verdicts(spark, sf_dir).where("reason <> 0"), W)
    return metrics.buffer_gauges(retention.segments(held), d, _now(held), 10 * W)


@query("generator_summary", "select 'error' as class, 40 as traces, 160 as spans, 40 as marked union all select 'slow', 30, 120, 30 union all select 'trace_latency', 20, 80, 20 union all select 'healthy', 910, 3640, 0")
def generator_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load of 1000 traces of four spans holds, and how many traces detection keeps of each class."""
    from emberline.sources.generator import generate

    made = generate(spark, 1000, 4, 2, errors=40, slow=30, late=20)
    out = detect.detect(made, detect.Chain(span_latency=500_000_000, trace_latency=1_000_000_000))
    return out.groupBy("class").agg(F.countDistinct("trace").cast("int").alias("traces"), F.count("*").cast("int").alias("spans"), F.count_if(F.col("reason") != 0).cast("int").alias("marked"))


@query("round_robin_split", "with s as (select l_orderkey, (row_number() over (partition by l_orderkey order by l_linenumber) - 1) % 3 as e from lineitem) select cast(e as integer) as endpoint, count(*) as spans, count(distinct l_orderkey) as traces from s group by 1")
def round_robin_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span j of a trace, from 0, goes to endpoint j modulo 3; a trace's counts per endpoint follow from its length."""
    traces = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    each = F.explode(F.transform(F.array(*[F.lit(e) for e in range(3)]), lambda e: F.struct(e.alias("endpoint"), F.ceil((F.col("n") - e) / 3).cast("bigint").alias("spans"))))
    return traces.select(each.alias("x")).where("x.spans > 0").groupBy("x.endpoint").agg(F.sum("x.spans").alias("spans"), F.count("*").alias("traces"))


@query("class_mix", "with r as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders), x as (select case when i < 100 then 'error' when i < 250 then 'slow' when i < 300 then 'trace_latency' else 'healthy' end as class from r) select class, count(*) as traces from x group by class")
def class_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by leading index: the lowest order keys first. Only the few leading keys are ranked."""
    from emberline.sources.generator import class_of

    keys = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    lead = keys.orderBy("o_orderkey").limit(300).select(F.collect_list("o_orderkey").alias("l"))
    ranked = lead.select(F.posexplode(F.array_sort("l")).alias("i", "k")).groupBy(class_of(F.col("i"), 100, 150, 50).alias("class")).agg(F.count("*").alias("traces"))
    rest = keys.agg(F.count("*").alias("n")).select(F.lit("healthy").alias("class"), F.greatest(F.col("n") - 300, F.lit(0)).alias("traces"))
    return ranked.unionByName(rest).where("traces > 0")


# --- The flagship as a stream.


@query("stream_retained", f"{_FLAG} select s.trace_id, s.ord, s.arrival_us, s.name, d.dt as decided_us, 1 as keep_reason, s.arrival_us >= d.dt as late {_KEPT}")
def stream_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events read as a stream; what it appends equals the batch query."""
    import uuid

    from emberline.streaming import retain as stream

    stream.prepare(spark)
    top = f"{source.work_dir(spark)}/stream-{uuid.uuid4().hex}"
    spans = lambda: stream.events(spark, sf_dir)
    kept = stream.retained(spans(), stream.errors(spans()), W, "1 hour").select("trace_id", "ord", "arrival_us", "name", "decided_us", "keep_reason", "late")
    stream.run_available(kept, f"{top}/out", f"{top}/checkpoint")
    return spark.read.schema(kept.schema).parquet(f"{top}/out")
