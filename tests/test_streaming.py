from emberline.streaming import retain


def test_reopened_decisions_and_late_spans(spark, tmp_path):
    """One file a batch: verdicts at 0, 30, 70, 125 and 200 s, which are spans, too."""
    retain.prepare(spark)
    folder = tmp_path / "in"
    base = "timestamp_ntz'2024-01-01 00:00:00'"
    for i, t in enumerate([0, 30, 70, 125, 200]):
        spark.sql(f"select {i}L as event_id, {base} + interval {t} second as ts, 7L as user_id, 'error' as event_type, 1.0D as value, '{{}}' as props").coalesce(1).write.parquet(str(folder / f"{i}.parquet"))
    spans = lambda: retain.events(spark, str(folder), "*.parquet", 1)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    w = 60_000_000
    for _ in range(2):  # the second time there is nothing new
        retain.run_available(retain.retained(spans(), retain.errors(spans()), w, "10 minutes"), out, mark)
    zero = 1_704_067_200_000_000
    got = sorted(((r.decided_us - zero) // 10**6, (r.arrival_us - zero) // 10**6) for r in spark.read.parquet(out).collect())
    assert got == [(0, 0), (0, 30), (70, 30), (70, 70), (70, 125), (200, 200)]


class Held:
    """A value and timers of one key."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)


def test_decided_state_goes_with_its_window():
    from pyspark.sql import Row

    from emberline.streaming import retain as stream

    held, decider = Held(), stream.Decider(10_000)
    decider.init(held)
    row = lambda at: Row(at_us=at, ord=at, reason=1, arrival=None)
    assert [r.decided_us for r in decider.handleInputRows(("t",), iter([row(5_000), row(0), row(12_000)]), None)] == [0, 12_000]
    assert held.timers == {22} and held.value == (12_000,)
    assert [*decider.handleInputRows(("t",), iter([row(21_999)]), None)] == [] and held.timers == {22}
    assert [*decider.handleExpiredTimer(("t",), None, None)] == [] and held.value is None
    assert [r.decided_us for r in decider.handleInputRows(("t",), iter([row(22_000)]), None)] == [22_000]


def test_state_is_empty_once_the_watermark_has_passed(spark, tmp_path):
    import datetime

    from emberline.streaming import retain as stream

    stream.prepare(spark)
    base = datetime.datetime(2024, 1, 1)
    for k, at in enumerate([0, 1, 3600 * 24, 3600 * 48]):
        rows = [(k, base + datetime.timedelta(seconds=at), 7 if k < 2 else 8 + k, "error", 1.0, "{}")]
        spark.createDataFrame(rows, stream.EVENTS.replace("timestamp_ntz", "timestamp")).selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    spans = stream.events(spark, str(tmp_path / "in"), "*.parquet", files=1)
    stream.run_available(stream.decisions(stream.errors(spans), 60_000_000, "1 second"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    left = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "checkpoint")).collect()
    assert len(left) <= 1  # of the trace that came last, whose window the watermark hasn't passed


def test_stamps_ahead_of_the_clock_are_clamped(spark):
    from pyspark.sql import functions as F

    from emberline.streaming import retain as stream

    spans = spark.range(2).select(F.timestamp_micros(F.when(F.col("id") == 0, 5).otherwise(4_000_000_000_000_000)).alias("arrival"), F.lit(0).alias("arrival_us"))
    a, b = sorted(stream.clamped(spans).collect(), key=lambda r: r.skewed)
    assert not a.skewed and a.arrival_us == 5 and b.skewed and b.arrival_us < 4_000_000_000_000_000
