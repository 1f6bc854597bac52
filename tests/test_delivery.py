from pyspark.sql import functions as F

from emberline.operators import delivery


def test_every_fragment_is_buffered_or_shed(spark):
    rows = [(i % 2, i % 3, i // 40, i) for i in range(400)]
    out = delivery.offered(spark.createDataFrame(rows, "instance int, shard int, batch_id long, ord long"), 4)
    for r in delivery.accounting(out).collect():
        assert r.offered == r.buffered + r.shed
    by = {}
    for i, s, b, o in rows:
        by.setdefault((i, s, b), []).append(o)
    assert {r.ord for r in out.where("admitted").collect()} == {o for x in by.values() for o in sorted(x)[:4]}
    assert delivery.accounting(out.limit(0)).collect() == []


def test_failed_publications_are_parked_and_others_aren_t(spark):
    keeps = spark.createDataFrame([(f"t{i}", i * 10, i % 2) for i in range(200)], "trace_id string, decided_us long, origin_instance int")
    failed = spark.createDataFrame([("t3", 30), ("t3", 30), ("t4", 999), ("zz", 1)], "trace_id string, decided_us long")
    out = {r.trace_id: r for r in delivery.published(keeps, failed, 7).collect()}
    assert len(out) == 200 and {k for k, r in out.items() if r.outcome == "parked"} == {"t3"} and out["t3"].deadline_us == 37 and out["t4"].deadline_us == 0
    chunks = delivery.chunked(keeps, 10**9).groupBy("origin_instance", "chunk").count().collect()
    assert sorted(r["count"] for r in chunks) == [36, 36, 64, 64]


def test_errors_of_the_next_consumer(spark):
    flushes = spark.createDataFrame([(0, None), (1, "retryable"), (2, "permanent")], "ord int, e string")
    out = {r.ord: (r.outcome, r.need) for r in delivery.settled(flushes, F.col("e")).collect()}
    assert out == {0: ("delivered", 0), 1: ("retry", delivery.FLUSH), 2: ("dropped", 0)}


def test_narrow_numbers_and_pace(spark):
    rows = spark.createDataFrame([(2**40,), (-(2**40),), (5,)], "x long")
    assert [r[0] for r in rows.select(delivery.saturated(F.col("x"))).collect()] == [2**31 - 1, -(2**31), 5]
    assert [r[0] for r in spark.range(0, 300, 100).select(delivery.pace_us(F.col("id"), 50)).collect()] == [0, 2_000_000, 4_000_000]
