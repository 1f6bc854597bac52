import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import decide, metrics, retain, retention

W = 60


def model(times, w=W):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1] + w:
            out.append(t)
    return out


@pytest.fixture()
def verdicts(spark):
    return lambda rows: spark.createDataFrame(rows, "instance int, trace_id string, at_us long, ord long, reason int")


def test_windows_do_not_extend(verdicts):
    d = decide.decisions(verdicts([(0, "t", t, i, 1) for i, t in enumerate([0, 30, 70, 125, 200])]), W)
    assert sorted(r.decided_us for r in d.collect()) == [0, 70, 200]


def test_equal_to_a_model(verdicts):
    rng = random.Random(7)
    rows = [(rng.randrange(2), f"t{rng.randrange(20)}", rng.randrange(3000), i, rng.randint(1, 5)) for i in range(3000)]
    want = {(i, t): model([r[2] for r in rows if r[0] == i and r[1] == t]) for i in range(2) for t in {r[1] for r in rows}}
    got = {}
    for r in decide.decisions(verdicts(rows), W).collect():
        got.setdefault((r.instance, r.trace_id), []).append(r.decided_us)
        assert r.reason == min((x[3], x[4]) for x in rows if x[:3] == (r.instance, r.trace_id, r.decided_us))[1]
    assert {k: sorted(v) for k, v in got.items()} == want


def shared(rows, w, n):
    last, out = {}, []
    for i, t, at, o, reason in sorted(rows, key=lambda r: (r[2], r[3])):
        free = lambda k: at >= last.get((k, t), -1 << 60) + w
        if not free(i):
            continue
        others = [] if reason == 6 else [k for k in range(n) if k != i and free(k)]
        for k in [i, *others]:
            last[(k, t)] = at
            out.append((k, t, at, "bus" if k != i else "baseline" if reason == 6 else "local"))
    return sorted(out)


def test_several_instances_equal_a_model(verdicts):
    rng = random.Random(8)
    rows = [(rng.randrange(3), f"t{rng.randrange(10)}", rng.randrange(2000) * 5 + k % 5, k, rng.choice([1, 2, 6])) for k in range(800)]
    # One verdict a time and instance, as a batch gives.
    rows = list({(r[0], r[1], r[2]): r for r in reversed(rows)}.values())
    got = decide.across_instances(verdicts(rows), W, 3).select("instance", "trace_id", "decided_us", "origin").collect()
    assert sorted(map(tuple, got)) == shared(rows, W, 3)


def test_baseline_absorbs_a_later_error(verdicts):
    got = decide.across_instances(verdicts([(0, "t", 0, 0, 6), (0, "t", 10, 1, 1), (1, "t", 20, 2, 1)]), W, 2).collect()
    assert sorted((r.instance, r.decided_us, r.origin) for r in got) == [(0, 0, "baseline"), (1, 20, "local")]


@pytest.fixture()
def spans(spark):
    return lambda rows: spark.createDataFrame(rows, "instance int, trace_id string, ord long, arrival_us long")


def test_join_takes_both_sides_of_a_decision(spans, verdicts):
    rows = [(0, "t", i, t) for i, t in enumerate([0, 30, 70, 125, 200])]
    d = decide.decisions(verdicts([(0, "t", t, i, 1) for _, _, i, t in rows]), W)
    got = sorted((r.decided_us, r.arrival_us, r.late) for r in retain.retained(spans(rows), d, W).collect())
    assert got == [(0, 0, True), (0, 30, True), (70, 30, False), (70, 70, True), (70, 125, True), (200, 200, True)]


def test_join_equals_brute_force(spans, verdicts):
    rng = random.Random(3)
    rows = [(rng.randrange(2), f"t{rng.randrange(6)}", i, rng.randrange(-500, 2500)) for i in range(1500)]
    d = decide.decisions(verdicts([(i, t, a, o, 1) for i, t, o, a in rows if o % 7 == 0]), W).collect()
    want = sorted((o, x.decided_us) for i, t, o, a in rows for x in d if (x.instance, x.trace_id) == (i, t) and x.decided_us - W <= a < x.decided_us + W)
    table = decide.decisions(verdicts([(i, t, a, o, 1) for i, t, o, a in rows if o % 7 == 0]), W)
    assert sorted((r.ord, r.decided_us) for r in retain.retained(spans(rows), table, W).collect()) == want
    left = {r.ord for r in retain.expired(spans(rows), table, W).collect()}
    assert left == {o for _, _, o, _ in rows} - {o for o, _ in want}


def test_nothing_in_nothing_out(spans, verdicts):
    d = decide.decisions(verdicts([]), W)
    assert d.collect() == [] and retain.retained(spans([]), d, W).collect() == []
    assert [r.ord for r in retain.expired(spans([(0, "t", 1, 5)]), d, W).collect()] == [1]


@pytest.fixture()
def held(spark):
    return lambda rows: spark.createDataFrame(rows, "instance int, shard int, gen int, t_min_us long, t_max_us long, bytes long, n long, finalized boolean")


def ladder(rows, now, floor, limit):
    """The rung as a loop."""
    total, gone = sum(r[5] for r in rows), set()
    for r in sorted((r for r in rows if r[7]), key=lambda r: (r[4], r[1], r[2])):
        if total <= limit or r[4] >= now - floor:
            break
        gone.add((r[1], r[2]))
        total -= r[5]
    return gone


def test_early_expiry_equals_a_loop(held):
    rng = random.Random(5)
    for limit in (0, 500, 1500, 10_000):
        rows = [(0, s, g, 100 * g, 100 * g + rng.randrange(100), rng.randrange(1, 200), 1, g < 9) for s in range(2) for g in range(10)]
        got = retention.early_expiry(held(rows), F.lit(1000), 300, limit).where("sacrificed").collect()
        assert {(r.shard, r.gen) for r in got} == ladder(rows, 1000, 300, limit)


def test_shed_causes(held):
    rows = [(0, 0, 0, 0, 10, 90, 1, True), (0, 0, 1, 11, 20, 10, 1, False), (0, 1, 0, 0, 20, 10, 1, False)]
    causes = lambda floor, limit: {r.shard: r.cause for r in retention.shed_causes(held(rows), F.lit(30), floor, limit).collect()}
    assert causes(25, 50) == {0: "floor_protected", 1: "nothing_reclaimable"}
    assert causes(5, 50) == {0: None, 1: None}
    assert causes(5, 10) == {0: "nothing_reclaimable", 1: "nothing_reclaimable"}


def test_effective_window_and_expiry(held):
    second = 1_000_000
    rows = [(0, 0, 0, 0, 10 * second, 1, 1, True), (0, 0, 1, 0, 50 * second, 1, 1, True), (0, 1, 0, 0, 60 * second, 1, 1, False), (1, 0, 0, 0, 5, 1, 1, False)]
    got = {r.instance: r.effective_window_s for r in retention.effective_window(held(rows), F.lit(70 * second), 90 * second).collect()}
    assert got == {0: 60, 1: 90}
    assert retention.expired_segments(held(rows), F.lit(70 * second), 60 * second).where("instance = 0").count() == 0
    assert retention.expired_segments(held(rows), F.lit(70 * second + 1), 60 * second).where("instance = 0").count() == 1


def test_every_span_is_in_one_segment(spark):
    rows = [(0, f"t{i % 9}", i, i, 10 + i % 90) for i in range(500)]
    table = spark.createDataFrame(rows, "instance int, trace_id string, ord long, arrival_us long, size_bytes long")
    placed = retention.with_segments(table, (F.col("ord") % 3).cast("int"), 400)
    segs = retention.segments(placed).collect()
    assert sum(r.n for r in segs) == 500 and sum(r.bytes for r in segs) == sum(r[4] for r in rows)
    assert all(sum(not r.finalized for r in segs if r.shard == s) == 1 for s in range(3))


def test_age_ratios(spark):
    rows = [(100, (100 - a) * 1000) for a in (10, 30, 90, -50)] + [(100, 0)]
    got = metrics.age_ratio(spark.createDataFrame(rows, "flushed_us long, start_ns long"), 60).collect()
    assert {r.bound: r.n for r in got} == {0.25: 1, 0.5: 1, 1.5: 1, 0.1: 1}
