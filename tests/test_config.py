import dataclasses

import pytest

from emberline.config import Bus, Config, Nats, Policy, duration_ns

GOOD = {"storage_dir": "/data", "disk_budget": 10 << 30}


def test_defaults():
    c = Config.of(GOOD)
    assert (c.window, c.window_floor, c.watermark_pct, c.shards, c.segment_size) == (300 * 10**9, 60 * 10**9, 80, 0, 32 << 20)
    assert c.keep_on_error and c.bus.type == "loopback" and c.policies == () and c.baseline_rate == 0
    assert (c.t0_attribute, c.elapsed_ms_attribute) == ("baggage.t0", "baggage.elapsed_ms")


def test_every_key_is_read():
    given = {
        "storage_dir": "/x", "disk_budget": 1 << 33, "window": "10m", "window_floor": "2m30s", "watermark_pct": 70, "shards": 2, "segment_size": 1 << 21, "keep_on_error": False,
        "span_latency_threshold": "1s", "trace_latency_threshold": "2s", "trace_age_threshold": "3m", "baseline_rate": 0.25, "policies": [{"name": "a", "condition": 'span.name == "x"'}],
        "t0_attribute": "t", "elapsed_ms_attribute": "e", "bus": {"type": "nats", "nats": {"url": "nats://h", "mode": "at_most_once", "subject": "s", "stream": "S", "creds_file": "f"}},
    }
    c, plain = Config.of(given), Config.of(GOOD)
    for f in dataclasses.fields(Config):
        assert getattr(c, f.name) != getattr(plain, f.name), f.name
    assert c.window == 600 * 10**9 and c.window_floor == 150 * 10**9 and c.policies == (Policy("a", 'span.name == "x"'),)
    assert c.bus == Bus("nats", Nats("nats://h", "at_most_once", "s", "S", "f"))


@pytest.mark.parametrize(
    "change, said",
    [
        ({"storage_dir": ""}, "storage_dir"), ({"disk_budget": 0}, "disk_budget"), ({"window": 0}, "window"), ({"window_floor": "5m"}, "window_floor"), ({"window_floor": 0}, "window_floor"),
        ({"watermark_pct": 0}, "watermark_pct"), ({"watermark_pct": 101}, "watermark_pct"), ({"shards": -1}, "shards"), ({"segment_size": 1 << 19}, "segment_size"), ({"segment_size": 1 << 31}, "segment_size"),
        ({"span_latency_threshold": -1}, "span_latency"), ({"trace_latency_threshold": 5, "elapsed_ms_attribute": ""}, "elapsed_ms"), ({"trace_age_threshold": 5, "t0_attribute": ""}, "t0_attribute"),
        ({"baseline_rate": 1.5}, "baseline_rate"), ({"baseline_rate": float("nan")}, "baseline_rate"), ({"policies": [{"name": "", "condition": "true"}]}, "name"),
        ({"policies": [{"name": "a", "condition": "span.name =="}]}, "a:"), ({"policies": [{"name": "a", "condition": 'span.name == "x"'}] * 2}, "twice"),
        ({"bus": {"type": "pigeon"}}, "pigeon"), ({"bus": {"type": "nats"}}, "url"), ({"bus": {"type": "nats", "nats": {"url": "u", "mode": "x"}}}, "mode"),
        ({"bus": {"type": "nats", "nats": {"url": "u", "subject": "a.*"}}}, "subject"), ({"bus": {"type": "nats", "nats": {"url": "u", "stream": "a b"}}}, "stream"), ({"colour": 1}, "colour"), ({"bus": {"kind": 1}}, "bus.kind"),
        ({"disk_budget": 100 << 20, "shards": 4}, "watermark"),
    ],
)
def test_problems_are_named(change, said):
    with pytest.raises(ValueError, match=said):
        Config.of(GOOD | change)


def test_durations():
    assert [duration_ns(x) for x in ("5m", "1h30m", "250ms", "1.5s", "-2s", "0", 7)] == [300 * 10**9, 5400 * 10**9, 250 * 10**6, 15 * 10**8, -2 * 10**9, 0, 7]
    with pytest.raises(ValueError):
        duration_ns("5 parsecs")
