"""Settings of a retention run: every key, its default and what it may be."""

from __future__ import annotations

import dataclasses
import math
import re

SECOND = 1_000_000_000
MIB = 1 << 20
_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND}


def duration_ns(value: int | str) -> int:
    """Nanoseconds of a number of them, or of text such as 5m, 1h30m or 250ms."""
    if isinstance(value, int):
        return value
    text = value.strip()
    sign, text = (-1, text[1:]) if text.startswith("-") else (1, text)
    if text == "0":
        return 0
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {value!r}")
    return sign * sum(int(float(a) * _UNITS[b]) for a, b in parts)


@dataclasses.dataclass(frozen=True)
class Policy:
    name: str
    condition: str


@dataclasses.dataclass(frozen=True)
class Nats:
    """An empty mode, subject or stream stands for its default."""

    url: str = ""
    mode: str = "durable"
    subject: str = "keeps"
    stream: str = "KEEPS"
    creds_file: str = ""

    def __post_init__(self) -> None:
        for f in dataclasses.fields(self):
            if f.name in ("mode", "subject", "stream") and getattr(self, f.name) == "":
                object.__setattr__(self, f.name, f.default)


@dataclasses.dataclass(frozen=True)
class Bus:
    type: str = "loopback"
    nats: Nats = Nats()


@dataclasses.dataclass(frozen=True)
class Config:
    storage_dir: str
    disk_budget: int
    window: int = 5 * 60 * SECOND
    window_floor: int = 60 * SECOND
    watermark_pct: int = 80
    shards: int = 0
    segment_size: int = 32 * MIB
    keep_on_error: bool = True
    span_latency_threshold: int = 0
    trace_latency_threshold: int = 0
    trace_age_threshold: int = 0
    baseline_rate: float = 0.0
    policies: tuple[Policy, ...] = ()
    t0_attribute: str = "baggage.t0"
    elapsed_ms_attribute: str = "baggage.elapsed_ms"
    bus: Bus = Bus()

    def __post_init__(self) -> None:
        problems = list(self._problems())
        if problems:
            raise ValueError("; ".join(problems))

    def _problems(self):
        from emberline.functions.rules import compile_condition

        if not self.storage_dir:
            yield "storage_dir is required"
        if self.disk_budget <= 0:
            yield "disk_budget must be positive"
        if self.window <= 0:
            yield "window must be positive"
        if not 0 < self.window_floor < self.window:
            yield "window_floor must lie between 0 and window"
        if not 0 < self.watermark_pct <= 100:
            yield "watermark_pct must lie in (0, 100]"
        if self.shards < 0:
            yield "shards must not be negative"
        if not MIB <= self.segment_size <= 1024 * MIB:
            yield "segment_size must lie between 1 MiB and 1 GiB"
        for name in ("span_latency_threshold", "trace_latency_threshold", "trace_age_threshold"):
            if getattr(self, name) < 0:
                yield f"{name} must not be negative"
        if math.isnan(self.baseline_rate) or not 0 <= self.baseline_rate <= 1:
            yield "baseline_rate must lie in [0, 1]"
        if self.trace_age_threshold and not self.t0_attribute:
            yield "trace_age_threshold needs t0_attribute"
        if self.trace_latency_threshold and not self.elapsed_ms_attribute:
            yield "trace_latency_threshold needs elapsed_ms_attribute"
        seen = set()
        for p in self.policies:
            if not p.name:
                yield "a policy needs a name"
            elif p.name in seen:
                yield f"policy {p.name} is there twice"
            seen.add(p.name)
            try:
                compile_condition(p.condition)
            except ValueError as e:
                yield f"policy {p.name}: {e}"
        if self.bus.type not in ("loopback", "nats"):
            yield f"unknown bus {self.bus.type}"
        if self.bus.type == "nats":
            if not self.bus.nats.url:
                yield "bus.nats.url is required"
            if self.bus.nats.mode not in ("at_most_once", "durable"):
                yield f"unknown bus mode {self.bus.nats.mode}"
            for name in ("subject", "stream"):
                token = getattr(self.bus.nats, name)
                if re.search(r"[*>\s]", token):
                    yield f"bus.nats.{name} must be a plain token"
        if self.disk_budget > 0 and self.shards > 0 and self.disk_budget // 100 * self.watermark_pct <= self.shards * self.segment_size:
            yield "the watermark must exceed one segment a shard"

    @property
    def watermark_bytes(self) -> int:
        return self.disk_budget // 100 * self.watermark_pct

    @classmethod
    def of(cls, given: dict) -> Config:
        """From nested plain values; an unknown key is an error, durations may be text."""

        def build(kind, values: dict, at: str):
            known = {f.name: f for f in dataclasses.fields(kind)}
            if unknown := set(values) - set(known):
                raise ValueError(f"unknown key {at}{sorted(unknown)[0]}")
            return kind(**values)

        values = dict(given)
        for name in ("window", "window_floor", "span_latency_threshold", "trace_latency_threshold", "trace_age_threshold"):
            if name in values:
                values[name] = duration_ns(values[name])
        if "policies" in values:
            values["policies"] = tuple(p if isinstance(p, Policy) else build(Policy, p, "policies.") for p in values["policies"])
        if isinstance(values.get("bus"), dict):
            bus = dict(values["bus"])
            if isinstance(bus.get("nats"), dict):
                bus["nats"] = build(Nats, bus["nats"], "bus.nats.")
            values["bus"] = build(Bus, bus, "bus.")
        for name in ("storage_dir", "disk_budget"):
            values.setdefault(name, "" if name == "storage_dir" else 0)
        return build(cls, values, "")
