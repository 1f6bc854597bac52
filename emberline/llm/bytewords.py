"""Vectorised splitting and hashing of UTF-8 text columns, straight from Arrow buffers.

A batch's texts lie one after another in one byte array. Word boundaries are found for all texts at
once, and a word's 64-bit key comes from prefix sums of a polynomial over its bytes, so cost is a few
array passes and no Python work per word. Keys of different words are taken to differ; for n distinct
words the chance that any two share a key is about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes of text handled at once, unless one text is longer.
CHUNK = 2 << 20

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK + 1)
        for name, b in (("up", BASE), ("down", INVERSE)):
            p = np.full(n, b, U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=U)
    return _powers["up"], _powers["down"]


def forget() -> None:
    """Frees the powers, for a worker that cuts no more texts."""
    _powers.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(raw: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about limit bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    up, _ = _power(len(raw) + 1)
    out = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * up[: len(raw)], out=out[1:])
    return out


def span_keys(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of the byte spans [start, end)."""
    _, down = _power(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~IS_BLANK[raw]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[offsets] = True
    after = np.empty(n, bool)  # nothing of the same word lies before
    after[0] = True
    after[1:] = ~inside[:-1]
    after |= edge[:n]
    before = np.empty(n, bool)
    before[-1] = True
    before[:-1] = ~inside[1:]
    before |= edge[1:]
    starts = np.flatnonzero(inside & after)
    ends = np.flatnonzero(inside & before) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words, A-Z lowered; first word of each text; starts; ends."""
    low = LOWER[raw]
    starts, ends, first = word_spans(low, offsets)
    return span_keys(prefix_sums(low), starts, ends), first, starts, ends
