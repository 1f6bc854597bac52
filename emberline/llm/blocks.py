"""Arrays of integers as short byte strings, as they travel between tasks and lie in tables.

Bytes of one significance lie together, as many as the largest value needs, and are compressed; sorted values
are stored as differences. So a few million small numbers or sorted keys are one value of a row.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<BQ")


def pack(*arrays: np.ndarray) -> bytes:
    """Integers from 0 to 2^64 - 1; several arrays are compressed as one."""
    heads, planes = [], []
    for values in arrays:
        x = np.ascontiguousarray(values).astype("<u8", copy=False)
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        heads.append(_HEAD.pack(width, len(x)))
        at = x.view(np.uint8).reshape(-1, 8)
        planes += [np.ascontiguousarray(at[:, i]) for i in range(width)]
    body = b"".join(planes)
    return bytes([len(arrays)]) + b"".join(heads) + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def unpack_all(data: bytes) -> list[np.ndarray]:
    """The arrays that were packed, as int64; values from 2^63 on come back negative and are the same as uint64."""
    count = data[0]
    heads = [_HEAD.unpack_from(data, 1 + _HEAD.size * i) for i in range(count)]
    size, at, out = sum(width * n for width, n in heads), 0, []
    body = np.frombuffer(pa.decompress(memoryview(data)[1 + _HEAD.size * count :], decompressed_size=size, codec="zstd", asbytes=True), np.uint8) if size else None
    for width, n in heads:
        if width == 1:
            out.append(body[at : at + n].astype(np.int64) if n else np.zeros(0, np.int64))
        else:
            x = np.zeros((n, 8), np.uint8)
            for i in range(width):
                x[:, i] = body[at + i * n : at + (i + 1) * n]
            out.append(x.view("<i8").reshape(-1))
        at += width * n
    return out


def unpack(data: bytes) -> np.ndarray:
    """The only array that was packed."""
    return unpack_all(data)[0]


def gaps(values: np.ndarray) -> np.ndarray:
    """Integers from 0 to 2^64 - 1 in ascending order as differences, which `ascending` adds up again."""
    return np.diff(np.ascontiguousarray(values).astype("<u8", copy=False), prepend=np.uint64(0))


def ascending(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values.view(np.uint64), dtype=np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Integers from 0 to 2^64 - 1 in ascending order."""
    return pack(gaps(values))


def unpack_sorted(data: bytes) -> np.ndarray:
    """The values as uint64."""
    return ascending(unpack(data))


def order_of(x: np.ndarray) -> np.ndarray:
    """The order of ascending integers from 0 to 2^64 - 1, equal ones by place. Values with their places in the low
    bits are sorted, several times as fast as places by values; where what the places displace matters, those are."""
    x = x.view(np.uint64)
    if not len(x):
        return np.zeros(0, np.int64)
    bits = np.uint64(len(x).bit_length())
    fits = int(x.max()).bit_length() + int(bits) <= 64
    by = x << bits if fits else x >> bits << bits
    by |= np.arange(len(x), dtype=np.uint64)
    by.sort()
    by &= (np.uint64(1) << bits) - np.uint64(1)
    order = by.view(np.int64)
    if not fits:
        y = x[order]
        if (y[1:] < y[:-1]).any():
            return np.argsort(x, kind="stable")
    return order


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct integers from 0 to 2^64 - 1 in ascending order, and which of them each is."""
    order = order_of(x)
    y = x[order]
    new = np.ones(len(y), bool)
    new[1:] = y[1:] != y[:-1]
    y, place = y[new], np.cumsum(new)
    place -= 1
    which = np.empty(len(order), np.int64)
    which[order] = place
    return y, which


def joined(parts: list[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of all 64-bit keys each lies in."""
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def cuts_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins among sorted keys (ranges + 1 values)."""
    return np.searchsorted(range_of(keys, ranges), np.arange(ranges + 1))
