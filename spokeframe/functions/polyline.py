"""Encoded polylines and simplification of tracks, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

COORDS = "array<struct<lat:double,lon:double>>"


def decode_text(text: str) -> list[tuple[float, float]]:
    """Zig-zag numbers in groups of five bits, as differences of 1e-5 degrees. Raises ValueError for what is cut short."""
    groups = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.int64) - 63
    if len(groups) and (groups.min() < 0 or groups.max() > 63 or groups[-1] >= 32):
        raise ValueError("not an encoded polyline")
    ends = np.flatnonzero(groups < 32)
    if len(ends) % 2:
        raise ValueError("a longitude is missing")
    if not len(ends):
        return []
    starts = np.r_[0, ends[:-1] + 1]
    shift = (np.arange(len(groups)) - np.repeat(starts, ends - starts + 1)) * 5
    numbers = np.add.reduceat((groups & 31) << shift, starts)
    steps = np.where(numbers & 1, ~(numbers >> 1), numbers >> 1)
    points = np.cumsum(steps.reshape(-1, 2), axis=0) / 1e5
    return list(map(tuple, points.tolist()))


def encode_points(points: list[tuple[float, float]]) -> str:
    whole = np.rint(np.array(points, float).reshape(-1, 2) * 1e5).astype(np.int64)
    steps = np.diff(whole, axis=0, prepend=np.zeros((1, 2), np.int64)).reshape(-1)
    out = []
    for n in np.where(steps < 0, ~(steps << 1), steps << 1).tolist():
        while n >= 32:
            out.append(chr((32 | n & 31) + 63))
            n >>= 5
        out.append(chr(n + 63))
    return "".join(out)


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists or strings: where each begins and ends among the values, and which are null."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets[:-1], offsets[1:], np.asarray(column.is_null())


def _inside(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of all values of the spans, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def _decoded(texts: pa.Array) -> pa.Array:
    """Lists of points; null where a text is empty or no polyline. All texts of a batch go through arrays at once."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    starts, ends, none = _spans(texts)
    data = texts.buffers()[2]
    groups = np.frombuffer(data, np.uint8).astype(np.int64) - 63 if data is not None else np.zeros(0, np.int64)
    sums = lambda mask: np.r_[0, np.cumsum(mask)]
    count = lambda mask: sums(mask)[ends] - sums(mask)[starts]
    some = ends > starts
    last = groups[np.where(some, ends - 1, 0)] if len(groups) else np.zeros(len(starts), np.int64)
    fine = ~none & some & (count((groups < 0) | (groups > 63)) == 0) & (last < 32) & (count(groups < 32) % 2 == 0)
    at = _inside(starts[fine], ends[fine])
    g, owner = groups[at], np.repeat(np.arange(fine.sum()), (ends - starts)[fine])
    stops = np.flatnonzero(g < 32)
    begins = np.r_[0, stops[:-1] + 1] if len(stops) else stops
    shift = (np.arange(len(g)) - np.repeat(begins, stops - begins + 1)) * 5
    numbers = np.add.reduceat((g & 31) << shift, begins) if len(begins) else np.zeros(0, np.int64)
    steps = np.where(numbers & 1, ~(numbers >> 1), numbers >> 1).reshape(-1, 2)
    sizes = np.bincount(owner[stops], minlength=fine.sum()) // 2 if len(stops) else np.zeros(fine.sum(), np.int64)
    total = np.cumsum(steps, axis=0)
    first = np.cumsum(sizes) - sizes
    before = np.where((first > 0)[:, None], total[np.maximum(first - 1, 0)], 0) if len(total) else np.zeros((len(sizes), 2), np.int64)
    points = (total - np.repeat(before, sizes, axis=0)) / 1e5
    return _lists_of(points, sizes, fine)


def _lists_of(points: np.ndarray, sizes: np.ndarray, fine: np.ndarray) -> pa.Array:
    """Lists of points; those that are not fine are null, the others have the sizes in turn."""
    lengths = np.zeros(len(fine), np.int64)
    lengths[fine] = sizes
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["lat", "lon"])
    return pa.ListArray.from_arrays(pa.array(offsets), struct, mask=pa.array(~fine))


def _encoded(lat: pa.Array, lon: pa.Array) -> pa.Array:
    """lat, lon: lists of equal sizes. Their polylines; null for null lists."""
    (starts, ends, none), (other, *_) = _spans(lat), _spans(lon)
    ends = np.where(none, starts, ends)
    sizes = ends - starts
    value = lambda column, at: np.rint(column.values.to_numpy(zero_copy_only=False)[at] * 1e5).astype(np.int64)
    whole = np.c_[value(lat, _inside(starts, ends)), value(lon, _inside(other, other + sizes))]
    steps = np.diff(whole, axis=0, prepend=np.zeros((1, 2), np.int64))
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    steps[first] = whole[first]
    flat = steps.reshape(-1)
    numbers = np.where(flat < 0, ~(flat << 1), flat << 1)
    groups = np.ones(len(numbers), np.int64)
    left = numbers >> 5
    while left.any():
        groups += left > 0
        left >>= 5
    own = np.repeat(np.arange(len(numbers)), groups)
    place = np.arange(len(own)) - np.repeat(np.cumsum(groups) - groups, groups)
    letters = ((numbers[own] >> (5 * place)) & 31) + np.where(place < groups[own] - 1, 32, 0) + 63
    per = np.zeros(len(sizes) + 1, np.int64)
    np.add.at(per, 1 + np.repeat(np.arange(len(sizes)), 2 * sizes), groups)
    known = pa.py_buffer(np.packbits(~none, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.cumsum(per).astype(np.int32)), pa.py_buffer(letters.astype(np.uint8).tobytes()), known)


def decode(text: Column) -> Column:
    """Points of an encoded polyline; null where it is empty or broken."""

    @F.arrow_udf(COORDS)
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(_decoded, batches)

    return decoded(text)


def encode(coords: Column) -> Column:
    """The encoded polyline; null for a null track, empty for one without points."""

    @F.arrow_udf("string")
    def encoded(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lat, lon in batches:
            yield _encoded(lat, lon)

    return encoded(coords.getField("lat"), coords.getField("lon"))


def kept_points(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points stay: between two kept ones, the point farthest from the line through them stays if it is farther than the tolerance."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    open_ = [(0, len(points) - 1)]
    while open_:
        a, b = open_.pop()
        if b - a < 2:
            continue
        chord, off = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*chord)
        far = np.abs(chord[0] * off[:, 1] - chord[1] * off[:, 0]) / length if length else np.hypot(off[:, 0], off[:, 1])
        most = int(far.argmax())
        if far[most] > tolerance:
            keep[a + 1 + most] = True
            open_ += [(a, a + 1 + most), (a + 1 + most, b)]
    return keep


def simplify(coords: Column, tolerance_deg: float = 5e-5) -> Column:
    """The track with only the points that its shape needs; a null track is an empty one."""

    @F.arrow_udf(COORDS)
    def simplified(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lat, lon in batches:
            (starts, ends, none), (other, *_) = _spans(lat), _spans(lon)
            y, x = (c.values.to_numpy(zero_copy_only=False) for c in (lat, lon))
            kept, sizes = [np.zeros((0, 2))], np.zeros(len(starts), np.int64)
            for i in np.flatnonzero(~none & (ends > starts)).tolist():
                n = ends[i] - starts[i]
                points = np.c_[y[starts[i] : ends[i]], x[other[i] : other[i] + n]]
                kept.append(points[kept_points(points, tolerance_deg)] if n > 2 else points)
                sizes[i] = len(kept[-1])
            yield _lists_of(np.concatenate(kept), sizes, np.ones(len(starts), bool))

    return simplified(coords.getField("lat"), coords.getField("lon"))
