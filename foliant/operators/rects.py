"""Merging of rectangles, many pages at once: bands of pages are folded in step, so a step is array arithmetic over all of them."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

EDGES = ("x0", "y0", "x1", "y1")
#: Rectangles that are worked on at once; a page is never parted.
CHUNK = 200_000


def scaled(values: np.ndarray, digits: int) -> np.ndarray:
    """Values rounded to decimal digits, halves (of the shortest decimal) away from zero, times 10 ** digits."""
    s = values * 10.0**digits
    down = np.floor(s)
    with np.errstate(invalid="ignore"):
        part = s - down
        out = np.where(part < 0.5, down, down + 1)
        halves = np.flatnonzero(np.isfinite(s) & (np.abs(part - 0.5) <= 1e-6 + np.abs(s) * 1e-15))
    for i in halves:
        out[i] = float((Decimal(repr(float(values[i]))) * 10**digits).to_integral_value(ROUND_HALF_UP))
    return out


def _order(rects: np.ndarray, page: np.ndarray) -> np.ndarray | None:
    """Pages in turn, each by the rounded corner, ties by all edges; None where the rectangles stand so."""
    x0, y0, x1, y1 = rects
    keys = [page, scaled(y0, 1), scaled(x0, 1), y0, x0, y1, x1]
    open_, wrong = np.ones(max(0, len(page) - 1), bool), False
    for k in keys:
        wrong = wrong or bool((open_ & (k[1:] < k[:-1])).any())
        open_ &= k[1:] == k[:-1]
        if wrong or not open_.any():
            break
    return np.lexsort(keys[::-1]) if wrong else None


def _band_starts(y0: np.ndarray, y1: np.ndarray, bounds: np.ndarray, tolerance: float) -> np.ndarray:
    """Where a page begins, or a rectangle that no earlier one can reach, however grown, nor any behind it."""
    new = np.zeros(len(y0), bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            continue
        new[a] = True
        top, bottom = np.maximum.accumulate(y0[a : b - 1]), np.maximum.accumulate(y1[a : b - 1])
        high, low = np.minimum.accumulate(y0[a + 1 : b][::-1])[::-1], np.minimum.accumulate(y1[a + 1 : b][::-1])[::-1]
        new[a + 1 : b] = (high > top + tolerance) & (high >= bottom) & (low > bottom + tolerance)
    return np.flatnonzero(new)


def _touching(m: np.ndarray, r: np.ndarray, line: float, gap: float) -> np.ndarray:
    crossing = (np.maximum(m[0], r[0]) < np.minimum(m[2], r[2])) & (np.maximum(m[1], r[1]) < np.minimum(m[3], r[3]))
    with np.errstate(invalid="ignore"):  # infinite edges
        level = (np.abs(m[1] - r[1]) <= line) | (np.abs(m[3] - r[3]) <= line)
    return crossing | (level & (r[0] <= m[2] + gap) & (r[2] >= m[0] - gap))


def _fold(rects: np.ndarray, start: np.ndarray, length: np.ndarray, line: float, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(band, rectangle) of what bands hold, in turn: each rectangle grows the first one held that it touches, else is held itself."""
    bands, held = [], []
    size = np.frexp(length)[1]  # bands of like length go together
    for of in np.unique(size):
        mine = np.flatnonzero(size == of)
        mine = mine[np.argsort(-length[mine], kind="stable")]
        many, most = len(mine), int(length[mine[0]])
        hold = np.zeros((4, most, many))
        count = np.zeros(many, np.int64)
        hold[:, 0] = rects[:, start[mine]]
        count += 1
        for k in range(1, most):
            live = int(np.searchsorted(-length[mine], -k, "left"))  # bands with more than k
            r = rects[:, start[mine[:live]] + k]
            deep = int(count[:live].max())
            touch = _touching(hold[:, :deep, :live], r[:, None, :], line, gap) & (np.arange(deep)[:, None] < count[:live])
            at = np.where(touch.any(0), touch.argmax(0), count[:live])
            own = np.arange(live)
            grows = at < count[:live]
            old = hold[:, np.minimum(at, most - 1), own]
            hold[:2, at, own] = np.where(grows, np.minimum(old[:2], r[:2]), r[:2])
            hold[2:, at, own] = np.where(grows, np.maximum(old[2:], r[2:]), r[2:])
            count[:live] += ~grows
        used = np.arange(most)[:, None] < count
        nth, own = np.nonzero(used)
        bands.append(np.stack([mine[own], nth]))
        held.append(hold[:, nth, own])
    band, out = np.concatenate(bands, 1), np.concatenate(held, 1)
    order = np.lexsort((band[1], band[0]))
    return band[0][order], out[:, order]


def _firsts(rects: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Whether a rectangle is the first of its page among those equal to two decimals."""
    keys = [page, *(scaled(e, 2) + 0.0 for e in rects)]
    mixed = np.zeros(len(page), np.uint64)
    for k in keys:
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ np.asarray(k, np.float64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(mixed, kind="stable")
    same = np.flatnonzero(mixed[order][1:] == mixed[order][:-1])
    out, seen = np.ones(len(page), bool), set()
    for i in np.unique(np.concatenate([order[same], order[same + 1]])):
        key = tuple(k[i] for k in keys)
        out[i] = key not in seen
        seen.add(key)
    return out


def merged(rects: np.ndarray, counts: np.ndarray, line: float, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """Merged rectangles (4 x n) of pages, and their number a page, from the pages' rectangles one after another."""
    page = np.repeat(np.arange(len(counts)), counts)
    if not len(page):
        return rects, counts
    rects = np.where(np.isnan(rects), np.inf, rects)
    order = _order(rects, page)
    rects = rects if order is None else rects[:, order]
    start = _band_starts(rects[1], rects[3], np.concatenate([[0], np.cumsum(counts)]), line)
    band, out = _fold(rects, start, np.diff(np.append(start, len(page))), line, gap)
    page = page[start][band]
    keep = _firsts(out, page) & (out[2] > out[0]) & (out[3] > out[1])
    return out[:, keep], np.bincount(page[keep], minlength=len(counts))


def merge_lists(line: float, gap: float):
    """Of batches whose last column lists a page's rectangles: the same, merged."""
    kind = pa.list_(pa.struct([(e, pa.float64()) for e in EDGES]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False).astype(np.int64)
            behind, at = np.cumsum(counts), 0
            while at < len(counts):
                done = behind[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(behind, done + CHUNK, "right")))
                part = batch.slice(at, stop - at)
                lists = part.column(part.num_columns - 1).flatten()
                rects = np.stack([lists.field(e).to_numpy() for e in range(4)]) if len(lists) else np.empty((4, 0))
                out, n = merged(rects, counts[at:stop], line, gap)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(e) for e in out], fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=batch.schema.names)
                at = stop

    return work
