"""Frames with a point near other frames' points: dense work on the Arrow arrays of one group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Bits of a cell number per axis; the outermost cells are never left by a step to a neighbour.
AXIS_BITS = 18
PROBES, PAIRS = 1 << 14, 1 << 20


def near_frames(distance: float, radius: int) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A function of frames, points and ``probes`` (row numbers) that gives each probe a bit per frame with a near point.

    Bit ``k + radius`` stands for the frame ``k`` later and says that one of its points lies within
    ``distance``. The points of a frame in one cell, as wide as the distance, share a box. A box that
    lies within reach, or out of it, as a whole is settled at once, as is a box of one point. Points
    of the other boxes are tried a few at a time, for as long as the probe has found none in that
    frame. Tasks get the functions by value, so they need no copy of this package.
    """
    limit = distance * distance
    # Three cells in a row along the last axis follow each other, so a search finds the first of them.
    columns = np.array([(a << 2 * AXIS_BITS) + (b << AXIS_BITS) - 1 for a in (-1, 0, 1) for b in (-1, 0, 1)], np.int64)

    def square(v: np.ndarray) -> np.ndarray:
        return v[..., 0] * v[..., 0] + v[..., 1] * v[..., 1] + v[..., 2] * v[..., 2]

    def cells(xyz: np.ndarray) -> np.ndarray:
        """Cell numbers around the middle of the points; what lies further out shares the outermost cells."""
        at, half = np.floor(xyz / (distance * 1.001)), 1 << (AXIS_BITS - 1)
        return (np.clip(at - np.median(at, axis=0), 1 - half, half - 2) + half).astype(np.int64)

    def tried(who, at, end, found, xyz, placed):
        """Those of ``who`` with a near point among the places ``at`` to ``end``, besides the ones found before."""
        done, size, more = np.zeros(len(xyz), bool), 4, [found]
        done[found] = True
        while len(who):
            size = max(1, min(size, PAIRS // len(who)))
            places = np.minimum(at[:, None] + np.arange(size), end[:, None] - 1)
            hit = (square(placed[places] - xyz[who][:, None]) <= limit).any(axis=1)
            done[who[hit]] = True
            more.append(who[hit])
            at, size = at + size, size * 4
            keep = ~done[who] & (at < end)
            who, at, end = who[keep], at[keep], end[keep]
        return np.concatenate(more)

    def run(frame: np.ndarray, xyz: np.ndarray, probes: np.ndarray) -> np.ndarray:
        masks = np.zeros(len(xyz), np.int64)
        if not len(probes):
            return masks[probes]
        cell = cells(xyz)
        key = frame.astype(np.int64) - frame.min() + radius
        for axis in range(3):
            key = (key << AXIS_BITS) + cell[:, axis]
        order = np.argsort(key, kind="stable")
        placed, ordered = xyz[order], key[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        ends = np.r_[starts[1:], len(ordered)]
        low, high = np.minimum.reduceat(placed, starts), np.maximum.reduceat(placed, starts)
        boxes = np.r_[ordered[starts], np.full(3, np.iinfo(np.int64).max)]
        turn = probes[np.argsort(key[probes], kind="stable")]
        for first in range(0, len(turn), PROBES):
            part = turn[first : first + PROBES]
            for k in [k for k in range(-radius, radius + 1) if k]:
                wanted = (columns[:, None] + (key[part] + (k << 3 * AXIS_BITS))).ravel()
                who, at, pairs = np.tile(part, 9), np.searchsorted(boxes, wanted), []
                for step in range(3):
                    hit = boxes[at + step] <= wanted + 2
                    who, at, wanted = who[hit], at[hit], wanted[hit]
                    pairs.append((who, at + step))
                who, box = (np.concatenate(side) for side in zip(*pairs))
                point, below, above = xyz[who], low[box], high[box]
                near = square(np.maximum(np.abs(point - below), np.abs(point - above))) <= limit
                reach = square(np.maximum(np.maximum(below - point, point - above), 0.0)) <= limit
                found, unsure = who[near], ~near & reach & (ends[box] - starts[box] > 1)
                if unsure.any():
                    found = tried(who[unsure], starts[box[unsure]], ends[box[unsure]], found, xyz, placed)
                masks[found] |= np.int64(1 << (k + radius))
        return masks[probes]

    return run
