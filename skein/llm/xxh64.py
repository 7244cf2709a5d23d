"""XXH64 of many slices of one buffer at once, in numpy."""

from __future__ import annotations

import numpy as np

#: The hash's fixed primes.
P1, P2, P3, P4, P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(x: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(x + lane * P2, 31) * P1


def padded(data: np.ndarray) -> np.ndarray:
    """The buffer as `hashes` wants it: eight bytes may be read from any place."""
    return np.concatenate([data, np.zeros(8, np.uint8)])


def hashes(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of buffer[start : start + length] for each pair; buffer is `padded`."""
    eight = np.ndarray(shape=(len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    four = np.ndarray(shape=(len(buffer) - 3,), dtype="<u4", buffer=buffer, strides=(1,))
    at, end, s = start.copy(), start + length, np.uint64(seed)
    h = np.full(len(start), s + P5, np.uint64)
    with np.errstate(over="ignore"):
        long = np.nonzero(length >= 32)[0]
        if len(long):
            lanes = [np.full(len(long), v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
            live, places = np.arange(len(long)), at[long]
            while len(live):
                for i in range(4):
                    lanes[i][live] = _round(lanes[i][live], eight[places[live] + 8 * i])
                places[live] += 32
                live = live[end[long[live]] - places[live] >= 32]
            whole = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                whole = (whole ^ _round(np.zeros_like(lane), lane)) * P1 + P4
            h[long], at[long] = whole, places
        h += length.astype(np.uint64)
        live = np.nonzero(end - at >= 8)[0]
        while len(live):
            lane = eight[at[live]]
            h[live] = _turn(h[live] ^ _round(np.zeros_like(lane), lane), 27) * P1 + P4
            at[live] += 8
            live = live[end[live] - at[live] >= 8]
        live = np.nonzero(end - at >= 4)[0]
        h[live] = _turn(h[live] ^ (four[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
        at[live] += 4
        live = np.nonzero(end > at)[0]
        while len(live):
            h[live] = _turn(h[live] ^ (buffer[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
            live = live[end[live] > at[live]]
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))
