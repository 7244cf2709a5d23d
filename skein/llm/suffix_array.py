"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def packed(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as big-endian numbers; zeros beyond the end."""
    buf = np.concatenate([text, np.zeros(8, np.uint8)]).tobytes()
    return np.ndarray(shape=(len(text),), dtype=">u8", buffer=buf, strides=(1,)).astype(np.uint64)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank) of a uint8 text of less than 2**31 bytes; a suffix that is a prefix of another comes first.

    Larsson-Sadakane: suffixes are sorted by 8 bytes; then, doubling h, only groups still unsorted are refined by
    the rank of the suffix h further on. A group's number is its last place, so that finished groups keep theirs.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    keys = packed(text)
    known = np.minimum(n - np.arange(n), 8).astype(np.uint8)  # of a key's bytes; the others are padding
    sa = (np.lexsort((known, keys)) if (text == 0).any() else np.argsort(keys)).astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = (keys[sa[1:]] != keys[sa[:-1]]) | (known[sa[1:]] != known[sa[:-1]])
    rank = np.empty(n, np.int32)

    def number(places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The last place of each place's group."""
        ends = np.concatenate([np.nonzero(first)[0][1:] - 1, [len(first) - 1]])
        return places[ends][np.cumsum(first) - 1]

    group = number(np.arange(n, dtype=np.int32), new)
    rank[sa] = group
    single = new & np.concatenate([new[1:], [True]])
    places = np.nonzero(~single)[0].astype(np.int32)
    h = 8
    while len(places):
        own = sa[places]
        after = own + h
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort((rank[own].astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64))
        own, key = own[order], key[order]
        was = rank[own]
        first = np.ones(len(own), bool)
        first[1:] = (was[1:] != was[:-1]) | (key[1:] != key[:-1])
        sa[places] = own
        rank[own] = number(places, first)
        single = first & np.concatenate([first[1:], [True]])
        places = places[~single]
        h *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[i]: common prefix of suffixes sa[i-1] and sa[i]; lcp[0] is 0.

    Kasai's observation, read along the text: if the characters before both suffixes are equal, the common prefix is
    that of the position before, less one. Only the other positions are compared, eight bytes at a time; the rest
    follow by a running maximum.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    prior = np.full(n, -1, np.int32)
    prior[sa[1:]] = sa[:-1]
    at = np.arange(n, dtype=np.int32)
    told = (prior > 0) & (at > 0)
    told[told] = text[at[told] - 1] == text[prior[told] - 1]
    a = np.nonzero(~told & (prior >= 0))[0]
    b = prior[a]
    length = np.zeros(len(a), np.int64)
    keys = packed(text)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        if not len(live):
            break
        differ = keys[x] ^ keys[y]
        room = np.minimum(n - np.maximum(x, y), 8)
        same = np.full(len(live), 8)
        some = differ != 0
        # Leading equal bytes of the big-endian words.
        top = np.frexp(differ[some].astype(np.float64))[1]
        top = top - ((np.uint64(1) << np.clip(top - 1, 0, 63).astype(np.uint64)) > differ[some])
        same[some] = (64 - top) // 8
        same = np.minimum(same, room)
        length[live] += same
        live = live[same == 8]
    marks = np.full(n, -1, np.int64)
    marks[a] = a + length
    marks[prior < 0] = at[prior < 0]
    plcp = np.maximum(np.maximum.accumulate(marks) - at, 0)
    plcp[prior < 0] = 0
    lcp = plcp[sa]
    lcp[0] = 0
    return lcp
