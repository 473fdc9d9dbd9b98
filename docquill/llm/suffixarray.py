"""Suffix arrays of byte segments: Larsson-Sadakane refinement and Kasai's common prefixes, on whole numpy arrays."""

from __future__ import annotations

import numpy as np

HEAD = 7  # bytes that the first sort looks at
FEW = 32  # pairs of suffixes from which on each is compared to its end at once

POWERS = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)  # the least words of two bytes, three, up to eight


def words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, big-endian; zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64)


def suffix_array(data: np.ndarray, ends: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """Places of data in the order of the suffixes of its segments (ends: each segment's end, ascending). A suffix that
    is the start of another comes first; equal ones of several segments follow the order of the segments. eight: the words
    of data, if they are there already.

    Suffixes are sorted by their first HEAD bytes, which gives groups; then, the known length doubling, only groups of
    more than one are sorted by the group of the suffix that far ahead, until all are alone.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=0)
    small = np.int32 if n + len(ends) < 1 << 31 else np.int64  # what is looked up at random places is kept small
    owner = np.repeat(np.arange(len(ends), dtype=small), sizes)
    left = np.repeat(ends.astype(small), sizes) - np.arange(n, dtype=small)
    key = words(data) if eight is None else eight.copy()
    near = np.nonzero(left < HEAD)[0]
    short = left[near].astype(np.uint64)
    cut = key[near] & (~np.uint64(0) << (np.uint64(64) - np.uint64(8) * short)) | short
    key &= ~np.uint64(0xFF)
    key |= np.uint64(HEAD)
    key[near] = cut
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.nonzero(first)[0]
    rank = np.empty(n, small)
    rank[order] = np.repeat(at, np.diff(at, append=n))  # a group's number is the place of its first suffix
    open_ = np.nonzero(~(first & np.concatenate((first[1:], [True]))))[0]  # places in order of suffixes not alone
    h = HEAD
    while len(open_):
        own = order[open_]
        ahead = np.minimum(own + h, n - 1)
        # Beyond a segment's end stands a mark of the segment's own, below all groups.
        after = np.where(left[own] > h, rank[ahead] + small(len(ends)), owner[own])
        both = rank[own].astype(np.int64) * (n + len(ends) + 1) + after
        by = np.argsort(both)
        order[open_] = own = own[by]
        both = both[by]
        new = np.concatenate(([True], both[1:] != both[:-1]))
        heads = np.nonzero(new)[0]
        runs = np.diff(heads, append=len(open_))
        rank[own] = np.repeat(open_[heads], runs)
        open_ = open_[np.repeat(runs, runs) > 1]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, ends: np.ndarray, order: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """For each place of the order, the length of the common prefix with the suffix before it (0 for the first).

    Kasai: going from a suffix to the next one in the text, its common prefix with its neighbour is at least one less.
    It is exactly one less unless the bytes before the two differ (or either begins a segment); so only such places are
    compared byte by byte, eight at a time, and all others follow.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    left = ends[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))] - np.arange(n)
    begins = np.zeros(n, bool)
    begins[0] = True
    begins[ends[:-1]] = True
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    fresh = (before < 0) | begins | begins[before] | (data[place - 1] != data[np.maximum(before, 1) - 1])
    w = words(data) if eight is None else eight
    mine = place[fresh & (before >= 0)]
    other = before[mine]
    most = np.minimum(left[mine], left[other])
    size = np.zeros(len(mine), np.int64)
    live = np.arange(len(mine))
    while len(live) > FEW:
        diff = w[np.minimum(mine[live] + size[live], n - 1)] ^ w[np.minimum(other[live] + size[live], n - 1)]
        step = np.full(len(live), 8, np.int64)
        odd = diff != 0
        step[odd] = leading_bytes(diff[odd])
        size[live] = np.minimum(size[live] + step, most[live])
        live = live[(step == 8) & (size[live] < most[live])]
    for k in live.tolist():  # copies of whole texts, which would take a round for every eight bytes
        a, b, done, end = int(mine[k]), int(other[k]), int(size[k]), int(most[k])
        unlike = data[a + done : a + end] != data[b + done : b + end]
        at = int(unlike.argmax()) if end > done else 0
        size[k] = done + at if end > done and unlike[at] else end
    common = np.zeros(n, np.int64)
    common[mine] = size
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    common = np.maximum(common[last] - (place - last), 0)
    return common[order]


def leading_bytes(diff: np.ndarray) -> np.ndarray:
    """How many leading bytes of each (non-zero) 64-bit word are zero."""
    return 7 - np.searchsorted(POWERS, diff, "right")
