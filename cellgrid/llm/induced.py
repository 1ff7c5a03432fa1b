"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Induction visits the buckets of the first symbol in order.  Neighbouring buckets that put
nothing into each other are visited together, so that each visit is a few array operations.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Start positions of all suffixes of ``text`` (values below ``symbols``) in sorted order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int32, copy=False)
    small = _is_smaller(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sorted_once = _induce(text, symbols, small, leftmost)
    if not len(leftmost):
        return sorted_once
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    order = sorted_once[is_leftmost[sorted_once]]
    names, count = _named(text, leftmost, order)
    if count < len(leftmost):
        order = leftmost[suffix_array(names, count)]
    return _induce(text, symbols, small, order)


def _is_smaller(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the empty suffix is the smallest."""
    n = len(text)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(text[1:] - text[:-1])
    step[-1] = -1
    where = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n))
    nearest = np.minimum.accumulate(where[::-1])[::-1]
    return step[nearest] > 0


def _named(text: np.ndarray, leftmost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings in text order, and how many differ."""
    n = len(text)
    ends = np.append(leftmost[1:], n)  # a substring reaches to the next start, inclusive
    slot = np.full(n, -1)
    slot[leftmost] = np.arange(len(leftmost))
    size = (ends - leftmost)[slot[order]]
    a, b = order[:-1], order[1:]
    same = (size[:-1] == size[1:]) & (np.maximum(a + size[:-1], b + size[1:]) < n)
    active = np.flatnonzero(same)
    offset = 0
    while len(active):
        differ = text[a[active] + offset] != text[b[active] + offset]
        same[active[differ]] = False
        active = active[~differ & (size[active] > offset)]
        offset += 1
    rank = np.concatenate([[0], np.cumsum(~same)])
    names = np.empty(len(leftmost), np.int64)
    names[slot[order]] = rank
    return names, int(rank[-1]) + 1


def _induce(text: np.ndarray, symbols: int, small: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost-smaller ones, given in their order."""
    n = len(text)
    heads = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
    found = np.full(n, -1, np.int32)
    _put_last(found, text, leftmost[::-1], heads[1:].copy())
    _larger(found, text, symbols, small, heads)
    # keep the larger suffixes only; the smaller ones are induced anew from them
    found[(found >= 0) & small[found]] = -1
    _smaller(found, text, symbols, small, heads)
    return found


def _put_first(found: np.ndarray, text: np.ndarray, rows: np.ndarray, free: np.ndarray) -> None:
    """``rows`` to the next free places of their buckets, in order."""
    symbols = text[rows]
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.flatnonzero(np.diff(symbols, prepend=-1))
    size = np.diff(np.append(first, len(symbols)))
    found[free[symbols] + np.arange(len(symbols)) - np.repeat(first, size)] = rows[order]
    free[symbols[first]] += size


def _put_last(found: np.ndarray, text: np.ndarray, rows: np.ndarray, free: np.ndarray) -> None:
    """``rows`` to the last free places of their buckets, from behind."""
    symbols = text[rows]
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.flatnonzero(np.diff(symbols, prepend=-1))
    size = np.diff(np.append(first, len(symbols)))
    found[free[symbols] - 1 - np.arange(len(symbols)) + np.repeat(first, size)] = rows[order]
    free[symbols[first]] -= size


def _larger(found: np.ndarray, text: np.ndarray, symbols: int, small: np.ndarray, heads: np.ndarray) -> None:
    """Suffixes larger than the next one, from left to right."""
    n = len(text)
    free = heads[:-1].copy()
    larger = np.flatnonzero(~small[:-1])
    limit = np.full(symbols + 1, symbols)
    np.minimum.at(limit, text[larger + 1], text[larger])
    limit = np.minimum.accumulate(limit[::-1])[::-1]
    _put_first(found, text, np.array([n - 1]), free)  # the empty suffix comes first of all

    def visit(rows: np.ndarray) -> None:
        before = rows[rows > 0] - 1
        before = before[~small[before]]
        if len(before):
            _put_first(found, text, before, free)

    at = 0
    while at < symbols:
        end = max(at + 1, int(limit[at]))
        if end == at + 1:
            low = heads[at]
            while low < free[at]:
                high = free[at]
                visit(found[low:high])
                low = high
            visit(found[low : heads[end]][found[low : heads[end]] >= 0])
        else:
            rows = found[heads[at] : heads[end]]
            visit(rows[rows >= 0])
        at = end


def _smaller(found: np.ndarray, text: np.ndarray, symbols: int, small: np.ndarray, heads: np.ndarray) -> None:
    """Suffixes smaller than the next one, from right to left."""
    free = heads[1:].copy()
    smaller = np.flatnonzero(small[:-1])
    limit = np.full(symbols, -1)
    np.maximum.at(limit, text[smaller + 1], text[smaller])
    limit = np.maximum.accumulate(limit)

    def visit(rows: np.ndarray) -> None:
        before = rows[rows > 0] - 1
        before = before[small[before]]
        if len(before):
            _put_last(found, text, before, free)

    at = symbols - 1
    while at >= 0:
        end = min(at - 1, int(limit[at]))
        if end == at - 1:
            high = heads[at + 1]
            while free[at] < high:
                low = free[at]
                visit(found[low:high][::-1])
                high = low
            rows = found[heads[at] : high]
            visit(rows[rows >= 0][::-1])
        else:
            rows = found[heads[end + 1] : heads[at + 1]]
            visit(rows[rows >= 0][::-1])
        at = end


def permuted_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By position: bytes shared with the suffix that is next smaller in ``order``.

    A value is one less than the one before it unless the bytes in front differ; only where
    they differ are prefixes compared, eight bytes at a time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    other = np.full(n, -1)
    other[order[1:]] = order[:-1]
    start = np.arange(n)
    fresh = (start == 0) | (other <= 0)
    fresh |= data[start - 1] != data[np.maximum(other - 1, 0)]
    rows = np.flatnonzero(fresh & (other >= 0))
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    room = n - np.maximum(rows, other[rows])
    at = np.zeros(len(rows), np.int64)
    active = np.arange(len(rows))
    while len(active):
        here = rows[active] + at[active]
        there = other[rows[active]] + at[active]
        differ = words[here] ^ words[there]
        step = np.where(differ == 0, 8, np.bitwise_count((differ & -differ) - np.uint64(1)) // 8)
        at[active] = np.minimum(at[active] + step, room[active])
        active = active[(differ == 0) & (at[active] < room[active])]
    shared[rows] = at
    last = np.maximum.accumulate(np.where(fresh, start, 0))
    return np.maximum(shared[last] - (start - last), 0) * (other >= 0)
