"""Repeated strings of a minimum length from a Burrows-Wheeler transform.

The intervals of all strings of length 1, 2, 3, ... in suffix order are found breadth-first: the
interval of a string extended by one symbol to the left follows from the transform alone. The end of
a new interval is a boundary where neighbouring suffixes share one symbol less than the string has;
boundaries thus come up in increasing order of their common prefix, and each is expanded once. The
search stops at the minimum length: neighbours without a boundary by then share at least that much.
Suffixes need to be sorted by so many symbols only.
"""

from __future__ import annotations

import numpy as np

#: Bits of a symbol (a byte or the end of a string), and how many symbols one sort key takes.
BITS, PACKED = 9, 7
END = 0


def concatenated(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of strings data[bounds[i]:bounds[i + 1]], each followed by END, and their first places."""
    n = len(bounds) - 1
    text = np.zeros(len(data) + n, np.uint16)
    text[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(bounds))] = data.astype(np.uint16) + 1
    return text, bounds[:-1] + np.arange(n)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first `depth` symbols; each round doubles what is compared and
    sorts only suffixes that still tie."""
    n = len(text)
    padded = np.zeros(n + PACKED, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for j in range(PACKED):
        key |= padded[j:j + n] << np.uint64(BITS * (PACKED - 1 - j))
    order = np.argsort(key).astype(np.int64)
    slots, key, rank, done = np.arange(n), key[order], np.zeros(n + 1, np.int64), PACKED
    while True:
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rank[order[slots]] = slots[heads][group] + 1
        tied = np.diff(np.append(heads, len(slots)))[group] > 1
        slots = slots[tied]
        if done >= depth or not len(slots):
            return order
        at = order[slots]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[np.minimum(at + done, n)].astype(np.uint64)
        by = np.argsort(key)
        order[slots], key, done = at[by], key[by], 2 * done


def short_boundaries(last: np.ndarray, depth: int) -> np.ndarray:
    """True at i where sorted suffixes i - 1 and i share fewer than `depth` symbols, as far as the
    shared part holds no END. `last` is the transform: the symbol before each sorted suffix."""
    n = len(last)
    found = np.zeros(n + 1, bool)
    found[[0, n]] = True
    by = np.argsort(last, kind="stable")
    step = np.empty(n, np.int64)
    step[by] = np.arange(n)
    change = np.ones(n, bool)
    change[1:] = last[1:] != last[:-1]
    run_of, run_start = np.cumsum(change) - 1, np.append(np.flatnonzero(change), n)
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(depth):
        first, final = run_of[low], run_of[high - 1]
        one = first == final
        one_low, one_high = low[one], high[one]
        real = last[one_low] != END
        new_low, new_high = step[one_low[real]], step[one_high[real] - 1] + 1
        if not one.all():
            low, high, first, count = low[~one], high[~one], first[~one], (final - first + 1)[~one]
            own = np.repeat(np.arange(len(low)), count)
            run = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]
            start, end = np.maximum(run_start[run], low[own]), np.minimum(run_start[run + 1], high[own])
            symbol = last[start]
            key = (own << BITS) | symbol
            order = np.argsort(key, kind="stable")
            order = order[symbol[order] != END]
            key = key[order]
            head = np.ones(len(key), bool)
            head[1:] = key[1:] != key[:-1]
            tail = np.append(head[1:], True)[:len(key)]
            new_low = np.concatenate([new_low, step[start[order[head]]]])
            new_high = np.concatenate([new_high, step[end[order[tail]] - 1] + 1])
        fresh = ~found[new_high]
        low, high = new_low[fresh], new_high[fresh]
        if not len(low):
            break
        found[high] = True
    return found[:n]


def repeated_starts(data: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """True for each byte of `data` that starts a string of `length` bytes, within its own string, that
    starts at another byte too."""
    out = np.zeros(len(data), bool)
    if not len(data):
        return out
    text, first = concatenated(data, bounds)
    order = sorted_suffixes(text, length)
    boundary = short_boundaries(text[order - 1], length)
    size = np.diff(bounds) + 1
    room = np.repeat(first + size - 1, size) - np.arange(len(text))
    whole = room >= length
    linked = np.flatnonzero(~boundary[1:] & whole[order[:-1]])
    mark = np.zeros(len(text), bool)
    mark[order[linked]] = mark[order[linked + 1]] = True
    return mark[text != END]
