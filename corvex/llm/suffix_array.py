"""Suffix arrays by induced sorting, and their permuted common prefixes, over numpy arrays.

Suffixes are classified; the leftmost-smaller substrings are sorted by induction and named; the string of their
names is sorted by recursion, whatever its size; and its order induces that of all suffixes. The induction is
linear: a bucket (the suffixes that begin with one symbol) is filled in the order in which earlier buckets and the
bucket itself induce it, a whole bucket's worth of suffixes at a time, or one by one where buckets are tiny.
"""

from __future__ import annotations

import numpy as np


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last symbol is the unique smallest."""
    n = len(s)
    up = np.empty(n, bool)
    up[-1] = True
    up[:-1] = s[:-1] < s[1:]
    equal = np.flatnonzero(s[:-1] == s[1:])
    if len(equal):  # a run takes the type at its end
        ends = np.flatnonzero(np.append(s[:-1] != s[1:], True))
        up[equal] = up[ends[np.searchsorted(ends, equal)]]
    return up


def _induce(s: np.ndarray, up: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller suffixes `lms` induce."""
    n, k = len(s), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    lms_at = np.searchsorted(s[lms], np.arange(k + 1)) if len(lms) else np.zeros(k + 1, np.int64)
    head = starts[:-1].copy()

    def place(pred: np.ndarray) -> None:
        ch = s[pred]
        order = np.argsort(ch, kind="stable")
        ch, pred = ch[order], pred[order]
        first = np.flatnonzero(np.append(True, ch[1:] != ch[:-1])) if len(ch) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(ch)))
        sa[np.repeat(head[ch[first]] - first, size) + np.arange(len(ch))] = pred
        head[ch[first]] += size

    for c in range(k):
        done = starts[c]
        while done < head[c]:  # the larger-type suffixes of this bucket, as they come
            now, done = sa[done : head[c]], head[c]
            pred = now[now > 0] - 1
            place(pred[~up[pred]])
        pred = lms[lms_at[c] : lms_at[c + 1]] - 1
        place(pred[pred >= 0])
    filled = head.copy()
    tail = starts[1:].copy()

    def place_back(pred: np.ndarray) -> None:
        ch = s[pred]
        order = np.argsort(ch, kind="stable")
        ch, pred = ch[order], pred[order]
        first = np.flatnonzero(np.append(True, ch[1:] != ch[:-1])) if len(ch) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(ch)))
        sa[np.repeat(tail[ch[first]] - 1 + first, size) - np.arange(len(ch))] = pred
        tail[ch[first]] -= size

    sa_last = n - 1
    for c in range(k - 1, -1, -1):
        if c == 0:
            sa[0] = sa_last
        done = starts[c + 1]
        while done > tail[c]:
            now, done = sa[tail[c] : done][::-1], tail[c]
            pred = now[now > 0] - 1
            place_back(pred[up[pred]])
        now = sa[starts[c] : filled[c]][::-1]
        pred = now[now > 0] - 1
        place_back(pred[up[pred]])
    return sa


def _ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)


def _names(s: np.ndarray, order: np.ndarray, size_at: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings in sorted `order`: equal substrings get equal names."""
    size = size_at[order]
    differ = np.ones(len(order), bool)
    same = np.flatnonzero(size[1:] == size[:-1])
    if len(same):
        n = size[1:][same]
        a, b = s[_ragged(order[:-1][same], n)], s[_ragged(order[1:][same], n)]
        differ[same + 1] = np.logical_or.reduceat(a != b, np.cumsum(n) - n)
    return np.cumsum(differ) - 1


def _induce_each(s: np.ndarray, up: np.ndarray, lms: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same, a suffix at a time: for strings of so many symbols that a bucket holds but a few suffixes."""
    n = len(s)
    before, falls = np.append(-1, s[:-1]), np.append(False, ~up[:-1])
    # by suffix, the symbol before it if that begins a larger-type suffix (or a smaller-type one); n is no suffix
    larger, smaller = np.append(np.where(falls, before, -1), -1).tolist(), np.append(np.where(falls, -1, before), -1).tolist()
    sa, tail = np.full(n, n, np.int64), starts[1:]
    first = np.searchsorted(s[lms], np.arange(len(starts)))
    size = np.diff(first)
    sa[_ragged(tail - size, size)] = lms  # each bucket's at its end, in their order
    sa, head = sa.tolist(), starts[:-1].tolist()
    for i in sa:  # reads what the loop itself puts further on
        c = larger[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    tail = tail.tolist()
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            at = tail[c] = tail[c] - 1
            sa[at] = i - 1
    return np.array(sa, np.int64)


FULL_BUCKET = 64  # suffixes of a bucket, on average, from which on whole buckets are moved


def suffix_array(s: np.ndarray) -> np.ndarray:
    """`s`: small non-negative integers; the last is 0 and occurs nowhere else."""
    s = np.asarray(s)
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    k = int(s.max()) + 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=k))]).astype(np.int64)
    up = suffix_types(s)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    by_first = lms[np.argsort(s[lms], kind="stable")]
    induce = _induce if n >= FULL_BUCKET * k else _induce_each
    sa = induce(s, up, by_first, starts)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]  # sorted by substring
    size_at = np.zeros(n, np.int64)
    size_at[lms] = np.append(np.diff(lms) + 1, 1)
    names = _names(s, order, size_at)
    if names[-1] < len(lms) - 1:
        name_at = np.empty(n, np.int64)
        name_at[order] = names
        text = name_at[lms]  # ends with the unique smallest name, that of the last symbol
        order = lms[suffix_array(text)]
    return induce(s, up, order, starts)


def common_prefixes(raw: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """By text position, the length of the prefix shared with the suffix before it in `sa`.

    Only where the preceding symbols differ (irreducible values) are bytes compared; elsewhere the value is
    one less than at the position before. `raw` is uint8.
    """
    n = len(raw)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    prev = np.append(np.uint8(0), raw[:-1])
    own = (phi < 0) | (np.arange(n) == 0) | (phi == 0) | (prev != prev[np.maximum(phi, 0)])
    at = np.flatnonzero(own)
    words = np.ndarray((n,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    value = np.zeros(len(at), np.int64)
    live = np.flatnonzero(phi[at] >= 0)
    i, j = at[live], phi[at[live]]
    while len(live):
        inside = np.maximum(i, j) < n
        live, i, j = live[inside], i[inside], j[inside]
        x = words[i] ^ words[j]
        low = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3
        value[live] += np.minimum(np.where(x == 0, 8, low), n - np.maximum(i, j))
        go = x == 0
        live, i, j = live[go], i[go] + 8, j[go] + 8
    run = np.cumsum(own) - 1
    return np.maximum(value[run] - (np.arange(n) - at[run]), 0)
