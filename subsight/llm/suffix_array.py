"""A suffix array by the difference-cover algorithm, in numpy.

Kärkkäinen and Sanders, "Simple Linear Work Suffix Array Construction" (2003). Suffixes at
positions not divisible by three are the sample: their triples are sorted and named, the string of
names is sorted by recursion where names repeat, the remaining suffixes are sorted by one character
and the rank of the sample suffix after it, and the two are merged.

Only the first ``depth`` characters matter to the callers. A name at recursion level k stands for
3^k characters, so names that still repeat when they stand for ``depth`` characters are left equal.
"""

from __future__ import annotations

import numpy as np

#: Characters or names must be below this: three of them are one sort key.
LIMIT = 1 << 21


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The positions of ``text`` (numbers from 0) sorted by the ``depth`` characters that begin there, at least."""
    if len(text) >= LIMIT - 2:
        raise ValueError("too long: its names would not fit a sort key")
    return _sort(text.astype(np.int64) + 1, 1, depth)


def _sort(s: np.ndarray, covered: int, depth: int) -> np.ndarray:
    """``s`` has numbers from 1; 0 stands after its end. ``covered`` characters are behind each number."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    padded = np.concatenate((s, np.zeros(3, np.int64)))
    # the first part of the name string must end in a name that no other has, where n % 3 == 1 that of an empty suffix
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((ones, twos))
    triples = padded[sample] << 42 | padded[sample + 1] << 21 | padded[sample + 2]
    distinct, names = np.unique(triples, return_inverse=True)
    if len(distinct) < len(sample) and 3 * covered < depth:
        order = _sort(names + 1, 3 * covered, depth)
    else:
        order = np.argsort(names, kind="stable")
    sample = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    # the rest, and how many of the sample come before each
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(padded[rest] << 22 | rank[rest + 1], kind="stable")]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(padded[first] << 22 | rank[first + 1], padded[rest] << 22 | rank[rest + 1])
    low = padded[rest] << 43 | padded[rest + 1] << 22 | rank[rest + 2]
    before += np.searchsorted(padded[second] << 43 | padded[second + 1] << 22 | rank[second + 2], low)
    # names that were left equal are in any order, so counts may go back among suffixes that are equal
    at = np.arange(len(rest)) + np.maximum.accumulate(before)
    out = np.empty(n, np.int64)
    out[at] = rest
    left = np.ones(n, bool)
    left[at] = False
    out[left] = sample
    return out


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int, piece: int = 1 << 16) -> np.ndarray:
    """Per start the number of its class: starts with the same ``length`` characters have the same.

    Starts are taken in suffix order, and each is compared with the one before it.
    """
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_order(text, length)
    order = order[wanted[order]]
    differs = np.zeros(len(order), bool)
    span = np.arange(length)
    for k in range(1, len(order), piece):
        own = text[order[k - 1 : k + piece][:, None] + span]
        differs[k : k + piece] = (own[1:] != own[:-1]).any(axis=1)
    number = np.empty(len(text), np.int64)
    number[order] = np.cumsum(differs)
    return number[starts]
