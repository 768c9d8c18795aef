"""Vectorised word splitting and hashing over the UTF-8 bytes of whole Arrow batches.

A word is a maximal run of ``[0-9a-z]`` (A-Z lower-cased) and of non-ASCII characters. Every word gets a
64-bit polynomial hash over a fixed random byte table, so equal words have equal hashes in every task.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.RandomState(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_TABLE = _RNG.randint(1, 2**63 - 1, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_TABLE[~_WORD] = 0
_BLOCK = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _CACHE["n"] < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up, down = np.full(n, _BASE), np.full(n, inverse)
            up[0] = down[0] = 1
            _CACHE.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _CACHE["up"], _CACHE["down"]


_CACHE: dict = {"n": 0}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of every word; starts and ends are byte positions in ``raw``.

    Long inputs are walked in blocks cut at non-word bytes, so memory follows the block and not the text.
    """
    hs, ss, es = [], [], []
    pos, n = 0, len(raw)
    breaks = np.zeros(n + 1, bool)
    breaks[offsets] = True  # a word never crosses rows
    while pos < n:
        stop = min(n, pos + _BLOCK)
        while stop < n and _WORD[raw[stop]] and not breaks[stop]:
            tail = np.flatnonzero(~_WORD[raw[stop : stop + 4096]] | breaks[stop : stop + min(4096, n - stop)])
            stop = stop + int(tail[0]) if len(tail) else min(n, stop + 4096)
            if len(tail):
                break
        block = raw[pos:stop]
        cls = _TABLE[block]
        isw = cls != 0
        brk = breaks[pos:stop]
        before = np.empty_like(isw)
        before[0] = False
        before[1:] = isw[:-1]
        starts = np.flatnonzero(isw & (~before | brk))
        after = np.empty_like(isw)
        after[-1] = False
        after[:-1] = isw[1:] & ~brk[1:]
        ends = np.flatnonzero(isw & ~after) + 1
        up, down = _powers(max(_BLOCK, len(block)) + 1)
        sums = np.empty(len(block) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(cls * up[: len(block)], out=sums[1:])
        hs.append(mix((sums[ends] - sums[starts]) * down[starts]))
        ss.append(starts + pos)
        es.append(ends + pos)
        pos = stop
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    h, s, e = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
    return h, s, e, np.searchsorted(offsets, s, side="right") - 1


def grams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the k words from each position; valid where all k are of one row."""
    n = len(h)
    out, valid = np.zeros(n, np.uint64), np.zeros(n, bool)
    m = n - k + 1
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for i in range(k):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m]
        out[:m] = mix(acc)
        valid[:m] = row[:m] == row[k - 1 :]
    return out, valid


def row_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """First index of each row in the sorted ``row``, and the length at the end."""
    return np.searchsorted(row, np.arange(n_rows + 1))
