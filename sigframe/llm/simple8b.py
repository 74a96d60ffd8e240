"""Simple-8b: a selector in the top four bits of each 64-bit word says how many ids of how many bits follow.

Ids are coded in blocks of ``BLOCK``, each beginning on a word of its own, so blocks are coded and decoded side by side
with array operations. A word with selector 0 is an escape: the next word is one id as it is (ids of over 60 bits).
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
#: Ids in a word and bits of each, by selector.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 0
COUNTS = np.array([c for c, _ in SELECTORS])
_SMALL = np.array([n.bit_length() for n in range(1 << 16)], dtype=np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id takes; one more than needed for some of over 53 bits."""
    if not len(ids) or int(ids.max()) < len(_SMALL):
        return _SMALL[ids.astype(np.int64)]
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def _choice(bits: np.ndarray) -> np.ndarray:
    """For each place the selector that takes the most ids from there. What follows counts across the end of a block too, where zeros are put instead: a smaller count at worst."""
    power, k = {1: bits}, 1
    while k < 64:
        wide = power[k].copy()
        np.maximum(wide[:-k], power[k][k:], out=wide[:-k])
        k *= 2
        power[k] = wide
    best = np.zeros(len(bits), dtype=np.uint8)
    for s in range(15, 0, -1):
        n, b = SELECTORS[s]
        k = 1 << (n.bit_length() - 1)
        fits = power[k] <= b
        if n > k:
            fits[: k - n] &= fits[n - k :]
        best[fits] = s
    return best


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words, and for each block the place of its first word."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    blocks = -(-n // block)
    flat = np.zeros(blocks * block, dtype=np.uint64)
    flat[:n] = ids
    best = _choice(_bits(flat))
    values = np.zeros((blocks, block + 120), dtype=np.uint64)
    values[:, :block] = flat.reshape(blocks, block)
    begin = np.arange(blocks) * block
    end = begin + block
    end[-1] = n
    reach = np.arange(blocks * block) + COUNTS[best]
    at, visited = begin[begin < end], np.zeros(blocks * block, dtype=bool)
    limit = end
    while len(at):
        visited[at] = True
        at = reach[at]
        live = at < limit
        if not live.all():
            at, limit = at[live], limit[live]
    place = np.flatnonzero(visited)
    row, sel = place // block, best[place]
    slots = np.where(sel == ESCAPE, 2, 1)
    first = np.cumsum(slots) - slots
    words = np.zeros(int(slots.sum()), dtype=np.uint64)
    source, values = place + row * 120, values.ravel()
    for s in np.unique(sel):
        i = np.flatnonzero(sel == s)
        count, bits = SELECTORS[s]
        if s == ESCAPE:
            words[first[i] + 1] = values[source[i]]
            continue
        word, from_ = np.full(len(i), np.uint64(s) << np.uint64(60)), source[i]
        for j in range(count if bits else 0):
            word |= values[from_ + j] << np.uint64(bits * j)
        words[first[i]] = word
    opens = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return words, first[opens].astype(np.int32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids that ``encode`` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(sel == ESCAPE):  # in order, as a raw word may look like an escape
        if not raw[i]:
            raw[i + 1] = True
    count = COUNTS[sel]
    count[(sel == ESCAPE) & ~raw] = 0
    count[raw] = 1
    lane = np.zeros(len(words), dtype=np.int64)
    lane[offsets[1:]] = 1
    lane = np.cumsum(lane)
    upto = np.cumsum(count) - count
    start = upto - upto[offsets][lane] + lane * block
    limit = np.minimum((lane + 1) * block, n)
    out = np.zeros(n, dtype=np.uint64)
    out[start[raw]] = words[raw]
    for s in np.unique(sel):
        c, bits = SELECTORS[s]
        if s == ESCAPE or not bits:
            continue
        i = np.flatnonzero((sel == s) & ~raw)
        mask = np.uint64((1 << bits) - 1)
        for j in range(c):
            to = start[i] + j
            ok = to < limit[i]
            out[to[ok]] = (words[i[ok]] >> np.uint64(bits * j)) & mask
    return out
