"""Simple-8b word-aligned coding of non-negative ids, vectorised with numpy.

Ids are cut into blocks of BLOCK. Each block is a run of 64-bit little-endian words: the top 4 bits are
a selector, the low 60 bits hold that selector's count of ids, the first id lowest. Ids of 2^60 and
more are escaped: the word holds the index of the id in the escape list. `offsets` has the first word of each
block, so any block can be decoded alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096
#: Selector -> ids a word, bits an id; the selector after the last is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = 60 // COUNTS
ESCAPE = len(COUNTS)
_SELECTOR = np.zeros(61, dtype=np.uint64)
_SELECTOR[COUNTS] = np.arange(len(COUNTS))
_PER_WORD = np.array([*COUNTS, 1], dtype=np.int64)
#: How a window of so many ids is made of two smaller ones.
_WINDOWS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4), 10: (8, 2), 12: (8, 4), 15: (8, 7), 20: (12, 8), 30: (15, 15), 60: (30, 30)}
_SHIFTS = np.uint64(60)


_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _bit_length(v: np.ndarray) -> np.ndarray:
    bits = np.zeros(v.shape, dtype=np.uint8)
    top = int(v.max()).bit_length() if v.size else 0
    if top <= 16:
        return _SHORT[v]
    if top <= 52:
        return np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    for b in range(top):
        bits += v >= np.uint64(1 << b)
    return bits


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escaped ids) of a flat array."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    wide = BLOCK + 60  # a block's last word may reach beyond it; the zeros there are not read back
    v = np.zeros((blocks, wide), dtype=np.uint64)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint64)
    padded[:n] = ids
    v[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    high = {1: _bit_length(v)}
    for count, (a, b) in _WINDOWS.items():
        m = high[a].copy()
        np.maximum(m[:, : wide - a], high[b][:, a:], out=m[:, : wide - a])
        high[count] = m
    take = np.ones((blocks, wide), dtype=np.uint8)
    for count, bits in zip(COUNTS[-2::-1], BITS[-2::-1], strict=True):
        np.copyto(take, np.uint8(count), where=high[int(count)] <= bits)
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    starts = np.zeros((blocks, wide), dtype=bool)
    row, at = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    while len(row):
        starts[row, at] = True
        at = at + take[row, at]
        more = at < lengths[row]
        row, at = row[more], at[more]
    flat = np.flatnonzero(starts)
    offsets = np.concatenate([[0], np.cumsum(starts.sum(axis=1))[:-1]]).astype(np.int64)
    v, counts = v.reshape(-1), take.reshape(-1)[flat].astype(np.int64)
    words = np.zeros(len(flat), dtype=np.uint64)
    escapes = np.zeros(0, np.uint64)
    for count, bits in zip(COUNTS, BITS, strict=True):
        of = np.flatnonzero(counts == count)
        if len(of):
            word, first = np.zeros(len(of), dtype=np.uint64), flat[of]
            for j in range(count):
                word |= v[first + j] << np.uint64(j * bits)
            words[of] = word
    words |= _SELECTOR[counts] << _SHIFTS
    out = np.flatnonzero((counts == 1) & (v[flat] >= np.uint64(1 << 60)))
    if len(out):
        escapes = v[flat[out]]
        words[out] = np.arange(len(out), dtype=np.uint64) | np.uint64(ESCAPE) << _SHIFTS
    return words, offsets, escapes


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids that encode() was given."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> _SHIFTS).astype(np.int64)
    counts = _PER_WORD[selector]
    before = np.cumsum(counts) - counts
    block = np.zeros(len(words), dtype=np.int64)
    block[offsets[1:]] = 1
    block = np.cumsum(block)
    local = before - before[offsets][block]
    blocks = len(offsets)
    out = np.zeros((blocks, BLOCK + 60), dtype=np.uint64)
    flat, first = out.reshape(-1), block * (BLOCK + 60) + local
    for s in range(len(COUNTS)):
        of = np.flatnonzero(selector == s)
        if len(of):
            w, at, mask = words[of], first[of], np.uint64((1 << int(BITS[s])) - 1)
            for j in range(int(COUNTS[s])):
                flat[at + j] = (w >> np.uint64(j * int(BITS[s]))) & mask
    of = np.flatnonzero(selector == ESCAPE)
    if len(of):
        flat[first[of]] = escapes[(words[of] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:, :BLOCK].reshape(-1)[:n]
