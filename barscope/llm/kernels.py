"""Array functions over batches of texts, used inside tasks.

Texts stay one byte array with offsets, as Arrow holds them; words, hashes and n-grams come from array
operations over all texts of a batch, so the cost per word is that of a few passes over memory. Word hashes
are differences of running polynomial sums modulo 2^64 over random byte codes, mixed at the end.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240229)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_ROLL = _rng.integers(1, 2**63, 8, dtype=np.int64).astype(U) | U(1)

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[65:91] = IN_WORD[128:] = True
NO_SPACE = np.ones(256, dtype=bool)
NO_SPACE[9:14] = NO_SPACE[32] = False
BLOCK = 1 << 18


def mix(x):
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bytes_of(column):
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("")
    width = np.int64 if str(column.type).startswith("large") else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0]).astype(np.int64) if len(column) else np.zeros(1, np.int64)


def _powers(n, base):
    out = np.full(n, base, dtype=U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(BLOCK, _BASE), _powers(BLOCK, _INVERSE)


def words(data, offsets, signs=IN_WORD):
    """Hash of every word, and the number of words before each text (one entry more than texts); words consist of ``signs``."""
    inside = signs[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.empty(len(starts), dtype=U)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        size = int(ends[to - 1] - low)
        up, down = (_UP, _DOWN) if size <= BLOCK else (_powers(size, _BASE), _powers(size, _INVERSE))
        total = np.zeros(size + 1, dtype=U)
        np.cumsum(_CODE[LOWERED[data[low : low + size]]] * up[:size], out=total[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        hashes[at:to] = (total[e] - total[s]) * down[s]
        at = to
    return mix(hashes), np.searchsorted(starts, offsets)


def shingles(hashes, first, n=5):
    """Hash of every run of n words within a text, and the number before each text; a shorter text is one run."""
    count = np.diff(first)
    runs = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    total = np.concatenate([[0], np.cumsum(runs)])
    starts = np.repeat(first[:-1] - total[:-1], runs) + np.arange(total[-1])
    out = np.zeros(total[-1], dtype=U)
    last = np.repeat(first[1:], runs)
    for k in range(n):
        at = starts + k
        ok = at < last
        out[ok] += hashes[at[ok]] * _ROLL[k]
    return mix(out), total


def counted(values, first):
    """Distinct values of each text with their counts: (value, count, number before each text).

    Values keep 52 bits; up to 4096 texts at a time share one sort.
    """
    keys, counts, sizes = [], [], []
    for low in range(0, len(first) - 1, 4096):
        part = first[low : low + 4097]
        doc = np.repeat(np.arange(len(part) - 1, dtype=U), np.diff(part))
        key = np.sort((doc << U(52)) | (values[part[0] : part[-1]] >> U(12)))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts.append(np.diff(np.concatenate([new, [len(key)]])))
        key = key[new]
        sizes.append(np.bincount((key >> U(52)).astype(np.int64), minlength=len(part) - 1))
        keys.append(key & U(2**52 - 1))
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(keys), np.concatenate(counts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def slices(batch, name="t", size=4 << 20, rows=1024):
    """Parts of a record batch with about ``size`` bytes of text (one text at least) and ``rows`` texts at most."""
    data, offsets = bytes_of(batch.column(name))
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        high = min(high, low + rows)
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high
