"""Word shingles of whole Arrow batches, as 64-bit hashes.

A-Z are lower-cased; a word is a run of bytes other than 0x20 and 0x09-0x0D. A text's set has its distinct five-word
shingles; with fewer words the whole sequence is the one element; without words it is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .common import MIX, buffers, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_PART = 1 << 20
#: Words of more bytes are hashed one by one.
_LONG = 256


def range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes after another go through a bijection with what came before. Ranges of one
    length up to eight bytes never collide."""
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    left = (stop - start).astype(np.int64)
    out = mix(left.astype(np.uint64) * MIX, 61)
    long = np.flatnonzero(left > _LONG)
    for k in long.tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : stop[k]].tobytes())
    at, who = start.astype(np.int64).copy(), np.flatnonzero((left > 0) & (left <= _LONG))
    while len(who):
        n = left[who]
        x = lanes[at[who]]
        short = n < 8
        x[short] &= (np.uint64(1) << (8 * n[short]).astype(np.uint64)) - np.uint64(1)
        out[who] = mix(out[who] ^ x, 62)
        at[who] += 8
        left[who] -= 8
        who = who[left[who] > 0]
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of bytes that are not blank), and the number of the text of each. Works through about a
    megabyte at a time; a longer word is taken whole."""
    hashes, owners, at = [], [], 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    while at < len(data):
        end = min(len(data), at + _PART)
        while end < len(data) and not edge[end] and not blank[data[end]]:
            more = np.flatnonzero(blank[data[end : end + _PART]] | edge[end : min(end + _PART, len(data))])
            end = end + int(more[0]) if len(more) else min(len(data), end + _PART)
        part = _LOWER[data[at:end]]
        seen = ~blank[part]
        joined = seen[1:] & seen[:-1] & ~edge[at + 1 : end]
        start = np.flatnonzero(seen & ~np.concatenate([[False], joined]))
        stop = np.flatnonzero(seen & ~np.concatenate([joined, [False]])) + 1
        hashes.append(range_hashes(part, start, stop))
        owners.append(np.searchsorted(offsets, start + at, "right") - 1)
        at = end
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(elements, offsets): the sorted distinct shingle hashes of every text of the column, one text after the other."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    words, owner = word_hashes(data, offsets)
    count = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    grams = np.zeros(len(words), np.uint64)
    for k in range(width):
        m = max(0, len(words) - k)
        grams[:m] += mix(words[k : k + m], k + 1)
    grams = mix(grams, 99)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(grams[a : b - width + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            with np.errstate(over="ignore"):
                total = np.uint64(b - a)
                for k, w in enumerate(words[a:b]):
                    total = total + mix(np.array([w]), 50 + k)[0]
            sets.append(mix(np.array([total]), 98))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
