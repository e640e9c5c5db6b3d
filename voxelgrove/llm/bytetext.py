"""Words and their 64-bit hashes from UTF-8 bytes, a slice of documents at a time, without a Python loop over words."""

from __future__ import annotations

import numpy as np

#: Odd base of the polynomial hash; arithmetic is modulo 2**64, where an odd number has an inverse.
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 20
MASK = (1 << 64) - 1

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
LOWER = _lower
#: Each byte's value in the hash, A-Z as a-z.
VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]

_every = np.arange(256)
#: Bytes of words between ASCII white space: [^\x20\x09-\x0D]
SPACED = ~((_every == 0x20) | ((_every >= 9) & (_every <= 13)))
#: Bytes of words of ASCII letters, digits and all that is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z is lower-cased.
ALNUM = ((_every >= 48) & (_every <= 57)) | ((_every >= 65) & (_every <= 90)) | ((_every >= 97) & (_every <= 122)) | (_every >= 128)

_powers: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, for a block."""
    if not _powers:
        up, down = np.full(BLOCK + 1, BASE, np.uint64), np.full(BLOCK + 1, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """A hash of data[start:end] for each span; spans ascend and don't overlap. Works a block at a time, also within a span, so a long text or word needs no more memory."""
    out = np.empty(len(starts), np.uint64)
    up, down = _tables()
    i = 0
    while i < len(starts):
        first = int(starts[i])
        j = int(np.searchsorted(ends, first + BLOCK, side="right"))
        if j <= i:
            out[i] = mix(np.array([_long_sum(data, first, int(ends[i]), values, up) + (int(ends[i]) - first) & MASK], np.uint64))[0]
            i += 1
            continue
        last = int(ends[j - 1])
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(values[data[first:last]] * up[: last - first], out=sums[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def _long_sum(data: np.ndarray, start: int, end: int, values: np.ndarray, up: np.ndarray) -> int:
    """The polynomial of one span, summed over blocks, each times the power at which it begins."""
    total = 0
    for a in range(start, end, BLOCK):
        part = values[data[a : min(end, a + BLOCK)]]
        total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(BASE, a - start, 1 << 64)
    return total & MASK


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``kind`` bytes, none across the documents' offsets ``at``; and how many words lie before each document, with the total last."""
    edges = at[(at > 0) & (at < len(data))]
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(data), BLOCK):
        b = min(len(data), a + BLOCK)
        inside = kind[data[a:b]]
        before, after = np.empty(b - a, bool), np.empty(b - a, bool)
        before[0], before[1:] = a > 0 and kind[data[a - 1]], inside[:-1]
        after[-1], after[:-1] = b < len(data) and kind[data[b]], inside[1:]
        before[edges[(edges >= a) & (edges < b)] - a] = False
        after[edges[(edges > a) & (edges <= b)] - 1 - a] = False
        starts.append(np.flatnonzero(inside & ~before) + a)
        ends.append(np.flatnonzero(inside & ~after) + 1 + a)
    first, last = np.concatenate(starts), np.concatenate(ends)
    return first, last, np.searchsorted(first, at)


def pieces(data: np.ndarray, kind: np.ndarray, size: int = 8 * BLOCK) -> list[tuple[int, int]]:
    """Cuts one long text where no run of ``kind`` bytes goes on, into pieces of about ``size`` bytes; a longer run is a piece of its own."""
    out, at = [], 0
    while at < len(data):
        end = at + size
        while end < len(data):
            outside = np.flatnonzero(~kind[data[end : end + BLOCK]])
            if len(outside):
                end += int(outside[0])
                break
            end += BLOCK
        end = min(end, len(data))
        out.append((at, end))
        at = end
    return out


def counts_of(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How many bytes of each document are of a kind."""
    out = np.zeros(len(at) - 1, np.int64)
    for a in range(0, len(data), BLOCK):
        b = min(len(data), a + BLOCK)
        sums = np.zeros(b - a + 1, np.int64)
        np.cumsum(kind[data[a:b]], out=sums[1:])
        out += np.diff(sums[np.clip(at, a, b) - a])
    return out


def hashed_words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and how many lie before each document."""
    starts, ends, before = words(data, at, kind)
    return span_hashes(data, starts, ends), before
