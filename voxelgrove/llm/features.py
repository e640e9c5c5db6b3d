"""Sparse features of texts for linear and low-rank models: hashed words, and structure statistics in bins."""

from __future__ import annotations

import numpy as np

from .bytetext import ALNUM, BLOCK, counts_of, pieces, span_hashes, words

_b = np.arange(256)
_UPPER = (_b >= 65) & (_b <= 90)
_DIGIT = (_b >= 48) & (_b <= 57)
_SPACE = (_b == 32) | ((_b >= 9) & (_b <= 13))
_WIDE = _b >= 128
_SYMBOL = (_b > 32) & (_b < 127) & ~ALNUM
_LINE = _b != 10

BINS = 32
STATISTICS = ("bytes", "words", "word_length", "distinct_words", "upper", "digits", "symbols", "spaces", "wide", "lines", "distinct_lines")


def _share(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    return x / np.maximum(1, n)


def _log_bins(x: np.ndarray, unit: float = 1.0) -> np.ndarray:
    return np.clip(np.floor(np.log2(x * unit + 1) * 2), 0, BINS - 1).astype(np.int64)


def _even_bins(share: np.ndarray) -> np.ndarray:
    return np.clip((share * (BINS - 2)).astype(np.int64), 0, BINS - 1)


_ROW = np.uint64(44)


def _distinct(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many runs of ``kind`` bytes each document has; and its distinct ones, as the document's number and 44 bits of their hash. A long text goes piece by piece."""
    n = len(at) - 1
    if n == 1 and len(data) > 8 * BLOCK:
        count, found = 0, np.zeros(0, np.uint64)
        for a, b in pieces(data, kind):
            c, f = _plain(data[a:b], np.array([0, b - a]), kind)
            count, found = count + c, np.union1d(found, f)
        return np.asarray(count), found
    return _plain(data, at, kind)


def _plain(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, before = words(data, at, kind)
    count = np.diff(before)
    row = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    return count, np.unique((row << _ROW) | (span_hashes(data, starts, ends) >> np.uint64(20)))


def text_features(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document of a slice: rows and buckets (of 2**bits) of its distinct words, ordered by row and bucket; and the bins of STATISTICS (documents x statistics)."""
    n = len(at) - 1
    count, distinct = _distinct(data, at, ALNUM)
    n_distinct = np.bincount((distinct >> _ROW).astype(np.int64), minlength=n)
    pairs = np.unique(((distinct >> _ROW) << np.uint64(bits)) | ((distinct & np.uint64((1 << 44) - 1)) >> np.uint64(44 - bits)))
    rows, buckets = (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)

    size = np.diff(at)
    kinds = (("upper", _UPPER), ("digits", _DIGIT), ("symbols", _SYMBOL), ("spaces", _SPACE), ("wide", _WIDE), ("word", ALNUM))
    part = {name: counts_of(data, at, kind) for name, kind in kinds}
    n_lines, lines = _distinct(data, at, _LINE)
    n_distinct_lines = np.bincount((lines >> _ROW).astype(np.int64), minlength=n)
    stats = np.stack(
        [
            _log_bins(size), _log_bins(count), np.clip(_share(part["word"], count) * 2, 0, BINS - 1).astype(np.int64), _even_bins(_share(n_distinct, count)),
            *(_log_bins(_share(part[k], size), 1024) for k in ("upper", "digits", "symbols", "spaces", "wide")),
            _log_bins(n_lines), _even_bins(_share(n_distinct_lines, n_lines)),
        ],
        axis=1,
    )
    return rows, buckets, stats


def number_bins(values: np.ndarray) -> np.ndarray:
    """Bins of a number that comes with the document; the last bin is for null."""
    known = np.isfinite(values)
    return np.where(known, np.minimum(_log_bins(np.abs(np.where(known, values, 0))), BINS - 2), BINS - 1)
