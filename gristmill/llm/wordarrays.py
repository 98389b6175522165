"""Words of a batch of texts as arrays: vectorised splitting and hashing for the Arrow kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step holds, unless one text has more.
STEP = 1 << 20

_RNG = np.random.default_rng(20240607)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Separators of the contracts' words: space and \t to \r.
ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """SplitMix64's finish."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of runs of texts of about STEP bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + STEP, "right")) - 1)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word: a run of bytes that are no separators, within one text."""
    inside = ~separators[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if n else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(64, _BASE)]).astype(np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]).astype(np.uint64))
    return _POWERS


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte runs [start, end), which follow one another without overlap. Runs are taken in steps
    of about STEP bytes, so that a long text needs no more room than its words."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    upto = np.cumsum(size)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + STEP, "right")))
        n, begin = size[at:end], np.cumsum(size[at:end]) - size[at:end]
        step = np.arange(int(n.sum())) - np.repeat(begin, n)
        value = _VALUE[data[np.repeat(starts[at:end], n) + step]] * _powers(int(n.max()) + 1)[step]
        out[at:end] = mixed(np.add.reduceat(value, begin) ^ n.astype(np.uint64) * _BASE)
        at = end
    return out


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by text number, exact for integers."""
    out = np.zeros(n, np.int64)
    np.add.at(out, text, values)
    return out
