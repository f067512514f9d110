"""Word-shingle sets as sorted 64-bit hashes, computed for whole Arrow buffers at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)[_LOWER]  # a number per byte, A-Z as a-z
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64)]
#: Bytes of text hashed at once; a longer text is taken alone.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    while len(_POWERS[0]) < n:
        a = _POWERS[0]
        _POWERS[0] = np.concatenate([a, a * np.uint64(pow(_BASE, len(a), 1 << 64))])
    return _POWERS[0]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end, and the text of each word."""
    dark = ~WHITE[data]
    at = offsets[:-1][np.diff(offsets) > 0]
    begin, end = dark.copy(), dark.copy()
    begin[1:] &= ~dark[:-1]
    begin[at] = dark[at]
    end[:-1] &= ~dark[1:]
    end[at[1:] - 1] = dark[at[1:] - 1]
    starts, idx = np.flatnonzero(begin), np.flatnonzero(dark)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lens = np.flatnonzero(end) + 1 - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(len(idx)) - np.repeat(first, lens)
    h = np.add.reduceat(_RANDOM[data[idx]] * _powers(int(lens.max()))[pos], first)
    return mix(h + lens.astype(np.uint64)), np.searchsorted(offsets, starts, "right") - 1


def _slice_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    h, text = _word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    m = len(h) - width + 1
    s = np.zeros(max(m, 0), np.uint64)
    for j in range(width):
        if m > 0:
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m])
    out = []
    for i in range(n):
        a, c = int(first[i]), int(count[i])
        if c >= width:
            x = np.sort(s[a : a + c - width + 1])
            keep = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif c:
            x = np.full(1, c, np.uint64)
            for j in range(c):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[a + j : a + j + 1] + np.uint64(1))
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, width: int = 3) -> Iterator[np.ndarray]:
    """For each text its set of ``width``-word shingles, as sorted distinct hashes.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A text of fewer words has its whole
    sequence as one; without words, or null, the set is empty.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        yield from _slice_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        i = j
