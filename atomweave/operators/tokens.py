"""Words of texts by columns: maximal runs of ``[a-z0-9]`` of the lower-cased text, told apart over the bytes of a whole batch.

Spark lower-cases, as it does in SQL; every byte outside the runs ends one, bytes of longer code points too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

KEPT = np.zeros(256, bool)
KEPT[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
#: Bytes of text taken at once; a longer text is taken alone.
SLICE = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.StringArray, np.ndarray, np.ndarray]]:
    """Of some rows at a time: the rows, their distinct words, each word's place among these, and where each row's words begin (and the last row's end). Null texts have none."""
    for batch in batches:
        column = batch.column(text).fill_null("")
        ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) if len(column) else np.zeros(1, np.int64)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
            yield (batch.slice(i, j - i), *words(column.slice(i, j - i)))
            i = j


def words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words, each word's place among these, where each text's begin; no nulls."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kept = KEPT[data]
    fresh = kept.copy()
    fresh[1:] &= ~kept[:-1]
    edges = ends[:-1][ends[:-1] < len(kept)]
    fresh[edges] = kept[edges]  # a text's first byte goes on with no other text's word
    begin = np.flatnonzero(fresh)
    upto = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
    offsets = np.append(upto[begin], upto[-1]).astype(np.int32)
    every = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[kept]))
    coded = every.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(begin, ends)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key (stable), where each distinct key begins in it, and how often it occurs."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(s)))
