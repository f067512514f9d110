"""Block-quantised tensors, unpacked over whole Arrow buffers at once.

A block is: a scale, for some kinds a least value, for some a plane of high bits (bit i is of value i), then the low bits of its
values. Four- and five-bit values lie two to a byte, the low nibble first; six-bit values four to three bytes from the lowest bit up; eight-bit values
are signed bytes. Values without a least value are signed: half of their range is taken off. Arithmetic is in 32-bit floats. Bytes
after the last whole block are ignored, as an incomplete block has no values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Kind:
    """values of a block; type of its scale; whether a least value follows; bits of a value."""

    values: int
    scale: str
    least: bool
    bits: int

    @property
    def plane(self) -> int:
        return self.values // 8 if self.bits == 5 else 0

    @property
    def head(self) -> int:
        return np.dtype(self.scale).itemsize * (2 if self.least else 1)

    @property
    def block(self) -> int:
        """Bytes of a block."""
        return self.head + self.plane + self.values * (4 if self.bits == 5 else self.bits) // 8


# The layouts by name.
KINDS = {
    "Q8_0": Kind(32, "<f4", False, 8),
    "Q4_0": Kind(32, "<f2", False, 4),
    "Q4_1": Kind(32, "<f2", True, 4),
    "Q5_0": Kind(32, "<f2", False, 5),
    "Q5_1": Kind(32, "<f2", True, 5),
    "Q4_K": Kind(128, "<f2", True, 4),
    "Q5_K": Kind(128, "<f2", False, 5),
    "Q6_K": Kind(128, "<f2", False, 6),
}
# Plain types by name.
PLAIN = {"F32": "<f4", "F16": "<f2", "F64": "<f8", "I8": "i1", "I16": "<i2", "I32": "<i4", "I64": "<i8", "U8": "u1", "BOOL": "?"}


def block_of(kind: str) -> tuple[int, int] | None:
    """(values, bytes) of the least part of a tensor that can be read alone; None for a kind that isn't known."""
    if kind in KINDS:
        return KINDS[kind].values, KINDS[kind].block
    if kind == "BF16":
        return 1, 2
    return (1, np.dtype(PLAIN[kind]).itemsize) if kind in PLAIN else None


def dequantise(raw, kind: str) -> np.ndarray:
    """32-bit floats of a little-endian buffer. ValueError for a kind that isn't known."""
    if block_of(kind) is None:
        raise ValueError(f"tensors of kind {kind} aren't known")
    size = block_of(kind)[1]
    x = np.frombuffer(raw, np.uint8)
    x = x[: len(x) // size * size]
    if kind == "BF16":
        return (x.view("<u2").astype(np.uint32) << 16).view(np.float32)
    if kind in PLAIN:
        return x.view(PLAIN[kind]).astype(np.float32)
    k = KINDS[kind]
    if not len(x):
        return np.zeros(0, np.float32)
    b = x.reshape(-1, k.block)
    head = np.ascontiguousarray(b[:, : k.head]).view(k.scale).astype(np.float32)
    body = b[:, k.head + k.plane :]
    if k.bits == 8:
        q = body.view(np.int8).astype(np.float32)
    elif k.bits == 6:
        three = body.reshape(len(b), -1, 3).astype(np.uint32)
        word = three[:, :, 0] | three[:, :, 1] << 8 | three[:, :, 2] << 16
        q = (word[:, :, None] >> np.arange(0, 24, 6, dtype=np.uint32) & 63).reshape(len(b), -1).astype(np.float32)
    else:
        low = np.stack([body & 15, body >> 4], 2).reshape(len(b), -1)
        if k.plane:
            low = low | np.unpackbits(b[:, k.head : k.head + k.plane], axis=1, bitorder="little") << 4
        q = low.astype(np.float32)
    if k.least:
        return (q * head[:, :1] + head[:, 1:]).ravel()
    return ((q - np.float32(0 if k.bits == 8 else 1 << (k.bits - 1))) * head[:, :1]).ravel()


def quantise(values: np.ndarray, kind: str, scale: np.ndarray, least: np.ndarray | None = None) -> bytes:
    """Blocks of ``values`` (a multiple of a block's) with a scale, and where the kind has one a least value, for each block; the nearest step, halves up."""
    k = KINDS[kind]
    v = np.asarray(values, np.float64).reshape(-1, k.values)
    head = np.stack([scale, least] if k.least else [scale], 1).astype(k.scale)
    steps = head.astype(np.float64)
    half = 1 << (k.bits - 1)
    low, high = (0, 2 * half - 1) if k.least else (-half, half - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.where(steps[:, :1] == 0, 0, np.floor((v - (steps[:, 1:] if k.least else 0)) / steps[:, :1] + 0.5))
    q = np.clip(q, low, high).astype(np.int64) + (0 if k.least or k.bits == 8 else half)
    out = [head.view(np.uint8).reshape(len(v), -1)]
    if k.plane:
        out.append(np.packbits((q >> 4 & 1).astype(np.uint8), axis=1, bitorder="little"))
    if k.bits == 8:
        out.append(q.astype(np.int8).view(np.uint8))
    elif k.bits == 6:
        four = q.reshape(len(v), -1, 4)
        word = (four << np.arange(0, 24, 6)).sum(2)
        out.append((word[:, :, None] >> np.arange(0, 24, 8) & 255).reshape(len(v), -1).astype(np.uint8))
    else:
        two = (q & 15).reshape(len(v), -1, 2)
        out.append((two[:, :, 0] | two[:, :, 1] << 4).astype(np.uint8))
    return np.concatenate(out, 1).tobytes()


def dequantise_blobs(blobs: DataFrame, kind: str) -> DataFrame:
    """(id, values) of blobs (id, data); a null blob has null values. A batch's blobs are one buffer and unpacked together."""
    size = block_of(kind)
    if size is None:
        raise ValueError(f"tensors of kind {kind} aren't known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(1)
            whole = [len(x) // size[1] for x in (s.as_buffer() if s.is_valid else b"" for s in data)]
            raw = b"".join(memoryview(s.as_buffer())[: n * size[1]] for s, n in zip(data, whole) if n)
            upto = np.concatenate([[0], np.cumsum(np.array(whole, np.int64) * size[0])]).astype(np.int32)
            mask = pa.array([not s.is_valid for s in data], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(upto), pa.array(dequantise(raw, kind)), mask=mask)], ["id", "values"])

    key = dict(blobs.dtypes)["id"]
    return blobs.selectExpr("id", "data").mapInArrow(run, f"id {key}, values array<float>")
