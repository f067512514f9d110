"""Tensor files as a data source: ``spark.read.format("tensors").load(path)``.

A row is a run of a tensor's values: path, tensor, kind, shape, start, values (32-bit floats), error. Only headers are read to plan; a
partition is a byte range of one or several tensors of a file, at most ``partition_bytes`` but for a block, and a task
seeks to it. Filters on ``tensor`` and ``path`` (equality, IN) are pushed down where
spark.sql.python.filterPushdown.enabled is set: other tensors' bytes are never planned. With ``values`` = false there is one row a tensor, without values.

A file that can't be parsed, and a tensor of an unknown kind or whose bytes lie beyond the file, give one row with ``error``; nothing is dropped without one.
Known are GGUF files of version 2 and 3 and safetensors files, by their first bytes; other files are no tensor files and give an error, too.
Paths go through pyarrow's filesystems: local, hdfs, s3, gs.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from atomweave.sources.quantised import block_of, dequantise

SCHEMA = "path string, tensor string, kind string, shape array<long>, start long, values array<float>, error string"
_TYPES = pa.schema([("path", pa.string()), ("tensor", pa.string()), ("kind", pa.string()), ("shape", pa.list_(pa.int64())), ("start", pa.int64()), ("values", pa.list_(pa.float32())), ("error", pa.string())])
#: Bytes of a header at most: longer ones are taken for broken.
MOST_HEADER = 1 << 30
#: Values of a batch of small tensors; bytes between tensors that are read along.
BATCH_VALUES, GAP = 1 << 20, 1 << 12

# Kinds of tensors by number, sizes of metadata values by type number (8 is text, 9 an array).
GGUF_KINDS = {0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 6: "Q5_0", 7: "Q5_1", 8: "Q8_0", 12: "Q4_K", 13: "Q5_K", 14: "Q6_K", 30: "BF16"}
GGUF_SIZES = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}


@dataclass(frozen=True)
class Tensor:
    name: str
    kind: str
    shape: list[int]
    begin: int

    @property
    def size(self) -> int:
        n = 1
        for d in self.shape:
            n *= d
        return n

    @property
    def bytes(self) -> int | None:
        block = block_of(self.kind)
        return None if block is None else -(-self.size // block[0]) * block[1]


class _Header:
    """Little-endian values from a stream; ValueError where it ends or a size can't be."""

    def __init__(self, f):
        self.f, self.at = f, 0

    def raw(self, n: int) -> bytes:
        if n > MOST_HEADER:
            raise ValueError("a size in the header can't be")
        got = self.f.read(n)
        if len(got) != n:
            raise ValueError("the file ends within its header")
        self.at += n
        return got

    def take(self, fmt: str):
        got = struct.unpack("<" + fmt, self.raw(struct.calcsize("<" + fmt)))
        return got[0] if len(got) == 1 else list(got)

    def text(self) -> str:
        return self.raw(self.take("Q")).decode("utf-8", "replace")

    def value(self, kind: int, depth: int = 0):
        if kind == 8:
            return self.text()
        if kind == 9:
            inner, n = self.take("I"), self.take("Q")
            if depth > 8:
                raise ValueError("arrays are nested too deep")
            if inner in GGUF_SIZES:
                got = self.take(f"{n}{GGUF_SIZES[inner]}") if n else []
                return got if isinstance(got, list) else [got]
            return [self.value(inner, depth + 1) for _ in range(n)]
        if kind not in GGUF_SIZES:
            raise ValueError(f"metadata of type {kind} isn't known")
        return self.take(GGUF_SIZES[kind])


def gguf_header(f) -> tuple[dict, list[Tensor]]:
    """Metadata and tensors from a stream at the file's start; ValueError if it isn't such a file."""
    h = _Header(f)
    if h.raw(4) != b"GGUF":
        raise ValueError("no such file")
    version = h.take("I")
    if version not in (2, 3):
        raise ValueError(f"version {version} isn't known")
    n_tensors, n_values = h.take("QQ")
    metadata, found = {}, []
    for _ in range(n_values):
        name = h.text()
        metadata[name] = h.value(h.take("I"))
    for _ in range(n_tensors):
        name, dims = h.text(), h.take("I")
        if dims > 8:
            raise ValueError("a tensor has too many dimensions")
        shape = [h.take("Q") for _ in range(dims)][::-1]
        kind, offset = h.take("I"), h.take("Q")
        found.append((name, GGUF_KINDS.get(kind, str(kind)), shape, offset))
    step = metadata.get("general.alignment", 32)
    if not isinstance(step, int) or step < 1:
        raise ValueError("the alignment can't be")
    base = -(-h.at // step) * step
    return metadata, [Tensor(name, kind, shape, base + offset) for name, kind, shape, offset in found]


def safetensors_header(f) -> tuple[dict, list[Tensor]]:
    h = _Header(f)
    n = h.take("Q")
    try:
        head = json.loads(h.raw(n))
        found = [Tensor(k, v["dtype"], [*map(int, v["shape"])], 8 + n + int(v["data_offsets"][0])) for k, v in head.items() if k != "__metadata__"]
        return head.get("__metadata__", {}), found
    except (KeyError, TypeError, AttributeError, UnicodeDecodeError, RecursionError) as e:
        raise ValueError(f"the header can't be read: {e!r}") from e


def header(f) -> tuple[dict, list[Tensor]]:
    """By the first bytes."""
    magic = f.read(4)
    f.seek(0)
    return gguf_header(f) if magic == b"GGUF" else safetensors_header(f)


@dataclass
class Run(InputPartition):
    """Byte ranges of one file: (tensor, kind, shape, first value, values, begin); or rows that have an error."""

    path: str
    ranges: list[tuple] = field(default_factory=list)
    errors: list[tuple] = field(default_factory=list)


def _open(path: str):
    if "://" in path or path.startswith("file:"):
        system, inner = pafs.FileSystem.from_uri(path)
    else:
        system, inner = pafs.LocalFileSystem(), path
    return system, inner


class TensorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("a path is needed")
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.chunk = int(options.get("chunk", 1 << 16))
        self.with_values = options.get("values", "true").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("tensor", "path"):
                values = {f.value} if isinstance(f, EqualTo) else {*f.value}
                self.wanted[column] = self.wanted.get(column, values) & values
            yield f  # Spark tests them again: a file's error rows have no tensor

    def _plan_file(self, name: str, size: int, system) -> list[Run]:
        try:
            with system.open_input_file(name) as raw:
                _, tensors = header(pa.BufferReader(raw.read_buffer(min(size, 1 << 20))) if size <= 1 << 20 else raw)
        except (OSError, ValueError, struct.error, MemoryError) as e:
            return [Run(name, errors=[(None, None, None, str(e) or type(e).__name__)])]
        runs, now, held = [], Run(name), 0
        for t in tensors:
            if "tensor" in self.wanted and t.name not in self.wanted["tensor"]:
                continue
            total = t.bytes
            if total is None or t.begin + total > size:
                now.errors.append((t.name, t.kind, t.shape, f"kind {t.kind} isn't known" if total is None else "its bytes lie beyond the file's end"))
                continue
            if not self.with_values:
                now.ranges.append((t.name, t.kind, t.shape, 0, 0, t.begin))
                continue
            values, block = block_of(t.kind)
            step = max(1, self.partition_bytes // block) * values
            for first in range(0, max(t.size, 1), step):
                n = min(step, t.size - first)
                if held and held + n // values * block > self.partition_bytes:
                    runs.append(now)
                    now, held = Run(name), 0
                now.ranges.append((t.name, t.kind, t.shape, first, n, t.begin + first // values * block))
                held += -(-n // values) * block
        return [*runs, now]

    def partitions(self) -> list[Run]:
        system, inner = _open(self.path)
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise ValueError(f"there is no {self.path}")
        files = [info] if info.type == pafs.FileType.File else [x for x in system.get_file_info(pafs.FileSelector(inner, recursive=True)) if x.type == pafs.FileType.File and not x.base_name.startswith(("_", "."))]
        if "path" in self.wanted:
            files = [x for x in files if x.path in self.wanted["path"]]
        with ThreadPoolExecutor(16) as pool:
            return [r for runs in pool.map(lambda x: self._plan_file(x.path, x.size, system), sorted(files, key=lambda x: x.path)) for r in runs if r.ranges or r.errors]

    def read(self, part: Run) -> Iterator[pa.RecordBatch]:
        for tensor, kind, shape, error in part.errors:
            yield self._rows([(part.path, tensor, kind, shape, None, None, error)])
        if not self.with_values:
            if part.ranges:
                yield self._rows([(part.path, tensor, kind, shape, None, None, None) for tensor, kind, shape, *_ in part.ranges])
            return
        system, _ = _open(self.path)
        with system.open_input_file(part.path) as f:
            for some in self._small(part.ranges):
                yield self._together(part.path, some, f)
            for tensor, kind, shape, first, n, begin in part.ranges:
                if n <= self.chunk:
                    continue
                values, block = block_of(kind)
                step = max(1, self.chunk // values) * values
                for at in range(0, max(n, 1), step):
                    k = min(step, n - at)
                    raw = f.read_at(-(-k // values) * block, begin + at // values * block)
                    yield self._rows([(part.path, tensor, kind, shape, first + at, dequantise(raw, kind)[:k], None)])

    def _small(self, ranges: list[tuple]) -> Iterator[list[tuple]]:
        """Ranges of one chunk at most, as many of a kind as are one batch; a row each costs more than its values."""
        by_kind: dict[str, list[tuple]] = {}
        for r in ranges:
            if r[4] <= self.chunk:
                by_kind.setdefault(r[1], []).append(r)
        for some in by_kind.values():
            i = held = 0
            for j, r in enumerate(some):
                if j > i and held + r[4] > BATCH_VALUES:
                    yield some[i:j]
                    i, held = j, 0
                held += r[4]
            yield some[i:]

    def _together(self, path: str, some: list[tuple], f) -> pa.RecordBatch:
        """A row for each range; ranges whose bytes follow closely on each other are read at once."""
        kind = some[0][1]
        values, block = block_of(kind)
        whole = np.array([-(-n // values) for *_, n, _ in some], np.int64)
        begin = np.array([r[5] for r in some], np.int64)
        end = begin + whole * block
        order = np.argsort(begin, kind="stable")
        raw: list = [None] * len(some)
        i = 0
        while i < len(order):
            j, top = i + 1, end[order[i]]
            while j < len(order) and begin[order[j]] - top <= GAP and max(top, end[order[j]]) - begin[order[i]] <= self.partition_bytes:
                top, j = max(top, end[order[j]]), j + 1
            start = int(begin[order[i]])
            got = memoryview(f.read_at(int(top) - start, start))
            for k in order[i:j]:
                raw[k] = got[begin[k] - start : end[k] - start]
            i = j
        x = dequantise(b"".join(raw), kind)
        size = np.array([r[4] for r in some], np.int64)
        if (whole * values != size).any():  # the last block isn't full
            at = np.repeat(np.cumsum(whole * values) - whole * values - (np.cumsum(size) - size), size)
            x = x[np.arange(len(at)) + at]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(x, pa.float32()))
        m = len(some)
        columns = [pa.array([path] * m, pa.string()), pa.array([r[0] for r in some], pa.string()), pa.array([kind] * m, pa.string()), pa.array([r[2] for r in some], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[3] for r in some], pa.int64()), lists, pa.nulls(m, pa.string())], schema=_TYPES)

    @staticmethod
    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.types)], schema=_TYPES)


class TensorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``tensors`` known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorFiles)
