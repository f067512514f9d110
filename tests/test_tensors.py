"""Block layouts by hand and against plain loops; tensor files as a data source."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.sources import formats as X
from atomweave.sources.quantised import KINDS, block_of, dequantise, dequantise_blobs, quantise
from atomweave.sources.tensors import TensorReader, register

half = np.float16
RNG = np.random.default_rng(12)


def plain(raw, kind):
    """Value by value."""
    out, (values, size) = [], block_of(kind)
    for at in range(0, len(raw) - size + 1, size):
        b = raw[at : at + size]
        if kind == "Q8_0":
            d = struct.unpack("<f", b[:4])[0]
            out += [x * d for x in struct.unpack("<32b", b[4:])]
            continue
        d, m, at_body = struct.unpack("<e", b[:2])[0], 0.0, 2
        if kind in ("Q4_1", "Q5_1", "Q4_K"):
            m, at_body = struct.unpack("<e", b[2:4])[0], 4
        high = 0
        if kind.startswith("Q5"):
            high = int.from_bytes(b[at_body : at_body + values // 8], "little")
            at_body += values // 8
        body = int.from_bytes(b[at_body:], "little")
        for i in range(values):
            q = (body >> 6 * i) & 63 if kind == "Q6_K" else ((body >> 4 * i) & 15) | ((high >> i) & 1) << 4
            less = 0 if m or kind in ("Q4_1", "Q5_1", "Q4_K") else {"Q4": 8, "Q5": 16, "Q6": 32}[kind[:2]]
            out.append((q - less) * d + m)
    return out


@pytest.mark.parametrize(("kind", "size"), [("Q8_0", 36), ("Q4_0", 18), ("Q4_1", 20), ("Q5_0", 22), ("Q5_1", 24), ("Q4_K", 68), ("Q5_K", 82), ("Q6_K", 98)])
def test_kinds_equal_plain_loops(kind, size):
    assert block_of(kind)[1] == size
    raw = b""
    for _ in range(5):
        head = struct.pack("<f", 0.37) if kind == "Q8_0" else struct.pack("<e", 0.013) + (struct.pack("<e", -0.4) if KINDS[kind].least else b"")
        raw += head + RNG.integers(0, 256, size - len(head), np.uint8).tobytes()
    np.testing.assert_allclose(dequantise(raw, kind), plain(raw, kind), rtol=1e-5, atol=1e-6)
    np.testing.assert_array_equal(dequantise(raw + raw[: size - 1], kind), dequantise(raw, kind))  # the incomplete block has none
    assert len(dequantise(b"", kind)) == 0
    x = RNG.standard_normal(4 * KINDS[kind].values)
    step = np.full(4, 2.0 ** (4 - KINDS[kind].bits))
    back = dequantise(quantise(x, kind, step, np.full(4, -3.0) if KINDS[kind].least else None), kind)
    inside = (np.abs(x) < 3) if KINDS[kind].least else np.abs(x) < 6
    assert np.abs(back - x)[inside].max() <= step[0] / 2 + 1e-6


def test_by_hand():
    assert dequantise(half(2).tobytes() + bytes([0x98] * 16), "Q4_0")[:2].tolist() == [0.0, 2.0]
    assert dequantise(half(1).tobytes() + half(3).tobytes() + bytes([0x10] * 16), "Q4_1")[:2].tolist() == [3.0, 4.0]
    assert dequantise(half(1).tobytes() + (0b10).to_bytes(4, "little") + bytes([0x10] * 16), "Q5_0")[:3].tolist() == [-16.0, 1.0, -16.0]
    assert dequantise(struct.pack("<f", 0.5) + np.arange(-16, 16, dtype=np.int8).tobytes(), "Q8_0")[:2].tolist() == [-8.0, -7.5]
    assert dequantise(half(1).tobytes() + bytes([63, 0, 0] * 32), "Q6_K")[:2].tolist() == [31.0, -32.0]
    assert dequantise(np.array([1.5, -2], np.float32).view(np.uint16)[1::2].tobytes(), "BF16").tolist() == [1.5, -2.0]
    with pytest.raises(ValueError, match="Q9"):
        dequantise(b"", "Q9")


def test_blobs(spark):
    rows = [(i, bytearray(half(i).tobytes() + bytes([0x98] * 16) * 1) * (i % 3)) for i in range(20)] + [(99, None)]
    got = dict(dequantise_blobs(spark.createDataFrame(rows, "id int, data binary"), "Q4_0").collect())
    assert got.pop(99) is None
    assert got == {i: plain(bytes(d), "Q4_0") for i, d in rows if d is not None}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("tensors")
    big = RNG.standard_normal(100_000).astype(np.float32)
    (d / "a.gguf").write_bytes(X.write_gguf({"general.name": "a", "n": 3}, {"big": big, "two": np.arange(6, dtype=np.float32).reshape(2, 3), "none": np.zeros(0, np.float32), "q": ("Q4_0", 64, quantise(np.arange(64) / 64, "Q4_0", np.full(2, 0.125)))}))
    head = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "h": {"dtype": "BF16", "shape": [], "data_offsets": [8, 10]}, "odd": {"dtype": "F8", "shape": [1], "data_offsets": [8, 9]}, "far": {"dtype": "F32", "shape": [9], "data_offsets": [8, 44]}, "__metadata__": {"x": "y"}}).encode()
    (d / "b.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + struct.pack("<2f", 1, 2) + b"\x80\x3f")
    (d / "c.gguf").write_bytes(b"GGUF" + struct.pack("<IQQ", 3, 1 << 60, 0))
    (d / "d.gguf").write_bytes(X.write_gguf({"k": "v"}, {"x": big})[:40])
    (d / "e.bin").write_bytes(b"")
    (d / "f.json").write_text("{}")
    (d / "_skipped").write_text("x")
    return str(d), big


def test_files_are_read_by_ranges(spark, folder):
    path, big = folder
    register(spark)
    df = spark.read.format("tensors").option("partition_bytes", 50_000).option("chunk", 5000).load(path)
    rows = df.collect()
    got = {}
    for r in sorted((r for r in rows if r["error"] is None), key=lambda r: (r["path"], r["tensor"], r["start"])):
        assert r["start"] == len(got.setdefault((r["path"][-4:], r["tensor"]), [])) and len(r["values"]) <= 5024
        got[r["path"][-4:], r["tensor"]] += r["values"]
    np.testing.assert_array_equal(np.array(got.pop(("gguf", "big")), np.float32), big)
    assert got.pop(("gguf", "q")) == [min(np.floor(i / 64 / 0.125 + 0.5), 7) * 0.125 for i in range(64)]
    assert got == {("gguf", "two"): [0, 1, 2, 3, 4, 5], ("gguf", "none"): [], ("sors", "w"): [1, 2], ("sors", "h"): [1]}
    assert {r["tensor"]: r["shape"] for r in rows if r["tensor"] in ("two", "h")} == {"two": [2, 3], "h": []}
    errors = {(r["path"].rsplit("/")[-1], r["tensor"]) for r in rows if r["error"]}
    assert errors == {("b.safetensors", "odd"), ("b.safetensors", "far"), ("c.gguf", None), ("d.gguf", None), ("e.bin", None), ("f.json", None)}
    assert df.rdd.getNumPartitions() >= 8  # of which no range has more than its bytes


def test_headers_alone_and_pushed_names(spark, folder):
    path, _ = folder
    register(spark)
    catalogue = spark.read.format("tensors").option("values", "false").load(path)
    assert {r["tensor"] for r in catalogue.where("error IS NULL").collect()} == {"big", "two", "none", "q", "w", "h"}
    assert catalogue.where("values IS NOT NULL").count() == 0
    one = spark.read.format("tensors").option("partition_bytes", 1000).load(path).where(F.col("tensor") == "two")
    assert one.rdd.getNumPartitions() <= 6 < spark.read.format("tensors").option("partition_bytes", 1000).load(path).rdd.getNumPartitions()
    assert [r["values"] for r in one.collect()] == [[0, 1, 2, 3, 4, 5]]
    both = spark.read.format("tensors").load(path).where(F.col("tensor").isin("w", "h"))
    assert sorted(r["tensor"] for r in both.collect()) == ["h", "w"]
    with pytest.raises(ValueError, match="no /nowhere"):
        TensorReader({"path": "/nowhere"}).partitions()


def test_ranges_are_bounded(folder):
    reader = TensorReader({"path": folder[0], "partition_bytes": "40000"})
    runs = reader.partitions()
    assert sum(n for r in runs for t, *_, n, _ in r.ranges if t == "big") == 100_000
    for r in runs:
        assert sum(-(-n // block_of(k)[0]) * block_of(k)[1] for _, k, _, _, n, _ in r.ranges) <= 40_000


def test_small_tensors_of_a_kind_are_one_batch(tmp_path, monkeypatch):
    from atomweave.sources import tensors as T

    r = np.random.default_rng(2)
    made = {f"t{i}": r.integers(0, 9, 40 + i % 3).astype(np.float32) for i in range(50)}
    packed = {k: ("Q8_0", len(v), quantise(np.resize(v, 64), "Q8_0", np.ones(2))) for k, v in made.items()}
    (tmp_path / "m.gguf").write_bytes(X.write_gguf({}, made | {f"q{k}": x for k, x in packed.items()}))
    for values, batches in ((1 << 20, 2), (100, 50)):
        monkeypatch.setattr(T, "BATCH_VALUES", values)
        reader = T.TensorReader({"path": str(tmp_path / "m.gguf")})
        got = [b for part in reader.partitions() for b in reader.read(part)]
        assert len(got) == batches
        rows = {x["tensor"]: x["values"] for b in got for x in b.to_pylist()}
        assert rows == {k: v.tolist() for k, v in made.items()} | {f"q{k}": v.tolist() for k, v in made.items()}
