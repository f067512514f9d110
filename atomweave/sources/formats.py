"""File formats read with ``binaryFile`` and Arrow functions: sniffing, archives, wave frames, images, model files written.

A file that can't be parsed gives no row of content; its path stays in the sniffing table.
"""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import wave
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.sources.tensors import GGUF_KINDS

#: Magic numbers as hexadecimal prefixes.
MAGIC = (
    ("89504e47", "image/png"),
    ("ffd8ff", "image/jpeg"),
    ("47494638", "image/gif"),
    ("25504446", "application/pdf"),
    ("504b0304", "application/zip"),
    ("1f8b", "application/gzip"),
    ("47475546", "application/x-gguf"),
    ("424d", "image/bmp"),
    ("52494646", "audio/wav"),
)
EXTENSIONS = {"txt": "text/plain", "md": "text/markdown", "json": "application/json", "csv": "text/csv", "py": "text/x-python", "safetensors": "application/x-safetensors", "onnx": "application/x-onnx"}


def sniff(content: Column, path: Column) -> Column:
    """Content type by magic bytes, else by extension, else octet-stream."""
    head = F.lower(F.hex(F.substring(content, 1, 8)))
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("application/octet-stream")
    for ext, kind in EXTENSIONS.items():
        out = F.when(extension == ext, kind).otherwise(out)
    for magic, kind in reversed(MAGIC):
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, content_type)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", "length", "content", sniff(F.col("content"), F.col("path")).alias("content_type"))


def entries(raw: bytes, depth: int = 3, prefix: str = "") -> Iterator[tuple[str, bytes]]:
    """Members of a zip, tar or gzip file, those of archives inside them too."""
    try:
        if raw[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                found = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
        elif raw[:2] == b"\x1f\x8b":
            found = [("content", gzip.decompress(raw))]
        elif raw[257:262] == b"ustar":
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                found = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
        else:
            return
    except (OSError, ValueError, zipfile.BadZipFile, tarfile.TarError, EOFError):
        return
    for name, data in found:
        nested = list(entries(data, depth - 1, f"{prefix}{name}/")) if depth > 1 else []
        yield from nested or [(prefix + name, data)]


def read_archives(files: DataFrame) -> DataFrame:
    """(path, entry, content) of every archive member in ``files`` (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, name, data) for p, raw in zip(f["path"], f["content"]) for name, data in entries(bytes(raw))]
            yield pd.DataFrame(rows, columns=["path", "entry", "content"])

    return files.select("path", "content").mapInPandas(run, "path string, entry string, content binary")


def wave_frames(files: DataFrame, frame_ms: int = 25) -> DataFrame:
    """(path, channel, frame, rms, peak) of 16-bit PCM files; the last partial frame is kept."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, raw in zip(f["path"], f["content"]):
                try:
                    with wave.open(io.BytesIO(bytes(raw))) as w:
                        if w.getsampwidth() != 2:
                            continue
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()) / 32768
                        step = max(1, w.getframerate() * frame_ms // 1000)
                except (wave.Error, EOFError):
                    continue
                for i in range(0, len(x), step):
                    part = x[i : i + step]
                    rows += [(p, c, i // step, float(np.sqrt((part[:, c] ** 2).mean())), float(np.abs(part[:, c]).max())) for c in range(x.shape[1])]
            yield pd.DataFrame(rows, columns=["path", "channel", "frame", "rms", "peak"])

    return files.select("path", "content").mapInPandas(run, "path string, channel int, frame int, rms double, peak double")


def write_gguf(metadata: dict[str, str | int], tensors: dict[str, np.ndarray | tuple[str, int, bytes]]) -> bytes:
    """A little-endian version 3 file: header, metadata, tensor table, data aligned to 32 bytes.

    A tensor is an array, written as F32, or (kind, number of values, bytes).
    """
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()
    number = {name: i for i, name in GGUF_KINDS.items()}
    out = [b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(metadata))]
    for k, v in metadata.items():
        out.append(text(k) + (struct.pack("<I", 8) + text(v) if isinstance(v, str) else struct.pack("<Iq", 11, v)))
    at, data = 0, []
    for name, x in tensors.items():
        kind, shape, raw = (x[0], (x[1],), x[2]) if isinstance(x, tuple) else ("F32", x.shape, x.astype("<f4").tobytes())
        out.append(text(name) + struct.pack("<I", len(shape)) + struct.pack(f"<{len(shape)}Q", *reversed(shape)) + struct.pack("<IQ", number[kind], at))
        data.append(raw + bytes(-len(raw) % 32))
        at += len(data[-1])
    head = b"".join(out)
    return head + bytes(-len(head) % 32) + b"".join(data)


def write_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit file of (height, width, 3) red, green, blue bytes."""
    h, w, _ = pixels.shape
    rows = b"".join(r[:, ::-1].tobytes() + bytes(-3 * w % 4) for r in pixels[::-1].astype(np.uint8))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def parse_bmp(raw: bytes) -> np.ndarray:
    """(height, width, 3) red, green, blue bytes of an uncompressed 24- or 32-bit file; ValueError otherwise."""
    try:
        begin = struct.unpack_from("<I", raw, 10)[0]
        w, h, _, bits, packed = struct.unpack_from("<iiHHI", raw, 18)
        if raw[:2] != b"BM" or bits not in (24, 32) or packed not in (0, 3):
            raise ValueError("no such image")
        line = -(-w * bits // 32) * 4
        x = np.frombuffer(raw, np.uint8, line * abs(h), begin).reshape(abs(h), line)[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    except struct.error as e:
        raise ValueError(f"not readable: {e}") from e
    return (x[::-1] if h > 0 else x)[:, :, 2::-1]


def image_pixels(files: DataFrame) -> DataFrame:
    """(path, x, y, r, g, b) of every pixel of bitmap files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, raw in zip(f["path"], f["content"]):
                try:
                    x = parse_bmp(bytes(raw))
                except ValueError:
                    continue
                h, w, _ = x.shape
                yy, xx = np.divmod(np.arange(h * w), w)
                c = x.reshape(-1, 3).astype(int)
                yield pd.DataFrame({"path": p, "x": xx, "y": yy, "r": c[:, 0], "g": c[:, 1], "b": c[:, 2]})

    return files.select("path", "content").mapInPandas(run, "path string, x int, y int, r int, g int, b int")


def code_members(files: DataFrame) -> DataFrame:
    """(path, kind, name) of imports, members and comments of source texts (path, text), by regular expressions in the JVM."""
    found = [
        ("import", r"(?m)^\s*(?:import|from|using)\s+([A-Za-z_][A-Za-z0-9_.]*)"),
        ("member", r"(?m)^\s*(?:def|class|function|struct)\s+([A-Za-z_][A-Za-z0-9_]*)"),
        ("comment", r"(?m)(?:#|//)\s*(.*)$"),
    ]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(e), 1).alias("names")) for k, e in found])
    return files.select("path", F.explode(kinds).alias("k")).select("path", "k.kind", F.explode("k.names").alias("name"))


def floats_to_binary(column: str) -> Column:
    """Little-endian 32-bit floats of an array."""

    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(column)


def binary_to_floats(column: str) -> Column:
    @F.pandas_udf("array<float>")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else np.frombuffer(bytes(x)[: len(x) // 4 * 4], "<f4").tolist())

    return run(column)
