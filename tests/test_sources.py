import gzip
import io
import wave
import zipfile

import numpy as np

from atomweave.sources import formats as X


def test_sniffing_and_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "d")
    with zipfile.ZipFile(tmp_path / "a.bin", "w") as z:
        z.writestr("x.txt", "hello")
        z.writestr("in.zip", inner.getvalue())
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"text"))
    (tmp_path / "c.json").write_text("{}")
    (tmp_path / "d").write_bytes(b"PK\x03\x04broken")
    files = X.read_files(spark, str(tmp_path))
    kinds = {r["path"][-5:]: r["content_type"] for r in files.select("path", "content_type").collect()}
    assert kinds["a.bin"] == "application/zip" and kinds["/b.gz"] == "application/gzip" and kinds[".json"] == "application/json"
    got = {(r["path"][-4:], r["entry"]): bytes(r["content"]) for r in X.read_archives(files).collect()}
    assert got == {(".bin", "x.txt"): b"hello", (".bin", "in.zip/deep.txt"): b"d", ("b.gz", "content"): b"text"}


def test_wave_frames(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(1000)
        w.writeframes(np.full(60, 16384, "<i2").tobytes())
    frames = X.wave_frames(X.read_files(spark, str(tmp_path))).collect()
    assert len(frames) == 3 and all(abs(r["rms"] - 0.5) < 1e-9 and r["peak"] == 0.5 for r in frames)


def test_a_text_is_hashed_before_its_words_are_rows(spark):
    from atomweave.plans import registry

    plan = registry.QUERIES["text_compositions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("sha2(cast(text") and plan.count("sha2(cast(text") == 1
