"""Ingestion queries: JSON payloads, lists, XML messages, atoms by tenant, reading back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from atomweave.operators.work import fresh_path
from atomweave.plans.base import Registry, table
from atomweave.sources import formats as X
from atomweave.sources import ingest as I
from atomweave.sources import quantised as Q
from atomweave.sources.tensors import register

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("json_ingest_atoms", "SELECT event_type AS modality, props AS value, count(*) AS n FROM events GROUP BY 1, 2")
def json_ingest_atoms(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    item = F.struct(F.col("props").alias("atomicValue"), F.col("event_type").alias("modality"))
    payloads = e.groupBy((F.col("event_id") % 50).alias("batch")).agg(F.to_json(F.collect_list(item)).alias("payload"))
    return I.atoms_from_json(payloads).groupBy("modality", F.col("atomicValue").alias("value")).agg(F.count("*").alias("n"))


@R.add("list_source", "SELECT p_partkey, count(*) AS items FROM (SELECT p_partkey, unnest(string_split(p_name || ', x,, y', ',')) AS i FROM part) t WHERE trim(i) <> '' GROUP BY p_partkey")
def list_source(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(I.split_list(F.concat("p_name", F.lit(", x,, y")))).alias("i"))
    return p.groupBy("p_partkey").agg(F.count("*").alias("items"))


@R.add("xml_messages", "SELECT s_suppkey, s_name AS name FROM supplier")
def xml_messages(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("xml", F.concat(F.lit("<m><name>"), "s_name", F.lit("</name></m>")))
    return s.select("s_suppkey", I.from_xml_path("xml", "/m/name").alias("name"))


@R.add("atoms_by_tenant", "SELECT source AS tenant, sha256(text) AS content_hash, count(*) AS reference_count FROM documents GROUP BY 1, 2")
def atoms_by_tenant(spark, sf_dir):
    return I.atoms(table(spark, sf_dir, "documents"), "text", "source").drop("value")


@R.add("atoms_merged", "SELECT source AS tenant, sha256(text) AS content_hash, count(*)::BIGINT AS reference_count FROM documents GROUP BY 1, 2")
def atoms_merged(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old, new = (I.atoms(d.where(F.col("doc_id") % 2 == i), "text", "source") for i in (0, 1))
    return I.merge(old, new).drop("value")


R.sql("text_line_atoms", "SELECT line, count(*) AS n FROM documents LATERAL VIEW explode(split(text, '\\n')) t AS line GROUP BY line HAVING count(*) > 2", "SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) t GROUP BY line HAVING count(*) > 2")
R.sql("character_atoms", "SELECT ch, count(*) AS n FROM documents LATERAL VIEW explode(split(text, '')) t AS ch WHERE ch <> '' GROUP BY ch", "SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) t WHERE ch <> '' GROUP BY ch")


#: Vectors of a model file at most.
FILE_VECTORS = 2048


def _model_files(spark, sf_dir, pack=None):
    """The folder of model files, a tensor a vector: a task writes files of bounded size for each label that it meets.

    ``pack`` makes tensors of vectors by name; else they are written as F32. A task that is run again writes the same names.
    """
    import numpy as np
    import pyarrow as pa
    from pyarrow import fs as pafs
    from pyspark import TaskContext

    folder = fresh_path(spark, "models")

    def write(batches):
        system, inner = pafs.FileSystem.from_uri(folder)
        system.create_dir(inner)
        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            ids, labels = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            vectors = b.column(1).to_pylist()
            for label in np.unique(labels).tolist():
                rows = np.flatnonzero(labels == label)
                for at in range(0, len(rows), FILE_VECTORS):
                    part = {f"v{ids[i]}": np.asarray(vectors[i], np.float32) for i in rows[at : at + FILE_VECTORS]}
                    tensors = part if pack is None else pack(part)
                    with system.open_output_stream(f"{inner}/label{label}-{task}-{n}.gguf") as f:
                        f.write(X.write_gguf({"general.name": f"label{label}", "n": len(part)}, tensors))
                    n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>"), "label")
    e.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    register(spark)
    return folder


@R.add("model_file_catalogue", "SELECT 'label' || label AS path, 'v' || vec_id AS tensor, 'F32' AS kind, len(embedding)::BIGINT AS n FROM embeddings")
def model_file_catalogue(spark, sf_dir):
    """From headers alone."""
    t = spark.read.format("tensors").option("values", "false").load(_model_files(spark, sf_dir))
    return t.select(F.regexp_extract("path", r"(label\d+)-[^/]*$", 1).alias("path"), "tensor", "kind", F.element_at("shape", 1).alias("n"))


@R.add("model_weight_stream", "SELECT 'v' || vec_id AS tensor, i AS position, round(embedding[i + 1]::DOUBLE, 6) AS weight FROM embeddings, range(0, 64) r(i)")
def model_weight_stream(spark, sf_dir):
    chunks = spark.read.format("tensors").option("chunk", 10).load(_model_files(spark, sf_dir))
    return chunks.select("tensor", "start", F.posexplode("values").alias("i", "x")).select("tensor", (F.col("start") + F.col("i")).alias("position"), F.round(F.col("x").cast("double"), 6).alias("weight"))


#: Steps and least values that 16-bit floats hold exactly.
STEPS = {"Q8_0": (2.0**-7, None), "Q4_0": (2.0**-4, None), "Q4_1": (2.0**-3, -1.0), "Q5_0": (2.0**-5, None), "Q5_1": (2.0**-4, -1.0), "Q4_K": (2.0**-3, -1.0), "Q5_K": (2.0**-5, None), "Q6_K": (2.0**-6, None)}


def _pack(vectors):
    """Vectors in each kind, those of one length at once; where a block is longer, a vector is repeated."""
    import numpy as np

    by_length, out = {}, {}
    for name, v in vectors.items():
        by_length.setdefault(len(v), []).append(name)
    for length, names in by_length.items():
        v = np.stack([vectors[i] for i in names])
        for kind, (step, least) in STEPS.items():
            k = Q.KINDS[kind]
            x = np.tile(v, (1, -(-k.values // length))) if k.values > length else v
            n = x.shape[1] // k.values
            blocks = n * len(names)
            raw = Q.quantise(x[:, : n * k.values].ravel(), kind, np.full(blocks, step), None if least is None else np.full(blocks, least))
            for i, name in enumerate(names):
                out[f"{name}.{kind}"] = kind, x.shape[1], raw[i * n * k.block : (i + 1) * n * k.block]
    return out


_STEP_ROWS = ", ".join(f"('{k}', {s}::DOUBLE, {'NULL' if m is None else m}::DOUBLE, {1 << (Q.KINDS[k].bits - 1)}, {max(64, Q.KINDS[k].values)})" for k, (s, m) in STEPS.items())


@R.add(
    "dequantised_weights",
    f"""SELECT 'v' || vec_id AS tensor, kind, i AS position, round(CASE WHEN least IS NULL THEN step * least(greatest(floor(x / step + 0.5), -half), half - 1) ELSE least + step * least(greatest(floor((x - least) / step + 0.5), 0), 2 * half - 1) END, 6) AS weight
    FROM (SELECT vec_id, kind, i, step, least, half, embedding[i % 64 + 1]::DOUBLE AS x FROM embeddings, (VALUES {_STEP_ROWS}) k(kind, step, least, half, n), range(0, 128) r(i) WHERE i < n) t""",
)
def dequantised_weights(spark, sf_dir):
    """Every vector in every block-quantised kind, written to model files and read back."""
    chunks = spark.read.format("tensors").load(_model_files(spark, sf_dir, _pack))
    return chunks.select(F.split_part("tensor", F.lit("."), F.lit(1)).alias("tensor"), "kind", "start", F.posexplode("values").alias("i", "x")).select("tensor", "kind", (F.col("start") + F.col("i")).alias("position"), F.round(F.col("x").cast("double"), 6).alias("weight"))


def _images(spark, sf_dir):
    """A picture of 8 x 8 pixels for each embedding: red by the component, green by the place, blue by the label."""
    import numpy as np
    import pandas as pd

    def paint(frames):
        for f in frames:
            out = []
            for i, v, label in zip(f["vec_id"], f["embedding"], f["label"]):
                red = np.floor((np.asarray(v, np.float64) + 1) * 127)
                out.append((f"p{i}", X.write_bmp(np.stack([red, np.arange(64) * 3, np.full(64, label * 10)], 1).reshape(8, 8, 3))))
            yield pd.DataFrame(out, columns=["path", "content"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label").mapInPandas(paint, "path string, content binary")


_PIXELS = "(SELECT 'p' || vec_id AS path, (i % 8)::INT AS x, (i // 8)::INT AS y, floor((embedding[i + 1]::DOUBLE + 1) * 127)::INT AS r, (i * 3)::INT AS g, (label * 10)::INT AS b FROM embeddings, range(0, 64) t(i))"


@R.add("image_pixel_atoms", f"SELECT r, g, b, count(*) AS reference_count FROM {_PIXELS} p GROUP BY r, g, b")
def image_pixel_atoms(spark, sf_dir):
    return X.image_pixels(_images(spark, sf_dir)).groupBy("r", "g", "b").agg(F.count("*").alias("reference_count"))


@R.add("image_patches", f"SELECT path, x // 4 AS px, y // 4 AS py, round(avg(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b), 6) AS luminance FROM {_PIXELS} p GROUP BY path, x // 4, y // 4")
def image_patches(spark, sf_dir):
    lum = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    patch = lambda c: F.floor(F.col(c) / 4).cast("int")
    return X.image_pixels(_images(spark, sf_dir)).groupBy("path", patch("x").alias("px"), patch("y").alias("py")).agg(F.round(F.avg(lum), 6).alias("luminance"))


@R.add("image_average_colour", f"SELECT path, printf('#%02X%02X%02X', floor(avg(r))::INT, floor(avg(g))::INT, floor(avg(b))::INT) AS colour FROM {_PIXELS} p GROUP BY path")
def image_average_colour(spark, sf_dir):
    whole = [F.floor(F.avg(c)).cast("int") for c in "rgb"]
    return X.image_pixels(_images(spark, sf_dir)).groupBy("path").agg(F.format_string("#%02X%02X%02X", *whole).alias("colour"))


@R.add("float_codec", "SELECT vec_id, len(embedding)::INT * 4 AS bytes, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def float_codec(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", X.floats_to_binary("embedding").alias("b"))
    back = e.select("vec_id", F.length("b").alias("bytes"), X.binary_to_floats("b").alias("v"))
    return back.select("vec_id", "bytes", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@R.add(
    "code_members",
    "SELECT 'p' || p_partkey AS path, 'import' AS kind, 'lib' || p_size AS name FROM part UNION ALL SELECT 'p' || p_partkey, 'member', 'f' || p_partkey FROM part UNION ALL SELECT 'p' || p_partkey, 'comment', p_type FROM part",
)
def code_members(spark, sf_dir):
    text = F.format_string("import lib%s\ndef f%s(x):\n    # %s\n    return x\n", "p_size", "p_partkey", "p_type")
    return X.code_members(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"), text.alias("text")))


@R.add("archive_entries", "SELECT s_nationkey, count(*) AS entries, sum(length(s_name))::BIGINT AS bytes FROM supplier GROUP BY s_nationkey")
def archive_entries(spark, sf_dir):
    """Suppliers of a nation as a zip within a gzip file, unpacked again."""
    import gzip
    import io
    import zipfile

    import pandas as pd

    def pack(key, pdf):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i, name in zip(pdf["s_suppkey"], pdf["s_name"]):
                z.writestr(f"{i}.txt", name)
        return pd.DataFrame({"path": [str(key[0])], "content": [gzip.compress(out.getvalue())]})

    files = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name").groupBy("s_nationkey").applyInPandas(pack, "path string, content binary")
    return X.read_archives(files).groupBy(F.col("path").cast("int").alias("s_nationkey")).agg(F.count("*").alias("entries"), F.sum(F.length("content")).alias("bytes"))


@R.add("file_types", "SELECT CASE vec_id % 3 WHEN 0 THEN 'image/bmp' WHEN 1 THEN 'application/x-gguf' ELSE 'text/plain' END AS kind, count(*) AS n FROM embeddings GROUP BY 1")
def file_types(spark, sf_dir):
    i = F.col("vec_id") % 3
    head = F.when(i == 0, "BM0000").when(i == 1, "GGUF00").otherwise("hello")
    e = table(spark, sf_dir, "embeddings").select(X.sniff(F.encode(head, "utf-8"), F.lit("a.txt")).alias("kind"))
    return e.groupBy("kind").agg(F.count("*").alias("n"))
