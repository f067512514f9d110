"""op11 against a plain merge of both branches, and the operator's own interface."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from atomweave.llm.branch_merge import COUNTS, merge_branches, merge_rows
from atomweave.llm.queries_merge import merged_documents, op11_branch_merge

BRANCH = "doc_id long, branch struct<row: string, columns: struct<lang: struct<kind: string, text: string>, source: struct<kind: string, text: string>>, head: array<string>, lines: array<struct<kind: string, text: string, insert: array<string>>>>"


def plain_merge(rows):
    """Rows (doc_id, lang, source, text or nulls, counts) of (doc_id, lang, source, text)."""
    out, added = [], {}
    for d, *plain in rows:
        lang, source, text = (x or "" for x in plain)
        code = lambda b, n: zlib.crc32(f"{b}:{d}:{n}".encode()) % 11 if d is not None else 10  # noqa: B023, E731
        edit = lambda x, c: {0: "", 1: x + "!", 2: x + "?"}.get(c, x)
        lines, n, branches = text.split("\n"), Counter(), {}
        for b, below in (("L", 1), ("R", 2)):
            r = code(b, "row")
            if r in (3, 4):
                added.setdefault(-below - d, set()).add((lang, source, "!" if r == 3 else "?"))
            branches[b] = r, [edit(x, code(b, c)) for c, x in (("lang", lang), ("source", source))], [code(b, str(i)) for i in range(len(lines))]
        (lr, lc, ll), (rr, rc, rl) = branches["L"], branches["R"]
        dirty = {b: c != [lang, source] or any(x < 5 for x in k) for b, (_, c, k) in branches.items()}
        if lr == 0 or rr == 0:
            if lr == rr or not dirty["R" if lr == 0 else "L"]:
                out.append((d, None, None, None, 1, 0, 0, 0))
            else:
                out.append((d, lang, source, text, 0, 0, 1, 0))
            continue
        cols = []
        for base, a, b in zip((lang, source), lc, rc):
            if a != base and b != base and a != b:
                n["ee"] += 1
                cols.append(base)
            else:
                n["clean"] += a != base or b != base
                cols.append(a if a != base else b)
        got = []
        for x, a, b in zip(lines, ll, rl):
            if a <= 2 and b <= 2 and a != b:
                n["ed" if 0 in (a, b) else "ee"] += 1
                got.append(x)
            else:
                n["clean"] += a <= 2 or b <= 2
                c = min(a, b) if min(a, b) <= 2 else 9
                if c:
                    got.append(edit(x, c))
            gaps = {c for c in (a, b) if c in (3, 4)}
            n["ii"] += len(gaps) == 2
            n["clean"] += len(gaps) == 1
            if len(gaps) == 1:
                got.append("!" if gaps == {3} else "?")
        out.append((d, *cols, "\n".join(got), n["clean"], n["ee"], n["ed"], n["ii"]))
    for d, values in added.items():
        out.append((d, *next(iter(values)), 1, 0, 0, 0) if len(values) == 1 else (d, None, None, None, 0, 0, 0, 1))
    return out


def test_equals_a_plain_merge(spark, odd_docs, no_docs):
    more = [(200 + i, "en" if i % 3 else None, f"s{i % 2}", "\n".join(f"line {j}" for j in range(i % 40)) + "\n" * (i % 3), i) for i in range(600)]
    docs = odd_docs.unionByName(spark.createDataFrame([(*x, "x") for x in more] + [(None, "a\nb", None, "s", 1, "y")], "doc_id long, lang string, source string, text string, n_chars long, rid string").select(*odd_docs.columns), allowMissingColumns=True)
    docs = docs.withColumn("left", F.lit(1)).withColumn("lines", F.lit("clash")).withColumn("L", F.lit(2))
    rows = [(r["doc_id"], r["lang"], r["source"], r["text"]) for r in docs.collect()]
    got = Counter(tuple(r) for r in merged_documents(docs).collect())
    assert got == Counter(plain_merge(rows))
    assert {k for r in got for k, v in zip(COUNTS, r[4:]) if v} == set(COUNTS)
    assert merged_documents(no_docs).count() == 0


def test_query_has_digests(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text").collect()]
    want = Counter((*x[:3], x[3] if x[3] is None else hashlib.sha256(x[3].encode()).hexdigest(), *x[4:]) for x in plain_merge(rows))
    assert Counter(tuple(r) for r in op11_branch_merge(spark, sf).collect()) == want


def test_branches_as_tables(spark):
    base = spark.createDataFrame([(1, "en", "s", "a\nb\nc"), (2, None, "s", None), (3, "fr", "t", "x")], "doc_id long, lang string, source string, text string")
    keep = ("retain", None, None)
    plain = (("retain", None), None)
    left = [(1, ("retain", plain, ["top"], [keep, ("delete", None, ["1", "2"])])), (2, ("retain", (("replace", "de"), ("delete", None)), None, [("replace", "new", None)]))]
    right = [(1, ("retain", None, ["top"], [("replace", "A", None), keep, ("replace", "C", ["end"])])), (2, ("delete", None, None, None)), (3, ("delete", None, None, None))]
    added = spark.createDataFrame([(9, "L", "en", "s", "n"), (9, "R", "en", "s", "n"), (8, "L", "en", "s", "n"), (8, "R", "en", "s", "m")], "doc_id long, branch string, lang string, source string, text string")
    tables = [spark.createDataFrame(x, BRANCH) for x in (left, right)]
    want = {(1, "en", "s", "top\nA\n1\n2\nC\nend", 6, 0, 0, 0), (2, "", "s", "", 0, 0, 1, 0), (3, None, None, None, 1, 0, 0, 0), (9, "en", "s", "n", 1, 0, 0, 0), (8, None, None, None, 0, 0, 0, 1)}
    assert {tuple(r) for r in merge_branches(base, *tables, added).collect()} == want
    assert {tuple(r) for r in merge_branches(base, *tables[::-1], added).collect()} == want  # either branch may come first
    far = spark.createDataFrame([(3, ("retain", None, None, [keep, keep]))], BRANCH)
    with pytest.raises(Exception, match="beyond base"):
        merge_branches(base, far, tables[0], added).collect()


def test_no_shuffle_of_texts(spark, odd_docs):
    plan = merged_documents(odd_docs.where("doc_id > 0"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1  # of the inserted rows alone


def test_merged_rows_keep_types(spark):
    one = spark.createDataFrame([(1, "t")], "id string, body string").selectExpr("cast(id as string) id", "body", "cast(null as struct<row: string, columns: struct<>, head: array<string>, lines: array<struct<kind: string, text: string, insert: array<string>>>>) l").withColumn("r", F.col("l"))
    assert [tuple(r) for r in merge_rows(one, "id", (), "body", "l", "r").collect()] == [("1", "t", 0, 0, 0, 0)]
