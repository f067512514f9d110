from atomweave.operators.lineage import walk


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), (None, "a"), ("x", "y")], "src string, dst string")
    got = {(r["node"], r["depth"], ">".join(r["path"])) for r in walk(edges, "a").collect()}
    assert got == {("a", 0, "a"), ("b", 1, "a>b"), ("c", 1, "a>c"), ("d", 2, "a>b>d"), ("d", 2, "a>c>d"), ("e", 3, "a>b>d>e"), ("e", 3, "a>c>d>e")}
    assert {r["node"] for r in walk(edges, "e", 2, upstream=True).collect()} == {"e", "d", "b", "c"}
    assert walk(edges, "nowhere").count() == 1
    long = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)], "src string, dst string")
    assert walk(long, "0").count() == 13
