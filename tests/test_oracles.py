"""Every registered query of the package with an oracle equals DuckDB on sf0.001; rows, names and values."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from atomweave.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


#: Queries that SQL doesn't express, by the test that holds their operator.
HELD = {f"group_{n}": "test_grouped.py" for n in ("geometric_median", "convex_hull", "online_kmeans", "tsne", "attention", "self_consistency", "diverse", "dtw", "change_points", "matrix_factorization")}
HELD |= {f"group_{n}": "test_moments.py" for n in ("mahalanobis", "principal_components", "explained_variance", "autoencoder", "random_projection")}
HELD |= {"generate_sequences": "test_search_and_generation.py"}


def test_queries_without_oracle_are_held_by_a_test():
    assert {n for n in registry.QUERIES if n not in registry.ORACLES} == {*HELD}
    for name, file in HELD.items():
        with open(os.path.join(os.path.dirname(__file__), file)) as f:
            text = f.read()
        assert name in text or f"G.{name[6:]}(" in text or name == "generate_sequences" and "generate(" in text


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((repr([plain(r[c]) for c in cols]) for r in df.collect()))
    if name not in registry.ORACLES:
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
