import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows and a clashing extra column."""
    r = random.Random(3)
    base = " ".join(r.choice(WORDS) + str(i % 7) for i in range(120))
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, " \n\t ", "en", "s", 3), (4, "One two", "en", "s", 7), (5, "ONE two", "en", "s", 7), (6, "ONE\u00a0two é漢🙂", "fr", "s", 9)]
    rows += [(10 + i, base, "en", "hot", 5) for i in range(12)]
    for i in range(12):
        w = base.split()
        w[10 * (i % 10)] = f"edit{i}"
        rows.append((30 + i, " ".join(w), "en", "hot", 5))
    rows += [(50 + i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 60))), "en", "s", 5) for i in range(40)]
    rows += [(100, "word " * 20000, "en", "s", 100000), (50, rows[30][1], "en", "s", 5), (50, rows[30][1], "en", "s", 5)]
    return spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, rid string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
