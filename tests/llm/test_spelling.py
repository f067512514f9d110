"""op13 against all pairs of words, on a small fixture and with long words."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from atomweave.llm.queries_spelling import counted_words, op13_spelling_variants
from atomweave.llm.spelling import LONG, deletion_hashes, group_variants

WORD = "word string, n long"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, factor=10):
    form, out = {}, set()
    for w, n in counts.items():
        best = min(((-m, x) for x, m in counts.items() if near(w, x)), default=None)
        form[w] = best[1] if best and -best[0] >= factor * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, sum(near(w, x) for x in counts), counts[form[w]] if form[w] else None))
    return out


def words_of(rows):
    c = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if n >= 2 and len(w) >= 7}


def test_small_alphabet_equals_all_pairs(spark):
    r = random.Random(5)
    counts = {"".join(r.choice("abé") for _ in range(r.randint(1, 7))): 10 ** r.randint(0, 5) * r.randint(1, 3) for _ in range(500)}
    got = group_variants(spark.createDataFrame([*counts.items()], WORD))
    rows = [tuple(x) for x in got.collect()]
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len(rows) == len(counts) and set(rows) == brute(counts)
    assert any(f and f != t for _, f, t, *_ in rows)  # a path of two steps at least


def test_long_words_ties_and_odd_rows(spark):
    r = random.Random(6)
    base = "".join(r.choice("abcdeù") for _ in range(LONG + 3))
    counts = {base: 1000}
    for at in range(0, 6):
        counts[base[:at] + base[at + 1 :]] = 5 + at
        counts[base[: at * 9] + "z" + base[at * 9 :]] = 7
        counts[base[: at * 9] + "y" + base[at * 9 + 1 :]] = 101
    short = base[: LONG]
    counts |= {short: 3, short + "q": 30, short + "qx": 300, short[:-1]: 3, "a" * 30000: 2, "a" * 29999: 20, "tie": 1, "tid": 10, "tif": 10, "": 1, "x": 10}
    rows = [*counts.items(), ("tie", None), (None, 4)]
    twice = [(w, n - n // 2) for w, n in rows if n] + [(w, n // 2) for w, n in rows if n and n // 2]
    df = spark.createDataFrame([(*x, 1, 2) for x in twice + [(None, 1), ("tie", None)]], WORD + ", id int, key int")
    want = brute(counts)
    got = [tuple(x) for x in group_variants(df).collect()]
    assert len(got) == len(want) and set(got) == want
    assert ("tie", "tid", "tid", 1, 2, 10) in want
    assert group_variants(df.limit(0)).count() == 0


def test_documents(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = words_of(rows)
    got = [tuple(x) for x in op13_spelling_variants(spark, sf).collect()]
    assert {x[0]: x[3] for x in got} == counts and len(got) == len(counts)
    sample = sorted(counts)[::40]
    for w in sample:
        others = {x: n for x, n in counts.items() if near(w, x)}
        form = next((x for m, x in sorted((-n, x) for x, n in others.items()) if -m >= 10 * counts[w]), None)
        mine = next(x for x in got if x[0] == w)
        assert (mine[4], mine[1]) == (len(others), form)
    assert {tuple(x) for x in counted_words(odd_docs).collect()} == set(words_of([(x["doc_id"], x["text"]) for x in odd_docs.collect()]).items())
    assert counted_words(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab🙂", min_size=1, max_size=9), st.text("ab🙂", min_size=1, max_size=9))
def test_hashes_meet_as_texts_do(a, b):
    keys = lambda w: {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
    assert len(deletion_hashes(a)) == len(keys(a))
    assert len({*deletion_hashes(a)} & {*deletion_hashes(b)}) == len(keys(a) & keys(b))


def test_no_python_for_words_of_usual_length(spark):
    plan = group_variants(spark.createDataFrame([("abc", 1)], WORD))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan
