"""op12: Boolean queries lose no match, the index equals plain sets, and a scan equals plain regular expressions."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atomweave.llm import secret_scan
from atomweave.llm.common import fresh_path
from atomweave.llm.queries_secrets import RULES, digests, op12_secret_scan
from atomweave.llm.secret_scan import Rule, answer, build_index, candidates, code, scan, text_codes, trigrams_of

SECRETS = [
    "password: hunter2hunter2", "API_KEY = 'abcdefgh'", "apikey=\"12345678901\"", "token : short", "secret=" + "x" * 9, "passwd==abcdefgh",
    "AKIA" + "Q7" * 8, "AKIASHORT", "AKIAAKIA" + "Z" * 8, "deadbeef" * 4, "deadbeef" * 3 + "deadbee", "0" * 70, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----",
    "ghp_" + "a1" * 20, "xoxb-123456789012-abc", "AIza" + "B" * 35, "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "sk_live_" + "9" * 20, "https://user:pa55@host/x",
]


def plain(text):
    out = []
    for i, r in enumerate(RULES):
        for m in re.compile(r.pattern.replace("{32,}", "+"), re.ASCII).finditer(text or ""):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), i, m.end()))
    return [(RULES[i].kind, s, e) for s, i, e in sorted(out)]


def texts():
    r = random.Random(8)
    words = ["the", "token", "of", "é漢🙂", "Secret", "key", "\n", "ſecret=abcdefghij", "=", "a" * 31]
    out = [None, "", "a", "ab", "ǅ" * 5, *SECRETS, "".join(SECRETS), "🙂 ".join(SECRETS), "\n".join(SECRETS).upper(), "\n".join(SECRETS).lower()]
    for _ in range(150):
        out.append(" ".join(r.choice(words if r.random() < 0.95 else SECRETS) for _ in range(r.randint(1, 60))))
    return [*out, "word " * 40_000 + SECRETS[0] + " word" * 40_000, SECRETS[9] * 30_000]


def test_scan_equals_plain_expressions(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(secret_scan, "SHARD_DOCS", 16)
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, SECRETS[0], "y"), (None, None, "y"), (3, SECRETS[6], "z"), (3, SECRETS[6], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mask string").withColumn("maybe", F.lit(0))
    got = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in scan(docs, RULES).collect()]
    assert sorted(got, key=repr) == sorted(((i, plain(t)) for i, t, _ in rows), key=repr)
    assert {k for _, spans in got for k, *_ in spans} == {r.kind for r in RULES}
    assert scan(odd_docs, RULES).count() == odd_docs.count()
    assert scan(no_docs, RULES).count() == 0


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    base = lambda spans: [s for s in spans if s[0] in ("assign", "access", "hex")]
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], r["spans"]) for r in op12_secret_scan(spark, sf).collect()}
    docs = {r["doc_id"]: plain(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    number = lambda spans, k: sum(s[0] == k for s in spans)
    assert got == {d: (number(s, "assign"), number(s, "access"), number(s, "hex"), hashlib.sha256(joined(base(s)).encode()).hexdigest(), joined(s)) for d, s in docs.items()}
    assert digests(scan(spark.createDataFrame([(1, None)], "doc_id long, text string"), RULES)).first()["spans"] == ""


@pytest.mark.parametrize("docs_a_shard", [7, 1 << 15])
def test_index_equals_plain_sets(spark, monkeypatch, docs_a_shard):
    monkeypatch.setattr(secret_scan, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(secret_scan, "PIECE", 1000)
    rows = [*enumerate(texts())]
    index = build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), fresh_path(spark, "test-index"))
    of = {i: {code(x[j : j + 3]) for j in range(len(x) - 2)} for i, t in rows if t for x in [t.encode().lower()]}
    shards = {}
    for r in index.collect():
        shards.setdefault(r["shard"], {})[r["trigram"]] = r
    got = {}
    for lists in shards.values():
        ids = lists.pop(-1)["ids"]
        for t, r in lists.items():
            for i in np.flatnonzero(secret_scan._members(bytes(r["postings"]), r["n"], len(ids))):
                got.setdefault(ids[i], set()).add(t)
    assert got == {i: x for i, x in of.items() if x}
    masks = {r["doc_id"]: r["mask"] for r in candidates(index, RULES).collect()}
    for i, t in rows:
        for k, rule in enumerate(RULES):
            if rule.query is not True:
                assert bool(masks.get(i, 0) >> k & 1) >= bool([*rule.spans(t or "")])
    assert sum(m & 1 for m in masks.values()) < len(rows) * 0.9  # the index closes some


EXPRESSIONS = ["abc", "ab?c", "a[bB]c{2}d", "(?i:xyz|Q[rs]t)u", "(ab|cd)+ef", "a.c", "ab(?=c)cd", "[^a]bcd", "(?:aa|bb|cc){2}x", "a*bcd", "foo|", "ab(c|d|)ef", "é[ab]c", r"\babc\b", "(?P<x>ab)c(?P=x)", "abc{0}d", "(?>abc)d", "[a-d]ab"]


@settings(max_examples=150, deadline=None)
@given(st.text("abcdefxyzqrstuoé ABC", max_size=14))
def test_queries_lose_no_match(text):
    codes = {*text_codes(text.encode()).tolist()}
    for pattern in EXPRESSIONS:
        rule = Rule("k", pattern)
        if rule.compiled.search(text):
            assert answer(rule.query, {t: np.array([t in codes]) for t in trigrams_of(rule.query)}, 1)[0]


def test_queries_by_hand():
    t = lambda s: code(s.encode())
    assert Rule("k", "AbCd").query == ("and", (t("abc"), t("bcd"))) or {*Rule("k", "AbCd").query[1]} == {t("abc"), t("bcd")}
    assert Rule("k", "[0-9a-f]+").query is True
    assert {*Rule("k", "abc|xyz").query[1]} == {t("abc"), t("xyz")}
    assert Rule("k", "abcd?").query == t("abc")  # what the shorter one implies is dropped
    with pytest.raises(ValueError, match="62"):
        scan(None, [Rule(str(i), "abc") for i in range(63)])
