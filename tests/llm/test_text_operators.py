"""Sets, fingerprints, encoding, packing, language: against brute force, libraries and round trips."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atomweave.llm import fingerprint as fp
from atomweave.llm.jaccard_join import Threshold, needs_of, one_of_each, segment_signatures, similar_components
from atomweave.llm.language_id import identify, keep_identified
from atomweave.llm.packing import Limits, default_tokenizer, pack_documents, pack_shard, tokenizer
from atomweave.llm.sentencepiece_bpe import default_model, encode_digests, encode_documents, encoder

TEXT = st.text(alphabet=st.sampled_from("abcdefgh theing ▁\n\t<>0x12 éßñ漢🙂\x00ABC.,'İΣ"), max_size=60)


def shingles(text, width):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(rows, num, width):
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= num * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {(d, len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize(("num", "width"), [(90, 3), (80, 5)])
def test_components_equal_brute_force(odd_docs, num, width):
    got = similar_components(odd_docs, Threshold(num), width).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute_components(rows, num, width)


def test_one_of_each_keeps_the_smallest(odd_docs, no_docs):
    kept = one_of_each(odd_docs, Threshold(80), 5)
    assert kept.columns == odd_docs.columns
    want = {d for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 80, 5) if d == c}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert one_of_each(no_docs).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([80, 90]), st.integers(0, 1 << 30))
def test_linked_sets_share_a_segment(n, less, more, num, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n + more, np.uint64))
    x, y = a[:n], np.delete(a, rng.permutation(min(n, len(a)))[: min(less, n - 1)])
    both = len(np.intersect1d(x, y))
    if 100 * both >= num * (len(x) + len(y) - both):
        t = Threshold(num)
        alike = np.intersect1d(segment_signatures(x, t), segment_signatures(y, t))
        assert alike.size
        level = min(t.size_class(len(x)), t.size_class(len(y)))
        for c, need, below in (needs_of(x, t), needs_of(y, t)):
            assert 1 <= (need if c == level else below) <= np.count_nonzero((alike & np.uint64(0xFF)) == level)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_encoder_equals_the_library(text):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    e = encoder(default_model())
    ids = sp.encode(text, add_eos=True)
    assert e.encode(text) == ids
    assert e.decode(ids) == sp.decode(ids)
    assert e.digest(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_encoding_of_odd_documents(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in encode_digests(odd_docs).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 1
    full = {r["doc_id"]: r for r in encode_documents(odd_docs).collect()}
    assert len(full[100]["ids"]) == got[100]["n_tokens"]
    assert full[6]["decoded"] == "ONE\u00a0two é漢🙂"
    assert encode_digests(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_tokenizer_memo_equals_the_library(text):
    from tokenizers import Tokenizer

    lib = test_tokenizer_memo_equals_the_library.__dict__.setdefault("lib", Tokenizer.from_file(default_tokenizer()))
    assert next(iter(tokenizer(default_tokenizer()).encode(pa.array([text])))).tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["İ.", "aİ! İa. İ ?", "x \u0958, y", "\ufb2a; É. ǅ! a.", "İ.İ."])
def test_a_sign_left_of_a_letter_goes_with_the_mark(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(default_tokenizer()).encode(text, add_special_tokens=False).ids
    assert next(iter(tokenizer(default_tokenizer()).encode(pa.array([text])))).tolist() == want


def naive_packing(pieces, limits):
    """Bins of (tokens, loss, number) by the dot-product heuristic, one look at every piece that is left each time."""
    left, bins = sorted(pieces, key=lambda p: (-p[0], -p[1], p[2])), []
    while left:
        rt, rs, rq, now = limits.tokens, limits.segments, limits.loss_tokens, []
        while rs:
            fit = [p for p in left if p[0] <= rt and p[1] <= rq]
            if not fit:
                break
            score = [p[0] / limits.tokens * (rt / limits.tokens) + p[1] / max(1, limits.loss_tokens) * (rq / max(1, limits.loss_tokens)) + (1 / limits.segments) * (rs / limits.segments) for p in fit]
            best = fit[max(range(len(fit)), key=lambda i: (round(score[i], 12), -i))]
            left.remove(best)
            now.append(best[2])
            rt, rs, rq = rt - best[0], rs - 1, rq - best[1]
        bins.append(now)
    return bins


@pytest.mark.parametrize("limits", [Limits(512, 256, 512), Limits(512, 4, 512), Limits(512, 6, 150), Limits(512, 256, 100)])
def test_packing_follows_the_dot_product_within_limits_that_bind(limits):
    r = np.random.default_rng(5)
    tokens = np.minimum(512, r.lognormal(4.2, 1.0, 300).astype(int) + 1)
    loss = np.minimum((tokens * r.random(300)).astype(int), limits.loss_tokens)  # answers after prompts
    bins, offsets = pack_shard(tokens, loss, limits)
    got = [np.flatnonzero(bins == b)[np.argsort(offsets[bins == b], kind="stable")].tolist() for b in range(bins.max() + 1)]
    assert got == naive_packing(list(zip(tokens.tolist(), loss.tolist(), range(300))), limits)
    per = lambda x: np.bincount(bins, x)
    assert per(tokens).max() <= limits.tokens and per(loss).max() <= limits.loss_tokens and np.bincount(bins).max() <= limits.segments
    bound = max(-(-tokens.sum() // limits.tokens), -(-loss.sum() // limits.loss_tokens), -(-300 // limits.segments))
    assert bins.max() + 1 <= 1.15 * bound + 1


def test_packing_leaves_little_padding():
    tokens = np.minimum(4096, np.random.default_rng(6).lognormal(5.5, 1.2, 20_000).astype(int) + 1)
    bins, _ = pack_shard(tokens, tokens - 1, Limits())
    assert tokens.sum() >= 0.99 * 4096 * (bins.max() + 1)


def test_tokenizer_forgets_within_its_bound(monkeypatch):
    from atomweave.llm import packing
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MEMO_WORDS", 30)
    monkeypatch.setattr(packing, "SLICE", 200)
    tok, lib = packing.WordTokenizer(default_tokenizer()), Tokenizer.from_file(default_tokenizer())
    r = np.random.default_rng(1)
    texts = [" ".join("".join(r.choice(list("abÉé1.,'"), r.integers(1, 5))) for _ in range(r.integers(0, 60))) for _ in range(80)] + [None, ""]
    for text, ids in zip(texts, tok.encode(pa.array(texts))):
        assert ids.tolist() == lib.encode(text or "", add_special_tokens=False).ids
    assert len(tok.known) < 200


def test_packing_covers_every_id_once(odd_docs, no_docs):
    got = pack_documents(odd_docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    tok = tokenizer(default_tokenizer())
    for d in odd_docs.where("doc_id <> 50").collect():
        ids = [*next(iter(tok.encode(pa.array([d["text"]], pa.string())))).tolist(), 2]
        at = 0
        for r in sorted(by_doc[d["doc_id"]], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    assert len(by_doc[50]) == 3  # repeated rows are packed each on its own
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert pack_documents(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(0, 50)), max_size=80))
def test_vector_packing_keeps_all_limits(pieces):
    t = np.array([p[0] for p in pieces], np.int64)
    q = np.minimum(np.array([p[1] for p in pieces], np.int64), t)
    limits = Limits(50, 4, 30)
    q = np.minimum(q, 30)
    bins, offsets = pack_shard(t, q, limits)
    for b in set(bins.tolist()):
        i = np.flatnonzero(bins == b)
        assert t[i].sum() <= 50 and len(i) <= 4 and q[i].sum() <= 30
        o = i[np.argsort(offsets[i], kind="stable")]
        assert offsets[o].tolist() == (np.cumsum(t[o]) - t[o]).tolist()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=40), st.data())
def test_spans_and_extensions(text, data):
    h = fp.PrefixHashes(text)
    i, j = data.draw(st.integers(0, len(text) - 1)), data.draw(st.integers(0, len(text) - 1))
    n = 0
    while i + n < len(text) and j + n < len(text) and text[i + n] == text[j + n]:
        n += 1
    assert h.extension(i, h, j) == n
    size = data.draw(st.integers(0, len(text) - max(i, j)))
    assert (h.span(i, size) == h.span(j, size)) == (text[i : i + size] == text[j : j + size])
    assert h.spans(2).tolist() == [h.span(k, 2) for k in range(len(text) - 1)]


def test_fingerprints_of_odd_documents(odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET_ROWS", 7)  # many buckets
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd_docs.collect()))
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"]) for r in fp.fingerprints(odd_docs).collect()))
    want = []
    for i, (d, t) in enumerate(rows):
        e = fp.edited_text(t, rows[(i + 1) % len(rows)][1])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), str(fp.Fingerprint(t))))
    assert got == sorted(want)
    assert fp.fingerprints(no_docs).count() == 0


def test_likeness_orders_edits():
    r = np.random.default_rng(0)
    text = "".join(chr(97 + c) for c in r.integers(0, 26, 4000))
    other = "".join(chr(97 + c) for c in r.integers(0, 26, 4000))
    a = fp.Fingerprint(text)
    assert a.likeness(fp.Fingerprint(text)) == 1
    small, half = a.likeness(fp.Fingerprint("x" + text[:2000] + text[2003:])), a.likeness(fp.Fingerprint(text[:2000] + other[:2000]))
    assert small > 0.85 and 0.3 < half < 0.7 and a.likeness(fp.Fingerprint(other)) < 0.1


def test_language_of_odd_documents(spark, odd_docs, no_docs):
    german = [(1000 + i, "der die und das nicht über schön " * 5 + str(i), "de", "s", 1) for i in range(30)]
    english = [(2000 + i, "the of and that with this " * 5 + str(i), "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(german + english + [(3000, None, None, "s", 1), (3001, "123 !?", "de", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    assert all(got[d]["lang_pred"] == lang and 0 <= got[d]["score"] <= 1 for d, _, lang, *_ in german + english)
    assert got[3000]["lang_pred"] == got[3001]["lang_pred"] == "und" and got[3001]["score"] == 0
    assert got[1000]["held_out"] == (zlib.crc32(b"1000") % 4 == 2)
    assert {r["doc_id"] for r in keep_identified(docs).collect()} == set(got) - {3000, 3001}
    assert identify(odd_docs).count() == odd_docs.count()
    assert identify(no_docs).count() == 0


def test_bitmap_never_misses_a_key(spark):
    from pyspark.sql import functions as F

    from atomweave.llm.common import maybe_among

    rows = spark.range(2000).withColumn("x", F.lit("t"))
    got = maybe_among(rows, "id", spark.range(0, 2000, 50).withColumnRenamed("id", "k")).where("maybe").select("id").toPandas()["id"]
    assert set(range(0, 2000, 50)) <= set(got) and len(got) < 60
    assert maybe_among(rows, "id", spark.range(0).withColumnRenamed("id", "k")).where("maybe").count() == 0


def slow_grams(text):
    """1- to 3-grams of letters by words padded with a space; None without letters."""
    out, any_letter = defaultdict(int), False
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in words:
        any_letter = True
        p = f" {w} "
        for i in range(len(p)):
            if p[i] != " ":
                out[p[i]] += 1
            if i + 1 < len(p):
                out[p[i : i + 2]] += 1
            if i + 2 < len(p):
                out[p[i : i + 3]] += 1
    return out if any_letter else None


def code(gram):
    n = 0
    for c in gram:
        n = n << 21 | ord(c)
    return n


def slow_top(counts, k):
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:k]


def test_languages_equal_a_brute_force_of_the_out_of_place_distance(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    total = defaultdict(lambda: defaultdict(int))
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None:
            for g, n in (slow_grams(r["text"]) or {}).items():
                total[r["lang"]][g] += n
    k = 300
    profiles = {lang: {g: i for i, g in enumerate(slow_top(c, k))} for lang, c in sorted(total.items())}
    want = {}
    for r in rows:
        counts = slow_grams(r["text"] or "")
        if counts is None:
            want[r["doc_id"]] = ("und", 0.0)
            continue
        top = slow_top(counts, k)
        far = {lang: sum(abs(p[g] - i) if g in p else k for i, g in enumerate(top)) for lang, p in profiles.items()}
        best = min(far, key=far.get)
        want[r["doc_id"]] = (best, 1 - far[best] / (k * len(top)))
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    assert set(got) == set(want)
    for d, (lang, score) in want.items():
        assert got[d]["lang_pred"] == lang and abs(got[d]["score"] - score) < 1e-12 and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_likeness_on_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    same = 0
    for (d, t), (_, s) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        e = t[: len(t) - k] + s[:k]
        own, edited, after = fp.Fingerprint(t), fp.Fingerprint(e), fp.Fingerprint(s)
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(e.encode()).hexdigest(), str(own), str(edited))
        assert abs(r["near_edited"] - own.likeness(edited)) < 1e-12 and abs(r["near_next"] - own.likeness(after)) < 1e-12
        same += r["near_edited"] > r["near_next"]
    assert same > 0.9 * len(rows)
