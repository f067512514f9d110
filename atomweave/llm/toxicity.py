"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Terms are the letter runs of the lower-cased text: every term of every example is in the index, and every
term of a text is looked up. A term weighs (1 + ln tf) * idf; vectors have unit length and the cosine is
exact. Examples are at most ``EXAMPLES`` labelled documents of each label (in expectation; drawn by hash), a documented bound.

Examples are numbered so that similar ones lie in one block: halves of their projections, along the widest direction. For each term and block
the index keeps the largest weight. Common terms are a matrix, whose product with ``TOGETHER`` texts at a time gives their part of every similarity. A text's bound for a block
is the largest such part in it and the sum over the other terms. The blocks of the largest bounds are opened first; then only those whose bound
reaches the k-th similarity so far, and postings are read of opened blocks alone, so pruning is exact. Sums over blocks are in single precision, and whatever comes within ``MARGIN`` of
the k-th is measured again in double precision.

Of the ``NEIGHBOURS`` nearest, those ``VOTERS`` vote that are the nearest by the same cosine with each term's weight multiplied by ``FLOOR`` + phi, where phi is the strength of the term's association
with the label among the examples (square root of chi-squared over their number, 0 to 1); by that cosine they are weighted. So which examples are near is a matter of the texts
alone, and the label's terms only decide which of them speak, and how loud.

Votes are weighted for the share of their label that was sampled and
drawn to the prior by ``PULL``. A logistic curve turns the vote into a probability; it is fitted at every size on the votes that the
examples get from each other, each without its own. The evidence is the nearest examples themselves. Ties go to the smaller example number.

A text without a term of any example (empty and null ones too) has no neighbour and gets the prior's score. With
labels of one kind only every score is 1 or 0 after that kind, with none 0. Rows of ``labels`` that
repeat a doc_id count once, as toxic if any is; null labels don't count. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import tidy, trim
from atomweave.llm.language_id import remainder

EXAMPLES = 1000
NEIGHBOURS, VOTERS, EVIDENCE = 100, 15, 3
BLOCK = 16
#: Blocks that are opened before the bounds are held against the k-th similarity: at first, then ever more.
ROUNDS = (10, 30)
PULL = 0.5
FLOOR = 1e-3
#: A term in one of so many examples or more is common; so many numbers the matrix of common terms has at most.
COMMON, DENSE = 64, 1 << 22
#: Texts that meet the matrix in one product; their weights for it are as many rows.
TOGETHER = 64
#: More than single precision can be wrong by in a cosine.
MARGIN = 1e-4
MEMO_WORDS = 50_000
#: Rows that are handed back at once.
ROWS = 1000
#: Bytes of text whose words are told apart at once; a longer text is taken alone.
SLICE = 1 << 18
WORD = re.compile(r"[^\W\d_]+")


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from begin to end (without it), one pair after the other, and each number's pair."""
    size = end - begin
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (begin - (np.cumsum(size) - size))[of], of


class Terms:
    """Numbers and counts of the terms of texts, by columns; what words consist of is remembered, within bounds."""

    def __init__(self, vocab: dict[str, int] | None = None):
        #: Without a vocabulary given, terms are numbered as they come.
        self.fixed, self.vocab = vocab is not None, {} if vocab is None else vocab
        self.memo: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        if not self.fixed and word.isalpha():  # one run, which needn't be remembered
            return (self.vocab.setdefault(word, len(self.vocab)),)
        got = self.memo.get(word)
        if got is None:
            runs = WORD.findall(word)
            got = self.memo[word] = tuple(self.vocab[t] for t in runs if t in self.vocab) if self.fixed else tuple(self.vocab.setdefault(t, len(self.vocab)) for t in runs)
        return got

    def counts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text its distinct terms, ascending, and how often they occur; a null text has none."""
        texts = texts.fill_null("")
        upto = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE, "right")))
            words = pc.ascii_split_whitespace(pc.utf8_lower(texts.slice(i, j - i)))
            some = words.flatten().dictionary_encode()
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            names = some.dictionary.to_pylist()
            number = np.fromiter((self.vocab.get(w, -1) for w in names), np.int64, len(names))
            size = (number >= 0).astype(np.int64)  # a word that is a term is that term alone
            odd = [i for i in np.flatnonzero(number < 0).tolist() if not (self.fixed and names[i].isalpha())]
            each = [self._of(names[i]) for i in odd]
            size[odd] = [len(x) for x in each]
            first = np.concatenate([[0], np.cumsum(size)])
            flat = np.empty(first[-1], np.int64)
            flat[first[:-1][number >= 0]] = number[number >= 0]
            flat[ranges(first[:-1][odd], first[1:][odd])[0]] = [t for x in each for t in x]
            w = some.indices.to_numpy()
            at, _ = ranges(first[w], first[w + 1])
            found = flat[at]
            edge = np.concatenate([[0], np.cumsum(size[w])])[words.offsets.to_numpy() - words.offsets[0].as_py()]
            for a, b in zip(edge, edge[1:]):
                yield np.unique(found[a:b], return_counts=True)
            i = j


def _alike(t: np.ndarray, w: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order of examples such that similar ones follow each other: their projections are halved along the widest direction down to blocks."""
    signs = np.random.default_rng(7).standard_normal((int(t.max()) + 1 if len(t) else 1, 48)).astype(np.float32)
    x = np.zeros((len(ids), 48), np.float32)
    for a in range(0, len(t), 1 << 18):
        part = slice(a, a + (1 << 18))
        np.add.at(x, owner[part], w[part, None].astype(np.float32) * signs[t[part]])
    todo, out = [np.lexsort([ids])], []
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            out.append(at)
            continue
        c = x[at] - x[at].mean(0)
        axis = np.linalg.eigh(c.T @ c)[1][:, -1]
        at = at[np.argsort(c @ axis, kind="stable")]
        half = -(-len(at) // BLOCK) // 2 * BLOCK  # whole blocks
        todo += [at[half:], at[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Index:
    """Block-max inverted index over unit vectors of examples."""

    vocab: dict[str, int]
    factor: np.ndarray  # idf of each term
    strength: np.ndarray  # FLOOR and association with the label of each term
    first: np.ndarray  # where each example's terms begin
    term: np.ndarray
    weight: np.ndarray
    told: np.ndarray  # weights with strength, of unit length, times strength once more: for a text's plain weights
    ids: np.ndarray
    toxic: np.ndarray
    vote_weight: np.ndarray
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    opened: int = 0  # blocks, of so many asked for
    asked: int = 0

    @classmethod
    def build(cls, vocab: dict[str, int], vectors: list[tuple[np.ndarray, np.ndarray]], ids, toxic, vote_weight, prior: float) -> Index:
        """vectors: distinct terms and counts of each example. Examples are numbered so that those alike share blocks."""
        toxic = np.asarray(toxic, float)
        t, n = (np.concatenate([v[i] for v in vectors]).astype(np.int64) for i in (0, 1))
        size = np.array([len(v[0]) for v in vectors], np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        df = np.bincount(t, minlength=len(vocab))
        idf = np.log((len(size) + 1) / (df + 1)) + 1
        n1 = toxic.sum()
        n0 = len(size) - n1
        a = np.bincount(t[toxic[owner] > 0], minlength=len(vocab)).astype(float)
        apart = a * n0 - (df - a) * n1
        phi = np.abs(apart) / np.sqrt(np.maximum(n1 * n0 * df * (len(size) - df).clip(1), 1.0))
        strength = FLOOR + np.minimum(phi, 1.0)
        unit = lambda w: w / np.sqrt(np.bincount(owner, w * w, len(size)).clip(1e-300))[owner]
        w = unit((1 + np.log(n)) * idf[t])
        told = unit(w * strength[t])
        start = np.concatenate([[0], np.cumsum(size)])
        order = _alike(t, w, owner, np.asarray(ids))
        at, _ = ranges(start[:-1][order], start[1:][order])
        return cls(vocab, idf, strength, np.concatenate([[0], np.cumsum(size[order])]), t[at], w[at], (told * strength[t])[at], np.asarray(ids, np.int64)[order], toxic[order], np.asarray(vote_weight, float)[order], prior)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("postings", "cells", "common", "asked_for")}

    @cached_property
    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each term's postings begin; their examples, ascending, weights and weights with strength, both in single precision."""
        order = np.argsort(self.term, kind="stable").astype(np.int32)
        example = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.first))[order]
        return np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=len(self.vocab)))]), example, self.weight.astype(np.float32)[order], self.told.astype(np.float32)[order]

    @cached_property
    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A cell is a term's postings in a block: where each term's cells begin; their blocks, largest weights, and where their postings begin."""
        start, example, weight, _ = self.postings
        block = example // BLOCK
        fresh = np.ones(len(block), bool)
        fresh[1:] = block[1:] != block[:-1]
        fresh[start[:-1][start[:-1] < len(block)]] = True
        at = np.flatnonzero(fresh)
        return np.searchsorted(at, start), block[at], np.maximum.reduceat(weight, at) if len(at) else weight, np.concatenate([at, [len(block)]])

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each term's row in the matrix of common terms or -1; the matrix (term, example), examples filled up to whole blocks; what its weights times strength squared lack of ``told``, by example."""
        start, example, weight, _ = self.postings
        df, n = np.diff(start), self.blocks * BLOCK
        some = np.argsort(-df, kind="stable")[: DENSE // max(1, n)]
        some = some[(df[some] * COMMON >= len(self.ids)) & (df[some] > 0)]
        row, out = np.full(len(df), -1, np.int32), np.zeros((len(some), n), np.float32)
        row[some] = np.arange(len(some))
        for i, t in enumerate(some):
            part = slice(start[t], start[t + 1])
            out[i, example[part]] = weight[part]
        scale = np.zeros(n)
        own = self.weight * self.strength[self.term]
        scale[: len(self.ids)] = 1 / np.sqrt(np.add.reduceat(np.append(own * own, 0.0), self.first[:-1]).clip(1e-300))
        return row, out, scale

    def ready(self) -> Index:
        """With what is derived made already, and what that took handed back: before texts take theirs."""
        self.cells, self.common
        trim()
        return self

    def parts(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common terms add to the cosines of all examples with some texts (terms, weights): one product."""
        row, matrix, _ = self.common
        asked = np.zeros((len(texts), len(matrix)), np.float32)
        for mine, (t, w) in zip(asked, texts):
            r = row[t]
            mine[r[r >= 0]] = w[r >= 0]
        return asked @ matrix

    @cached_property
    def asked_for(self) -> np.ndarray:
        """A weight for each term, 0 between queries."""
        return np.zeros(len(self.vocab) + 1)

    def forget(self) -> None:
        """Drop what can be derived again."""
        self.__dict__ = self.__getstate__()

    def unit(self, t: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights of a text's terms, of unit length."""
        w = (1 + np.log(n)) * self.factor[t]
        return w / np.sqrt(max(w @ w, 1e-300))

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k examples of the largest cosine over 0 with terms t, ascending, of weights w, exactly: example numbers, cosines, and cosines with strength."""
        if not len(t) or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        e, _, _ = self._opened(t, w, k, self.parts([(t, w)])[0])
        sims, told = self.cosines(e, t, w)
        best = np.lexsort([e, -sims])[:k]
        return e[best], sims[best], told[best]

    def judged(self, t: np.ndarray, w: np.ndarray, without: int = -1, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the NEIGHBOURS nearest the EVIDENCE first, their cosines, and those that vote and their cosines with strength. ``part`` is the text's of ``parts``.

        Single precision tells apart what is further than MARGIN from a bound; the rest is measured in double.
        """
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(t) or not len(self.ids):
            return *none, *none
        e, about, strong = self._opened(t, w, NEIGHBOURS + (without >= 0), self.parts([(t, w)])[0] if part is None else part)
        about, strong, e = about[e != without], strong[e != without], e[e != without]
        if not len(e):
            return *none, *none
        if len(e) > NEIGHBOURS:
            last = np.partition(about, len(about) - NEIGHBOURS)[len(about) - NEIGHBOURS]
            sure, open_ = about > last + MARGIN, np.abs(about - last) <= MARGIN
            by = np.flatnonzero(open_)
            by = by[np.lexsort([e[by], -self.cosines(e[by], t, w)[0]])][: NEIGHBOURS - np.count_nonzero(sure)]
            keep = np.concatenate([np.flatnonzero(sure), by])
            e, about, strong = e[keep], about[keep], strong[keep]
        sizes = min(EVIDENCE, len(e)), min(VOTERS, len(e))
        maybe = [est >= np.partition(est, len(est) - m)[len(est) - m] - MARGIN for est, m in zip((about, strong), sizes)]
        either = maybe[0] | maybe[1]
        e = e[either]
        out = []
        for exact, mine, m in zip(self.cosines(e, t, w), maybe, sizes):
            some, exact = e[mine[either]], exact[mine[either]]
            best = np.lexsort([some, -exact])[:m]
            out += [some[best], exact[best]]
        return tuple(out)

    def _opened(self, t: np.ndarray, w: np.ndarray, k: int, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Examples that may be among the k nearest, all of these among them; in single precision their cosines, and cosines with strength. ``part`` is the text's of ``parts``."""
        _, example, weight, told = self.postings
        cell, block, most, begin = self.cells
        row, matrix, scale = self.common
        dense = row[t] >= 0
        rows, wd, rare, wr = row[t[dense]], (w * self.strength[t] ** 2)[dense].astype(np.float32), t[~dense], w[~dense]
        c, of = ranges(cell[rare], cell[rare + 1])
        where, wr = block[c], wr[of]
        bound = part.reshape(self.blocks, BLOCK).max(1) + np.bincount(where, wr * most[c], self.blocks)
        order = np.argsort(-bound, kind="stable")
        falling = -bound[order]
        place = np.empty(self.blocks, np.int64)
        place[order] = np.arange(self.blocks)
        where = place[where]
        score = np.zeros(self.blocks * BLOCK, np.float32)
        byblock = score.reshape(self.blocks, BLOCK)
        extra = np.zeros(self.blocks * BLOCK)
        done, least = 0, -MARGIN
        for upto in (*ROUNDS, self.blocks):
            upto = min(upto, int(np.searchsorted(falling, -max(least, 1e-12), "right")))
            if upto <= done:
                break
            some = np.flatnonzero((where >= done) & (where < upto))
            p, q = ranges(begin[c[some]], begin[c[some] + 1])
            mine, at = wr[some][q], example[p]
            now = order[done:upto]
            byblock[now] = part.reshape(self.blocks, BLOCK)[now]
            score += np.bincount(at, mine * weight[p], len(score))
            extra += np.bincount(at, mine * told[p], len(extra))
            done = upto
            seen = byblock[order[:done]].ravel()
            least = (np.partition(seen, len(seen) - k)[len(seen) - k] if len(seen) >= k else 0.0) - MARGIN
        self.opened, self.asked = self.opened + done, self.asked + self.blocks
        e = np.flatnonzero((score >= least) & (score > 0))
        own = w * self.strength[t]
        return e, score[e], (extra[e] + (wd @ matrix[rows[:, None], e] * scale[e] if len(rows) else 0.0)) / np.sqrt(max(own @ own, 1e-300))

    def cosines(self, e: np.ndarray, t: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of examples e with terms t of weights w, plain and with strength."""
        begin, end = self.first[e], self.first[e + 1]
        self.asked_for[t] = w
        mine = self.asked_for[np.concatenate([self.term[:0], *(self.term[a:b] for a, b in zip(begin.tolist(), end.tolist()))])]
        self.asked_for[t] = 0.0
        hit = np.flatnonzero(mine)  # terms of both
        mine, upto = mine[hit], np.cumsum(end - begin)
        of = np.searchsorted(upto, hit, "right")
        at = hit + (end - upto)[of]
        told = w * self.strength[t]
        return np.bincount(of, mine * self.weight[at], len(e)), np.bincount(of, mine * self.told[at], len(e)) / np.sqrt(max(told @ told, 1e-300))

    def vote(self, e: np.ndarray, sims: np.ndarray) -> float:
        w = sims * self.vote_weight[e]
        return float((w @ self.toxic[e] + PULL * self.prior) / (w.sum() + PULL))

    def probability(self, vote: float) -> float:
        v = min(max(vote, 1e-6), 1 - 1e-6)
        return 1 / (1 + math.exp(-min(max(self.slope * math.log(v / (1 - v)) + self.shift, -50), 50)))

    def calibrate(self, votes: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """Slope and shift of a logistic curve in the vote's log odds, by Newton steps, held near 1 and 0."""
        v = np.clip(votes, 1e-6, 1 - 1e-6)
        x = np.stack([np.log(v / (1 - v)), np.ones(len(v))], 1)
        beta, centre, w = np.array([1.0, 0.0]), np.array([1.0, 0.0]), w / w.mean()
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
            g = x.T @ (w * (p - y)) + (beta - centre)
            h = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2)
            beta = beta - np.linalg.solve(h, g)
            beta[0] = max(beta[0], 0.05)
        self.slope, self.shift = map(float, beta)


class Scorer:
    """An index with a bounded memo of words."""

    def __init__(self, index: Index):
        self.index, self.terms = index, Terms(index.vocab)

    def scores(self, texts: pa.Array) -> Iterator[tuple[float, list[dict]]]:
        x = self.index
        counts = self.terms.counts(texts)
        while some := [(t, x.unit(t, n)) for t, n in islice(counts, TOGETHER)]:
            for (t, w), part in zip(some, x.parts(some)):
                e, s, voters, told = x.judged(t, w, part=part)
                evidence = [{"doc_id": int(x.ids[i]), "similarity": float(c), "toxic": int(x.toxic[i])} for i, c in zip(e, s)]
                yield x.probability(x.vote(voters, told)), evidence


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """About per_label documents at most of each label, by hash: (doc_id, text, toxic), and all labelled rows by label."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(remainder(F.col("doc_id"), 5) != 0)
    sizes = {int(r["toxic"] > 0): r["n"] for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    top = 1 << 30
    taken = F.lit(False)
    for k, n in sizes.items():
        taken = taken | (((F.col("toxic") > 0) == bool(k)) & (F.pmod(F.xxhash64("doc_id"), F.lit(top)) < int(top * min(1.0, per_label / n))))
    some = known.where(taken).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(some), "doc_id"), sizes  # per_label rows of each label


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index | float:
    """A calibrated index, or a constant score where there are no two labels to learn from."""
    rows, every = labelled_sample(docs, labels, examples)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = Terms()
            c = list(terms.counts(b.column("text")))
            names = list(terms.vocab)
            t = pa.array([[names[i] for i in x] for x, _ in c], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), t, pa.array([n.tolist() for _, n in c], pa.list_(pa.int32()))], ["doc_id", "toxic", "t", "n"])

    got = rows.select("doc_id", "text", "toxic").mapInArrow(count, "doc_id long, toxic int, t array<string>, n array<int>").toArrow().sort_by([("toxic", "ascending"), ("doc_id", "ascending")])
    return fit(got["doc_id"].to_numpy(), got["toxic"].to_numpy(), (x.as_py() for x in got["t"]), (x.as_py() for x in got["n"]), every)


def fit(ids: np.ndarray, label: np.ndarray, terms: Iterator[list[str]], counts: Iterator[list[int]], every: dict[int, int]) -> Index | float:
    """As ``learn``, from examples and the number of all labelled rows of each label."""
    sizes = {int(k): int(m) for k, m in zip(*np.unique(label, return_counts=True))}
    if len(sizes) < 2:
        return float(set(sizes) == {1})
    prior = every[1] / (every[1] + every[0])
    share = {k: every[k] / m for k, m in sizes.items()}  # labelled rows that an example stands for
    vocab: dict[str, int] = {}
    some, vectors, seen = [], [], set()
    for i, (names, n) in enumerate(zip(terms, counts)):
        t, n = np.array([vocab.setdefault(x, len(vocab)) for x in names], np.int64), np.array(n, np.int64)
        o = np.argsort(t)
        key = (label[i], t[o].tobytes(), n[o].tobytes())
        if len(t) and key not in seen:  # copies of a text with its label are one example
            seen.add(key)
            some.append(i)
            vectors.append((t[o], n[o]))
    if not some:
        return prior
    scale = max(share.values())
    index = Index.build(vocab, vectors, ids[some], label[some], [share[int(k)] / scale for k in label[some]], prior)
    votes = []
    for i, (a, b) in enumerate(zip(index.first, index.first[1:])):
        votes.append(index.vote(*index.judged(index.term[a:b], index.weight[a:b], i)[2:]))
    index.calibrate(np.array(votes), index.toxic, index.vote_weight)
    return index


def _shared(docs: DataFrame, index: Index | float) -> tuple[Broadcast | None, float | None]:
    """An index as a broadcast, which a Python worker reads once for all its tasks; or a constant."""
    if isinstance(index, float):
        return None, index
    index.forget()
    return docs.sparkSession.sparkContext.broadcast(index), None


def score(docs: DataFrame, index: Index | float) -> DataFrame:
    """(doc_id, score, evidence) of every row, from its text alone."""
    shared, index = _shared(docs, index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value.ready()) if shared else None
        for b in batches:
            got = list(s.scores(b.column(1))) if s else [(index, [])] * len(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], kind)], ["doc_id", "score", "evidence"])
        if s:
            s.index.forget()  # the worker keeps the index itself

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double, evidence array<struct<doc_id: long, similarity: double, toxic: int>>")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows whose remainder by 5 isn't 0, score all: (doc_id, held_out, score, predicted, evidence)."""
    out = score(docs, learn(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of docs, all columns as they are, whose score is under the threshold. Learned as in ``classify``."""
    shared, index = _shared(docs, learn(docs, labels))
    trim()  # the driver's part: what learning took is not to stay through later stages
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value.ready()) if shared else None
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, len(whole), ROWS)):
            scores = [x for x, _ in s.scores(b.column(at))] if s else [index] * len(b)
            yield b.filter(pa.array([x < threshold for x in scores], pa.bool_()))
        if s:
            s.index.forget()  # the worker keeps the index itself

    return docs.mapInArrow(tidy(run), docs.schema)
