"""Language identification by rank-order profiles of character n-grams.

A profile is a language's ``PROFILE_GRAMS`` most frequent n-grams (1 to 3 letters, words padded by a space) in
rank order. A document's own most frequent n-grams are compared to each profile by the out-of-place distance:
the sum of rank differences, with the largest penalty for n-grams that the profile lacks. The nearest
profile names the language; ties go to the language first in order. The score is 1 minus the distance's share
of the largest one.

Profiles are learned from at most ``PROFILE_DOCS`` documents of a language (in expectation; drawn by a hash of doc_id); their whole
texts are counted in parallel. Only profiles go to the driver, for at most ``MAX_LANGUAGES`` languages.
Prediction reads the text alone, all of it, and needs no shuffle.

A null text or one without a letter is ``und`` with score 0, and so is everything if nothing could be learned.
Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.llm.common import tidy

UND = "und"
PROFILE_GRAMS = 300
PROFILE_DOCS = 500
MAX_LANGUAGES = 1024
SPACE = 32
#: Texts that are Python strings at once.
ROWS = 256

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct 1- to 3-grams of a text (code points in 21 bits each, so exact) and their counts; None without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ok = _letters()[c]
    if not ok.any():
        return None
    c = np.where(ok, c, np.uint64(SPACE))
    c = np.concatenate([[np.uint64(SPACE)], c, [np.uint64(SPACE)]])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
    c = c[keep]
    if c[-1] != SPACE:
        c = np.append(c, np.uint64(SPACE))
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    three = three[c[1:-1] != SPACE]  # no n-gram across words
    g = np.sort(np.concatenate([c[c != SPACE], two, three]))
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.diff(np.append(first, len(g)))


def top_grams(text: str, k: int = PROFILE_GRAMS) -> np.ndarray | None:
    """The k most frequent n-grams in rank order, ties to the smaller code."""
    got = grams(text)
    if got is None:
        return None
    g, n = got
    return g[np.argsort(-n, kind="stable")[:k]]


class Profiles:
    """Ranks of all profiles' n-grams in one table."""

    def __init__(self, ranked: dict[str, list[int]], k: int = PROFILE_GRAMS):
        self.langs, self.k = sorted(ranked), k
        self.vocab = np.unique(np.array([g for v in ranked.values() for g in v], np.uint64))
        self.ranks = np.full((len(self.vocab) + 1, len(self.langs)), -1, np.int64)  # -1: not in the profile
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.vocab, np.array(ranked[lang], np.uint64)), j] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        top = top_grams(text, self.k) if text and self.langs else None
        if top is None:
            return UND, 0.0
        at = np.searchsorted(self.vocab, top)
        at[at == len(self.vocab)] = 0
        at = np.where(self.vocab[at] == top, at, len(self.vocab))
        r = self.ranks[at]
        d = np.where(r < 0, self.k, np.abs(r - np.arange(len(top))[:, None])).sum(0)
        best = int(np.argmin(d))
        return self.langs[best], float(1.0 - d[best] / (self.k * len(top)))

    def predictions(self, texts: pa.Array) -> Iterator[tuple[str, float]]:
        for i in range(0, len(texts), ROWS):
            yield from map(self.predict, texts.slice(i, ROWS).to_pylist())


def learn(labelled: DataFrame, profile_docs: int = PROFILE_DOCS, k: int = PROFILE_GRAMS) -> Profiles:
    """Profiles from rows (doc_id, text, lang); rows with null lang or text don't count."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Profiles({}, k)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int((1 << 30) * min(1.0, profile_docs / n)))])
    sample = rows.where(F.col("h") < F.try_element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, dict[int, int]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = grams(text)
                if got is not None:
                    mine = by.setdefault(lang, {})
                    for g, n in zip(got[0].tolist(), got[1].tolist()):
                        mine[g] = mine.get(g, 0) + n
            rows = [(lang, g, n) for lang, x in by.items() for g, n in x.items()]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["lang", "gram", "n"])

    counts = sample.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in counts.withColumn("r", rank).where(F.col("r") <= k).orderBy("lang", "r").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, k)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(profiles.predictions(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of the decimal doc_id, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def identify(docs: DataFrame) -> DataFrame:
    """Learn from documents whose remainder by 4 isn't 2, predict all: (doc_id, held_out, lang_pred, score)."""
    held = remainder(F.col("doc_id"), 4) == 2
    profiles = learn(docs.where(F.coalesce(~held, F.lit(True))))
    return predict(docs, profiles).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


#: A text as far from every profile as this is in none of the languages.
MIN_SCORE = 0.25


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Rows of docs, all columns as they are, whose language can be told: not ``und``, score at least min_score.

    Profiles are learned as in ``identify``. Whole rows stream through, so nothing is joined back.
    """
    held = remainder(F.col("doc_id"), 4) == 2
    profiles = learn(docs.where(F.coalesce(~held, F.lit(True))))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(profiles.predictions(b.column(at)))
            yield b.filter(pa.array([lang != UND and s >= min_score for lang, s in got], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
