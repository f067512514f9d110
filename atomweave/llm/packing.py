"""Vector bin packing of token pieces by the dot-product heuristic.

A document's ids are cut into pieces of at most ``capacity`` tokens: whole-capacity pieces from its start and
one remainder. Pieces are then placed into sequences (bins) that are limited at once in tokens, in segments and
in loss-bearing tokens. A bin is filled greedily: of the pieces that still fit in every dimension, the one
whose demand has the largest dot product with the bin's remaining capacity (both scaled by the limits)
is placed next; ties go to more tokens, then to the smaller (doc_id, start).

Pieces are dealt into shards of a bounded number of pieces by a hash of (doc_id, start); a shard is packed
by one task from its lengths alone, so nothing grows with the input but the number of shards. Only digests
of ids leave the tokenising stage.

Nulls count as empty text; every document has at least its end id. Repeated rows are packed each on its own.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import materialise, tidy

#: Words that a worker remembers, about; those of the slice at hand stay.
MEMO_WORDS = 250_000
MARKS = ".,;:!?"
#: A word of letters with one mark after them at most.
LETTERS = r"^\p{L}+[.,;:!?]?$"
#: Bytes of text whose words are told apart at once; a longer text is taken alone.
SLICE = 2 << 20
#: Pieces that one task packs; more pieces make more shards.
SHARD_PIECES = 20_000


@dataclass(frozen=True)
class Limits:
    """Per sequence: tokens, segments, loss-bearing tokens."""

    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


class WordTokenizer:
    """Ids of whole texts by a tokenizers file that drops white space.

    No token spans white space, so a text's ids are those of its words in a row. A slice of texts is split and
    dictionary-encoded as columns; each distinct word is taken apart into letters and one mark after them, which are
    separate matches of the pre-tokenizer, and only letters that a worker has not seen are tokenised, many in one call. Words of
    another make are tokenised as they are. Both memos are bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        #: Ids that end a word: such an id closes each match of the pre-tokenizer.
        self.closes = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.closes[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.marks = [self._ids([m]) for m in MARKS]
        self.known: dict[str, int] = {}  # number of a run of letters, or of another word
        self.first = np.zeros(1, np.int64)  # where the ids of each begin
        self.flat = np.zeros(0, np.uint32)

    def _forget_all_but(self, words: list[str]) -> None:
        kept = [w for w in words if w in self.known]
        number = np.array([self.known[w] for w in kept], np.int64)
        size = self.first[number + 1] - self.first[number]
        self.flat = self.flat[spread(self.first[number], size)]
        self.first = np.concatenate([[0], np.cumsum(size)])
        self.known = dict(zip(kept, range(len(kept))))

    def _ids(self, texts: list[str]) -> np.ndarray:
        return np.array([i for e in self.tok.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)

    def _letters(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of runs of letters and how many each has, many at once in one text; each is one match of the pre-tokenizer."""
        ids, sizes = [], []
        for i in range(0, len(words), 2_000):
            part = words[i : i + 2_000]
            got = self._ids([" ".join(part)])
            ends = np.flatnonzero(self.closes[got]) + 1
            if len(ends) != len(part):  # a letter here that is none to the tokenizer
                each = [self._ids([w]) for w in part]
                got, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(got)
            sizes.append(np.diff(ends, prepend=0))
        return ids, sizes

    def _others(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        each = [e.ids for i in range(0, len(words), 2_000) for e in self.tok.encode_batch_fast(words[i : i + 2_000], add_special_tokens=False)]
        return [np.array([i for x in each for i in x], np.uint32)], [np.array([len(x) for x in each], np.int64)]

    def _numbers(self, words: list[str], learn) -> np.ndarray:
        """Numbers of words in the memo, which learns those that it lacks."""
        got = [self.known.get(w, -1) for w in words]
        new = [w for w, k in zip(words, got) if k < 0]
        if new:
            n = len(self.known)
            self.known.update(zip(new, range(n, n + len(new))))
            ids, sizes = learn(new)
            self.flat = np.concatenate([self.flat, *ids])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])
            got = [self.known[w] for w in words]
        return np.array(got, np.int64)

    def _table(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each distinct word begin (one more at the end), and the ids."""
        plain = _parted(words, pc.match_substring_regex(words, LETTERS))
        cores = pc.utf8_rtrim(words.filter(plain), MARKS)
        ascii_ = pc.string_is_ascii(cores)
        cores = pc.if_else(ascii_, pc.ascii_lower(cores), cores).dictionary_encode()
        is_plain = plain.to_numpy(zero_copy_only=False)
        letters, others = cores.dictionary.to_pylist(), words.filter(pc.invert(plain)).to_pylist()
        if len(self.known) + len(letters) + len(others) > MEMO_WORDS:
            self._forget_all_but(letters + others)
        number, mark = np.zeros(len(words), np.int64), np.full(len(words), -1)
        number[is_plain] = self._numbers(letters, self._letters)[cores.indices.to_numpy()]
        for k, m in enumerate(MARKS):
            mark[pc.ends_with(words, m).to_numpy(zero_copy_only=False) & is_plain] = k
        number[~is_plain] = self._numbers(others, self._others)
        size = self.first[number + 1] - self.first[number]
        more = np.array([len(x) for x in self.marks] + [0])[mark]
        start = np.concatenate([[0], np.cumsum(size + more)])
        ids = np.zeros(start[-1], np.uint32)
        ids[spread(start[:-1], size)] = self.flat[spread(self.first[number], size)]
        for k, x in enumerate(self.marks):
            for j in range(len(x)):
                ids[(start[:-1] + size)[mark == k] + j] = x[j]
        return start, ids

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, null as empty; white space is ASCII's here, a subset of what the tokenizer drops."""
        texts = texts.fill_null("")
        upto = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE, "right")))
            words = pc.ascii_split_whitespace(texts.slice(i, j - i))
            some = words.flatten().dictionary_encode()
            start, ids = self._table(some.dictionary)
            w = some.indices.to_numpy()
            size = np.diff(start)[w]
            flat = ids[spread(start[w], size)]
            at = np.concatenate([[0], np.cumsum(size)])[words.offsets.to_numpy() - words.offsets[0].as_py()]
            for a, b in zip(at, at[1:]):
                yield flat[a:b]
            i = j


def _parted(words: pa.StringArray, plain: pa.BooleanArray) -> pa.BooleanArray:
    """``plain`` without words such as ``İ.``: normalised, their last letter ends in a sign that is no letter and one match with the mark after it."""
    doubt = pc.and_(pc.and_(plain, pc.invert(pc.string_is_ascii(words))), pc.match_substring_regex(words, f"[{MARKS}]$"))
    odd = np.array([unicodedata.category(unicodedata.normalize("NFC", w[-2]).lower()[-1])[0] != "L" for w in words.filter(doubt).to_pylist()], bool)
    if not odd.any():
        return plain
    kept = plain.to_numpy(zero_copy_only=False).copy()
    kept[np.flatnonzero(doubt.to_numpy(zero_copy_only=False))[odd]] = False
    return pa.array(kept)


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1 ... of each in a row, as many as its size."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


PIECES = "doc_id long, start long, length long, loss_tokens long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Pieces of every document: (doc_id, start, length, loss_tokens, ids_crc32, doc_tokens).

    Loss-bearing are all ids but a document's first, which has nothing before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(tokenizer_file), np.array([end_id], np.uint32)
        for b in batches:
            rows: list[tuple] = []
            for d, ids in zip(b.column(0).to_pylist(), tok.encode(b.column(1))):
                ids = np.concatenate([ids, end])
                n = len(ids)
                for s in range(0, n, capacity):
                    part = ids[s : s + capacity]
                    rows.append((d, s, len(part), len(part) - (s == 0), zlib.crc32(part.astype("<u4", copy=False)), n))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "loss_tokens", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), PIECES)


def pack_shard(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece (given in tie order). Pieces alike in (tokens, loss) are taken in that order."""
    n = len(tokens)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 0:
        return bins, offsets
    if tokens.max() > limits.tokens or loss.max() > limits.loss_tokens:
        raise ValueError("a piece is over the limits of a sequence")
    kinds, kind = np.unique(np.stack([-tokens, -loss], 1), axis=0, return_inverse=True)
    kinds = -kinds
    kind = kind.ravel()
    order = np.argsort(kind, kind="stable")
    left = np.bincount(kind, minlength=len(kinds))
    start = np.concatenate([[0], np.cumsum(left)[:-1]])
    taken = np.zeros(len(kinds), np.int64)
    t, q = kinds[:, 0], kinds[:, 1]
    ft, fq = t / limits.tokens, q / max(1, limits.loss_tokens)
    todo, b = n, 0
    while todo:
        rt, rs, rq, at = limits.tokens, limits.segments, limits.loss_tokens, 0
        lo = int(np.argmax(left > 0))  # kinds before it are used up
        while rt and rs:
            i = max(lo, int(np.searchsorted(-t, -rt)))  # the first kind whose tokens fit
            fit = (left[i:] > 0) & (q[i:] <= rq)
            if not fit.any():
                break
            score = ft[i:] * (rt / limits.tokens) + fq[i:] * (rq / max(1, limits.loss_tokens)) + (1 / limits.segments) * (rs / limits.segments)
            k = i + int(np.argmax(np.where(fit, score, -1.0)))
            piece = order[start[k] + taken[k]]
            taken[k] += 1
            left[k] -= 1
            bins[piece], offsets[piece] = b, at
            at += int(t[k])
            rt, rs, rq, todo = rt - int(t[k]), rs - 1, rq - int(q[k]), todo - 1
        b += 1
    return bins, offsets


def pack(pieces: DataFrame, limits: Limits = Limits(), shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (as from ``cut``) with sequence_id and offset. ``pieces`` should be materialised: it is read twice."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(key, t):
        shard = key[0].as_py()
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = pack_shard(t["length"].to_numpy(), t["loss_tokens"].to_numpy(), limits)
        out = t.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array((shard << 32) + bins)).append_column("offset", pa.array(offsets))

    return pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards))).groupBy("shard").applyInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, tokenizer_file: str | None = None, end_id: int = 2, limits: Limits = Limits()) -> DataFrame:
    """Cut and pack all documents."""
    return pack(materialise(cut(docs, tokenizer_file or default_tokenizer(), end_id, limits.tokens), "pieces"), limits)
