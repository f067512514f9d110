"""Secrets found by rules (regular expressions) through a trigram inverted index.

The index is partitioned by documents: a shard of bounded bytes has a posting list for each trigram of its texts, as local numbers or, where
shorter, a bitmap. Trigrams are three bytes of UTF-8 with A-Z lower-cased. From each rule a Boolean query is derived: literals, small
classes and alternatives make strings, strings make conjunctions of trigrams, alternatives make disjunctions; anything else asks for nothing.
A search reads the postings of the rules' trigrams only (Parquet skips the others), intersects and unites them shard by
shard, and verifies each rule on whole texts of its candidates. Rules without a mandatory trigram scan every text.

Only documents that the index may mean are brought together with its answer; a bitmap of fixed size tells the others apart before
anything is shuffled. A text of any length is indexed in pieces that overlap by two bytes.

Null texts are empty and have no spans. Rows without a doc_id can't be named by the index, and are verified by all rules. Rows that repeat
a doc_id are candidates together and verified each for itself. Spans count code points; those of a rule don't overlap, those of several may. Other columns are ignored.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import discard, fresh_path, maybe_among, tidy, tidy_group

#: Bytes and documents of a shard, at most, but for a longer text that is a shard alone.
SHARD_BYTES, SHARD_DOCS = 1 << 23, 1 << 15
#: Bytes of a text whose trigrams are taken at once.
PIECE = 1 << 22
#: Strings that a part of an expression may stand for before it is taken apart; characters of a class that counts as alternatives.
MOST_STRINGS, MOST_CLASS = 64, 8

# Boolean queries: True (anything may match), a trigram's code, ("and", queries) or ("or", queries).
Query = bool | int | tuple


def both(queries) -> Query:
    parts = {q for q in queries if q is not True}
    flat = {x for q in parts for x in (q[1] if isinstance(q, tuple) and q[0] == "and" else (q,))}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", tuple(sorted(flat, key=repr)))


def either(queries) -> Query:
    parts = {*queries}
    if True in parts or not parts:
        return True
    terms = {p: {*p[1]} if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts}
    parts = {p for p, x in terms.items() if not any(y < x for y in terms.values())}  # what another one implies is dropped
    return next(iter(parts)) if len(parts) == 1 else ("or", tuple(sorted(parts, key=repr)))


def code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


def of_strings(strings: set[bytes]) -> Query:
    """Texts with one of these strings in them."""
    return either(both(code(s[i : i + 3]) for i in range(len(s) - 2)) for s in strings)


@dataclass
class Part:
    """Of a part of an expression: the strings it may match, if these are few, and what any match needs otherwise."""

    strings: set[bytes] | None
    needs: Query = True

    def query(self) -> Query:
        return self.needs if self.strings is None else of_strings(self.strings)


UNKNOWN = Part(None)
NOTHING = Part({b""})


def _characters(items, flags: int) -> set[bytes] | None:
    """Folded characters of a class; None if they are many or not known."""
    out = set()
    for kind, arg in items:
        if kind is op.LITERAL:
            out.add(_fold(arg))
        elif kind is op.RANGE and arg[1] - arg[0] < 4 * MOST_CLASS:
            out |= {_fold(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _fold(char: int) -> bytes:
    return chr(char).encode("utf-8", "surrogatepass").lower()


def _sequence(items, flags: int) -> Part:
    needs, run = [], {b""}
    whole = True
    for item in items:
        part = _part(*item, flags)
        if part.strings is not None and len(run) * len(part.strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in part.strings}
            continue
        whole = False
        needs.append(of_strings(run))
        run = {b""}
        if part.strings is not None and len(part.strings) <= MOST_STRINGS:
            run = part.strings
        else:
            needs.append(part.query())
    return Part(run) if whole else Part(None, both([*needs, of_strings(run)]))


def _part(kind, arg, flags: int) -> Part:
    if kind is op.LITERAL:
        return Part({_fold(arg)})
    if kind is op.IN:
        found = _characters(arg, flags)
        return UNKNOWN if found is None else Part(found)
    if kind is op.SUBPATTERN:
        return _sequence(arg[3], flags)
    if kind is op.ATOMIC_GROUP:
        return _sequence(arg, flags)
    if kind is op.BRANCH:
        parts = [_sequence(x, flags) for x in arg[1]]
        if all(p.strings is not None for p in parts) and sum(len(p.strings) for p in parts) <= MOST_STRINGS:
            return Part(set().union(*(p.strings for p in parts)))
        return Part(None, either(p.query() for p in parts))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = arg
        part = _sequence(inner, flags)
        if least == 0:
            return Part(part.strings | {b""}) if most == 1 and part.strings is not None else UNKNOWN
        if least == most == 1:
            return part
        return Part(None, part.query())
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return NOTHING  # no width: what stands before and after it is adjacent
    return UNKNOWN


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost first, of which ``group`` has at least ``least`` code points.

    Only ASCII letters have two cases under (?i).
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    query: Query = field(init=False, default=True, compare=False)

    def __post_init__(self) -> None:
        tree = parser.parse(self.pattern, re.ASCII)
        object.__setattr__(self, "query", _sequence(tree, tree.state.flags).query())

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


def trigrams_of(query: Query) -> set[int]:
    if isinstance(query, tuple):
        return set().union(*(trigrams_of(q) for q in query[1]))
    return set() if query is True else {query}


def text_codes(text: bytes) -> np.ndarray:
    """Distinct trigrams of a text, ascending."""
    found = []
    for at in range(0, max(1, len(text) - 2), PIECE):
        x = np.frombuffer(text[at : at + PIECE + 2].lower(), np.uint8).astype(np.int32)
        if len(x) >= 3:
            found.append(np.unique(x[:-2] << 16 | x[1:-1] << 8 | x[2:]))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


INDEX = "shard long, trigram int, n int, postings binary, ids array<long>"
_INDEX_TYPES = [("shard", pa.int64()), ("trigram", pa.int32()), ("n", pa.int32()), ("postings", pa.binary()), ("ids", pa.list_(pa.int64()))]


def _shard(number: int, ids: list, codes: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of a shard: its doc_ids under trigram -1, then a posting list for each trigram, ascending."""
    n = len(ids)
    doc = np.repeat(np.arange(n, dtype=np.int64), [len(c) for c in codes])
    key = np.sort(np.concatenate(codes).astype(np.int64) << 16 | doc) if n else np.zeros(0, np.int64)
    doc, tri = (key & 0xFFFF).astype(np.uint16), key >> 16
    first = np.flatnonzero(np.diff(tri, prepend=-1))
    size = np.diff(first, append=len(tri))
    bitmap = -(-n // 8)
    dense = 2 * size > bitmap
    postings = []
    for i, k, d in zip(first.tolist(), size.tolist(), dense.tolist()):
        x = doc[i : i + k]
        if d:
            bits = np.zeros(n, bool)
            bits[x] = True
            postings.append(np.packbits(bits, bitorder="little").tobytes())
        else:
            postings.append(x.tobytes())
    cols = [[number] * (len(first) + 1), [-1, *tri[first].tolist()], [n, *size.tolist()], [b"", *postings], [ids, *[None] * len(first)]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _INDEX_TYPES)], [c for c, _ in _INDEX_TYPES])


def _members(postings: bytes, n: int, docs: int) -> np.ndarray:
    """A posting list as a vector of booleans."""
    if len(postings) == 2 * n:
        out = np.zeros(docs, bool)
        out[np.frombuffer(postings, np.uint16)] = True
        return out
    return np.unpackbits(np.frombuffer(postings, np.uint8), count=docs, bitorder="little").astype(bool)


def build_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the trigram index of ``docs`` (doc_id, text) to ``path``; the rows read back are what ``candidates`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, codes, held = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                raw = text.as_buffer()
                size = raw.size if raw is not None else 0
                if ids and (held + size > SHARD_BYTES or len(ids) >= SHARD_DOCS):
                    yield _shard(number, ids, codes)
                    ids, codes, held, number = [], [], 0, number + 1
                if doc_id.is_valid and size:
                    ids.append(doc_id.as_py())
                    codes.append(text_codes(raw.to_pybytes()))
                    held += size
        if ids:
            yield _shard(number, ids, codes)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts.mapInArrow(tidy(run), INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


def answer(query: Query, members: dict[int, np.ndarray], docs: int) -> np.ndarray:
    """Which of a shard's documents satisfy a Boolean query."""
    if query is True:
        return np.ones(docs, bool)
    if isinstance(query, tuple):
        parts = (answer(q, members, docs) for q in query[1])
        return np.logical_and.reduce([*parts]) if query[0] == "and" else np.logical_or.reduce([*parts])
    return members.get(query, np.zeros(docs, bool))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, mask): bit i of mask says that rule i may match; rules without a query are left out."""
    wanted = sorted(set().union(*(trigrams_of(r.query) for r in rules)))

    def run(key, table):
        tri, n, postings = (table[c].to_pylist() for c in ("trigram", "n", "postings"))
        at = tri.index(-1)
        ids = table["ids"][at].values
        members = {t: _members(p, k, len(ids)) for t, k, p in zip(tri, n, postings) if t >= 0}
        mask = np.zeros(len(ids), np.int64)
        for i, r in enumerate(rules):
            if r.query is not True:
                mask |= answer(r.query, members, len(ids)).astype(np.int64) << i
        hit = np.flatnonzero(mask)
        return pa.table({"doc_id": ids.take(pa.array(hit)), "mask": pa.array(mask[hit])})

    rows = index.where(F.col("trigram").isin([-1, *wanted]))
    found = rows.groupBy("shard").applyInArrow(tidy_group(run), "doc_id long, mask long")
    return found.groupBy("doc_id").agg(F.bit_or("mask").alias("mask"))


def scan(docs: DataFrame, rules: list[Rule], index: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans: array<struct<kind, start, end>>) of every row, by start, then rules' order.

    ``index`` is one that ``build_index`` wrote of the same rows, or else is built and discarded.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules at a time")
    if any(re.search(r"\(\?[a-zA-Z]*[uL]", r.pattern) for r in rules):
        raise ValueError("rules match by ASCII; (?u) and (?L) aren't known")
    path = None
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if index is None:
        path = fresh_path(docs.sparkSession, "trigrams")
        index = build_index(texts, path)
    hits_path = fresh_path(docs.sparkSession, "candidates")
    candidates(index, rules).write.parquet(hits_path)
    hits = docs.sparkSession.read.schema("doc_id long, mask long").parquet(hits_path)
    if path:
        index._atomweave_path = path
        discard(index)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    always = sum(1 << i for i, r in enumerate(rules) if r.query is True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, mask in zip(b.column(1), b.column(2).to_pylist()):
                text, mask = text.as_py() or "", mask | always
                found = [(s, i, e) for i, r in enumerate(rules) if mask >> i & 1 for s, e in r.spans(text)]
                out.append([{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in sorted(found)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    told = maybe_among(texts, "doc_id", hits.select("doc_id"))
    every = F.lit((1 << len(rules)) - 1)
    rest = told.where("NOT maybe").select("doc_id", "text", F.when(F.col("doc_id").isNull(), every).otherwise(0).cast("long").alias("mask"))
    meant = told.where("maybe").join(hits, "doc_id", "left").select("doc_id", "text", F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))
    return rest.union(meant).mapInArrow(tidy(run), "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
