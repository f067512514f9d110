"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one class, so copies count once. Similar classes are put into groups, and a group
is cut into blocks of bounded size. The matrix has a row of bits for each class, a bit for each cell of a hashed token space of at least two
cells a token, and for each block the union of its rows. A query class closes a block when too many of its bits are missing
from the union: each missing bit is a token that no class in the block has, so fewer than t * |query| tokens can be shared.
In an opened block each row is held against the query's in the same way: cells that differ number no more than the tokens that
differ. Only for pairs that pass both bounds are texts brought together, and the threshold is tested on whole sets, in integers.

Which queries meet which groups is decided without loss by segments: a set's tokens are dealt by hash to d + r segments,
where d is the largest symmetric difference that a linked pair of these sizes can have and r grows with it, so linked sets agree in r
whole segments or more. Sizes fall into classes of ratio t; a set is dealt once for its own class and once for the class
below, where its smaller partners are. Empty segments are only kept where a linked pair may agree in nothing else, and lower what
is asked of a set otherwise. A class that has fewer segments in common with all others together than linked ones must have leaves at once, and
a query meets a block only if as many of its segments are in the block's union. So frequent words, lines and passages alone bring few
documents together.

Two rounds bound the work in large groups of near copies. First every class queries one block of its own group. The
links found make components; second, only classes that share a segment across different components are compared, each against
blocks that hold a larger component (by number of classes, then id): of two components the smaller asks, the same way round in all segments, so
members of a large group of near copies don't all ask for the few that aren't in it. What is left out could not change any component, so components are exact.

Sets are 64-bit hashes of shingles and classes 128-bit hashes of sets. Empty sets (no words, empty or null text) link with nothing. Rows that
repeat a doc_id are nodes of their own with that id; null doc_ids are never a component's id unless it has no other.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atomweave.llm.common import discard, materialise, maybe_among, tidy, tidy_group
from atomweave.llm.components import components
from atomweave.llm.shingles import mix, shingle_sets

#: Classes of a block and queries of a unit: at most so many, and fewer where their rows of bits are long.
BLOCK, BLOCK_BITS, LEAST = 512, 1 << 24, 8
#: Parts over which a join deals a key that has many rows.
SALTS = 16
#: Segment hashes that one task brings together, about; those that a task gathers before it sorts and passes them on.
RANGE_SEGMENTS, HELD_SEGMENTS = 500_000, 1 << 20
#: Documents of a list in one row.
CHUNK = 4096


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den."""

    num: int
    den: int = 100

    def linked(self, both: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)

    def size_class(self, n: int) -> int:
        """Class c holds sizes from top(c - 1) + 1 to top(c)."""
        c = int(np.log(n) / np.log(self.den / self.num))
        while self.top(c) < n:
            c += 1
        while c > 0 and self.top(c - 1) >= n:
            c -= 1
        return c

    def top(self, c: int) -> int:
        return int((self.den / self.num) ** c + 1e-9)

    def differences(self, n: int) -> int:
        """Largest symmetric difference between a set of n and a linked one no smaller."""
        most = n * self.den // self.num  # the largest linked size
        return max((n + b) - 2 * -(-self.num * (n + b) // (self.num + self.den)) for b in range(max(n, most - 6), most + 1))


#: One more segment must be alike for as many tokens that may differ.
SPARE = 8
SEGMENT_SEED = np.uint64(0x5851F42D4C957F2D)
_LEVELS: dict[tuple[Threshold, int], tuple[int, int]] = {}


def _segments_of(t: Threshold, c: int) -> tuple[int, int]:
    """For pairs whose smaller set is of class c: how many segments, and how many of them are alike at least."""
    if (t, c) not in _LEVELS:
        low, top = t.top(c - 1) + 1 if c else 1, t.top(c)
        sizes = range(max(low, top - 64), top + 1)  # the bound grows with n but for rounding
        most = max((t.differences(n) for n in sizes), default=0)
        _LEVELS[t, c] = most + 1 + most // SPARE, 1 + most // SPARE
    return _LEVELS[t, c]


def _levels(n: int, t: Threshold) -> list[int]:
    """A set's own class and the class below, if a partner may be there."""
    c = t.size_class(n)
    return [x for x in ((c, c - 1) if c else (c,)) if t.top(x) >= 1 and not (x < c and n > t.top(x) * t.den // t.num)]


def _dealt_tokens(tokens: np.ndarray, k: int) -> np.ndarray:
    return (mix(tokens ^ SEGMENT_SEED) % np.uint64(k)).astype(np.int64)


def needs_of(tokens: np.ndarray, t: Threshold) -> tuple[int, int, int]:
    """A set's class, and how many segments it has in common with a linked set at least, at its class and below (0: none is there)."""
    levels, c = _levels(len(tokens), t), t.size_class(len(tokens))
    out = {}
    for level in levels:
        k, alike = _segments_of(t, level)
        out[level] = max(1, alike - (k - len(np.unique(_dealt_tokens(tokens, k)))))
    return c, out.get(c, 0), out.get(c - 1, 0)


def segment_signatures(tokens: np.ndarray, t: Threshold) -> np.ndarray:
    """Hashes (level, segment, tokens in it) of a set, for its class and the class below; the low byte is the level's."""
    out = [np.zeros(0, np.uint64)]
    for level in _levels(len(tokens), t) if len(tokens) else ():
        k, alike = _segments_of(t, level)
        seg = _dealt_tokens(tokens, k)
        total = np.zeros(k, np.uint64)
        np.add.at(total, seg, mix(tokens + np.uint64(0x632BE59BD9B4E019)))
        empty = np.bincount(seg, minlength=k) == 0
        keep = ~empty if np.count_nonzero(empty) < alike else np.ones(k, bool)  # else all that are alike can be empty
        tag = np.arange(k, dtype=np.uint64) + np.uint64(level << 40)
        out.append((mix(mix(tag) ^ total)[keep] & ~np.uint64(0xFF)) | np.uint64(level & 0xFF))
    return np.concatenate(out)


def set_hashes(x: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, as signed 64-bit numbers."""
    both = np.array([mix(x + np.uint64(1)).sum(dtype=np.uint64), mix(x + np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)], np.uint64)
    return tuple(both.view(np.int64).tolist())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def level_of(n: int) -> int:
    """Rows of bits have two to the level cells, at least two for each of n tokens."""
    return max(6, (2 * n - 1).bit_length())


def bits_of(x: np.ndarray) -> bytes:
    cells = np.zeros(1 << level_of(len(x)), bool)
    cells[(x & np.uint64(len(cells) - 1)).astype(np.int64)] = True
    return np.packbits(cells, bitorder="little").tobytes()


SETS = ["doc_id", "n_shingles", "s1", "s2", "size_class", "need", "need_below", "bits"]


def sets_of(docs: DataFrame, t: Threshold, width: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, size_class, need, need_below, bits) of every row: set size, two hashes of the set, see ``needs_of``, its row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(len(x), *set_hashes(x), *(needs_of(x, t) if len(x) else (0, 0, 0)), bits_of(x) if len(x) else None) for x in shingle_sets(b.column(1), width)]
            cols = list(zip(*got)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.binary())], SETS)

    return _texts(docs).mapInArrow(tidy(run), ", ".join(f"{c} long" for c in SETS[:-1]) + ", bits binary")


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers as eight byte planes, which compress well where high bytes repeat."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def segment_lists(docs: DataFrame, t: Threshold, width: int, ranges: int) -> DataFrame:
    """(list, low, times, width, chunk, docs): the ``width`` doc_ids that have ``times`` segments in common, in chunks; low is the low byte of the segments' level.

    Segment hashes go to ranges in sorted blocks, not as rows. A task passes on a set once, however many of
    its rows have it, so a range gets of a group of copies no more than one for each flush of a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sigs: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def blocks() -> pa.RecordBatch:
            sig, doc = np.concatenate(sigs), np.concatenate(ids)
            o = np.argsort(sig)
            sig, doc = sig[o], doc[o]
            at = ((sig >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            edges = np.searchsorted(at, np.arange(ranges + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(edges))
            step = np.diff(sig, prepend=np.uint64(0))
            out = [], []
            for r in full:
                i, j = edges[r], edges[r + 1]
                d = step[i:j].copy()
                d[0] = sig[i]
                out[0].append(_planes(d))
                out[1].append(_planes(doc[i:j]))
            sigs.clear()
            ids.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], ["range", "sigs", "docs"])

        held = 0
        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), shingle_sets(b.column(1), width)):
                key = set_hashes(x)
                if doc_id is None or not len(x) or key in seen:
                    continue
                seen.add(key)
                sig = segment_signatures(x, t)
                sigs.append(sig)
                ids.append(np.full(len(sig), doc_id, np.int64))
                held += len(sig)
                if held >= HELD_SEGMENTS:
                    yield blocks()
                    held = 0
        if held:
            yield blocks()

    def meet(key, table):
        sig = np.concatenate([np.cumsum(_from_planes(x), dtype=np.uint64) for x in table["sigs"].to_pylist()])
        doc = np.concatenate([_from_planes(x).view(np.int64) for x in table["docs"].to_pylist()])
        o = np.lexsort((doc, sig))
        sig, doc = sig[o], doc[o]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
        sig, doc = sig[fresh], doc[fresh]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(first, append=len(sig))
        low = sig[first] & np.uint64(0xFF)
        name = mix(mix(np.add.reduceat(mix(doc.view(np.uint64) + np.uint64(0x9FB21C651E98DF25)), first) + size.astype(np.uint64)) + low)
        first, size, name = first[size > 1], size[size > 1], name[size > 1]
        name, at, times = np.unique(name, return_index=True, return_counts=True)
        first, size = first[at], size[at]
        low = (sig[first] & np.uint64(0xFF)).astype(np.int64)
        # a list is cut into chunks, so no cell grows with a group of copies
        chunks = -(-size // CHUNK)
        row = np.repeat(np.arange(len(size)), chunks)
        chunk = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = first[row] + chunk * CHUNK
        held = np.minimum(size[row] - chunk * CHUNK, CHUNK)
        upto = np.concatenate([[0], np.cumsum(held)])
        flat = doc[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], held)]
        values = {"list": name.view(np.int64)[row], "low": low[row], "times": times.astype(np.int64)[row], "width": size[row], "chunk": chunk}
        return pa.table({**{k: pa.array(v.astype(np.int64)) for k, v in values.items()}, "docs": pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))})

    return _texts(docs).mapInArrow(tidy(cut), "range int, sigs binary, docs binary").groupBy("range").applyInArrow(tidy_group(meet), "list long, low long, times long, width long, chunk long, docs array<long>")


class _Union:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    """Rows of bits over a smaller token space."""
    while rows.shape[-1] > words:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] | rows[..., half:]
    return rows


class Block:
    """Rows of the matrix and their union."""

    def __init__(self, bits: list[bytes], sizes: np.ndarray, t: Threshold):
        self.t, self.sizes = t, sizes
        self.rows = {0: np.array([np.frombuffer(x, np.uint64) for x in bits]).reshape(len(bits), -1)}
        self.words = self.rows[0].shape[1]

    def folded(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        if words not in self.rows:
            rows = _fold(self.rows[0], words)
            self.rows[words] = rows, ~np.bitwise_or.reduce(rows, 0)
        return self.rows[words]

    def closed(self, q: np.ndarray, n: int) -> bool:
        """No class of the block can be linked with a query of n tokens: too many lie outside the union."""
        words = min(self.words, len(q))
        missing = int(np.bitwise_count(_fold(q, words) & self.folded(words)[1]).sum())
        return self.t.den * (n - missing) < self.t.num * n

    def near(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of an opened block: which classes can be linked with the query, and the least number of tokens that differ."""
        words = min(self.words, len(q))
        differ = np.bitwise_count(self.folded(words)[0] ^ _fold(q, words)).sum(1, dtype=np.int64)
        both = self.sizes + n  # of a + b tokens, d of which differ, (a + b - d) / 2 are shared
        return np.flatnonzero(self.t.den * (both - differ) >= self.t.num * (both + differ)), differ


UNIT = ["gid", "level", "block", "salt"]


def open_blocks(units: DataFrame, t: Threshold) -> DataFrame:
    """(unit, rid, s1, component, member, others): of each unit's queries those with a class that both bounds let pass, and those classes.

    units: (unit, rid, s1, n, bits, component, member, query). ``others`` holds a query's classes, nearest first; it is empty
    for what is member only.
    """
    kind = pa.list_(pa.int64())

    def run(key, table):
        rid, s1, n, component = (table[c].to_numpy() for c in ("rid", "s1", "n", "component"))
        bits = table["bits"].to_pylist()
        is_member, is_query = (table[c].to_numpy() for c in ("member", "query"))
        rows = np.flatnonzero(is_member)
        wanted, others = np.zeros(len(rid), bool), {}
        if len(rows):
            block = Block([bits[i] for i in rows], n[rows], t)
            for i in np.flatnonzero(is_query):
                q = np.frombuffer(bits[i], np.uint64)
                if block.closed(q, int(n[i])):
                    continue
                m, differ = block.near(q, int(n[i]))
                m = m[component[rows[m]] != component[i]]
                if len(m):
                    m = m[np.argsort(differ[m], kind="stable")]
                    wanted[rows[m]] = True
                    others[i] = rid[rows[m]].tolist()
        out = np.flatnonzero(wanted | np.isin(np.arange(len(rid)), list(others)))
        cols = [pa.array([k.as_py()] * len(out), f) for k, f in zip(key, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
        return pa.table([*cols, pa.array(rid[out]), pa.array(s1[out]), pa.array(component[out]), pa.array(wanted[out]), pa.array([others.get(i, []) for i in out.tolist()], kind)], [*UNIT, "rid", "s1", "component", "member", "others"])

    return units.groupBy(*UNIT).applyInArrow(tidy_group(run), "gid long, level int, block int, salt int, rid long, s1 long, component long, member boolean, others array<long>")


def verify(opened: DataFrame, docs: DataFrame, t: Threshold, width: int) -> DataFrame:
    """Links (a, b) of opened units by whole sets; links that join nothing new within a unit are left out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rid"), F.col("text").cast("string").alias("text"))
    texts = maybe_among(texts, "rid", opened.select("rid").distinct()).where("maybe").drop("maybe")

    def run(key, table):
        members: dict[int, np.ndarray] = {}
        queries: dict[int, tuple[np.ndarray, list[int]]] = {}
        text = pa.concat_arrays(table["text"].chunks)
        of: dict[int, int] = {}
        for rid, s1, component, member, others, x in zip(*(table[c].to_pylist() for c in ("rid", "s1", "component", "member", "others")), shingle_sets(text, width)):
            if len(x) and set_hashes(x)[0] == s1:  # of rows that repeat the id, the one meant
                of[rid] = component
                if member:
                    members[rid] = x
                if others:
                    queries[rid] = x, others
        union, out = _Union(), []
        for rid in sorted(queries):
            x, others = queries[rid]
            for other in others:
                if union.find(of[rid]) == union.find(of[other]):
                    continue
                y = members[other]
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                if t.linked(np.count_nonzero(y[at] == x), len(x), len(y)):
                    union.join(of[rid], of[other])
                    out.append((rid, other))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return opened.join(texts, "rid").groupBy(*UNIT).applyInArrow(tidy_group(run), "a long, b long")


def per_unit() -> F.Column:
    """Rows of a block or unit by level."""
    return F.greatest(F.lit(LEAST), F.least(F.lit(BLOCK), F.expr(f"shiftright({BLOCK_BITS}, level)")))


def dealt(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """``rows`` with the number of units that the rows of their key fill. The join is salted: a key may have any share of the rows."""
    many = rows.groupBy(*key).agg(F.ceil(F.count("*") / F.first(per_unit())).cast("int").alias(name)).where(F.col(name) > 1)
    many = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(SALTS)).cast("int")).join(many, [*key, "_salt"], "left")
    return out.withColumn(name, F.coalesce(name, F.lit(1))).drop("_salt")


def salted(entries: DataFrame) -> DataFrame:
    """Entries (list, width, rid ...) with a salt, other than 0 only in lists that are wider than a block."""
    return entries.withColumn("salt", F.when(F.col("width") > BLOCK, F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(SALTS))).otherwise(0).cast("int"))


def for_salts(lists: DataFrame) -> DataFrame:
    """Rows (list, width ...) once for each salt of their list."""
    return lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("width") > BLOCK, SALTS - 1).otherwise(0))))


def with_sizes(rows: DataFrame) -> DataFrame:
    """``rows`` (rid, component ...) with their component's number of rows as ``size``. Salted: a component may have any share of the rows."""
    many = rows.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    many = many.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(SALTS)).cast("int")).join(many, ["component", "_salt"], "left")
    return out.withColumn("size", F.coalesce("size", F.lit(1))).drop("_salt")


def part(seed: int, parts: str) -> F.Column:
    return F.pmod(F.xxhash64("rid", F.lit(seed)), F.col(parts)).cast("int")


def similar_components(docs: DataFrame, threshold: Threshold = Threshold(90), width: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    rows = materialise(sets_of(docs, threshold, width), "sets")
    needs = ["size_class", "need", "need_below"]
    classes = rows.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rid"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in needs)).where("rid IS NOT NULL")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    per_token = 2.5 * (threshold.den - threshold.num) / threshold.den
    ranges = max(1, math.ceil(total * per_token / RANGE_SEGMENTS))
    lists = materialise(segment_lists(docs, threshold, width, ranges), "segment-lists")
    # equal lists of all ranges are one
    lists = lists.groupBy("list", "low", "width", "chunk").agg(F.sum("times").alias("times"), F.first("docs").alias("docs"))
    entries = lists.select("list", "low", "times", "width", F.explode("docs").alias("doc_id"))
    # by class; a segment that only copies share says nothing
    who = entries.select("doc_id").distinct().join(rows.select("doc_id", "s1", "s2"), "doc_id").join(classes, ["s1", "s2"]).select("doc_id", "rid", "s1", "n", *needs).distinct()
    need = F.when(F.col("low") == F.col("size_class") % 256, F.col("need")).otherwise(F.col("need_below")).alias("need")
    named = entries.join(who, "doc_id").select("list", "low", "times", "width", "rid", "s1", "n", need).distinct()
    key = ["list", "width", "salt"]
    entries = materialise(named, "named-segments")
    for _ in range(2):  # what can't be linked with anything leaves, and then what only met that
        several = entries.groupBy("list", "width").agg(F.min("rid").alias("lead"), F.max("rid").alias("last")).where("lead < last").select("list", "width")
        met = salted(entries).join(for_salts(several), key).drop("salt")
        enough = met.groupBy("rid", "s1", "low").agg(F.sum("times").alias("all"), F.first("need").alias("least")).where("all >= least").select("rid", "s1", "low")
        entries = materialise(met.join(enough, ["rid", "s1", "low"]), "met-segments")
    several = entries.groupBy("list", "width").agg(F.min("rid").alias("lead"), F.max("rid").alias("last")).where("lead < last").select("list", "width", "lead")
    shared = materialise(salted(entries).join(for_salts(several), key).drop("salt"), "shared-segments")

    member = shared.groupBy("rid", "s1").agg(F.min("lead").alias("gid"), F.first("n").alias("n"))
    bits = rows.select(F.col("doc_id").alias("rid"), "s1", "bits")
    member = member.join(bits, ["rid", "s1"]).groupBy("rid", "s1").agg(*(F.first(c).alias(c) for c in ("gid", "n", "bits")))
    member = materialise(member.withColumn("level", F.round(F.log2(F.octet_length("bits") * 8)).cast("int")), "members")
    matrix = materialise(dealt(member, ["gid", "level"], "blocks").withColumn("block", part(1, "blocks")), "matrix")
    discard(member)

    # each class is sent to one unit, those of the first block to all units of the group
    first = matrix.where("block > 0").select("gid", "level", F.lit(0).alias("block"), F.col("block").alias("salt"), "rid", "s1", "n", "bits", F.lit(False).alias("member"), F.lit(True).alias("query"))
    first = first.union(matrix.where("block = 0").select("gid", "level", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), "rid", "s1", "n", "bits", F.lit(True).alias("member"), F.lit(True).alias("query")).withColumn("query", F.col("salt") == 0))
    opened = materialise(open_blocks(first.withColumn("component", F.col("rid")), threshold), "opened")
    links = verify(opened, docs, threshold, width)
    several = rows.where("n_shingles > 0").groupBy("doc_id").agg(F.min("s1").alias("x"), F.max("s1").alias("y")).where("x <> y").select("doc_id")
    same = rows.join(several, "doc_id").join(classes.select("s1", "s2", "rid"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rid").alias("b"))
    links = materialise(links.union(same), "links")
    found = materialise(components(links), "components")
    discard(opened)

    stored, matrix = matrix, matrix.join(found.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    place = with_sizes(matrix.select("rid", "s1", "n", "gid", "level", "block", "component"))
    placed = salted(shared.select("list", "low", "times", "width", "rid", "s1", "need").join(place, ["rid", "s1"]))
    mixed = placed.groupBy("list", "width").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("list", "width")
    placed = materialise(placed.join(for_salts(mixed), key), "mixed-segments")
    group, block = ["gid", "level"], ["gid", "level", "block"]
    order = F.struct("size", "component")
    bounds = F.max(order).alias("top"), F.min("n").alias("least_n"), F.max("n").alias("most_n")
    p, q = threshold.num, threshold.den
    larger = f"own < top AND n * {p} <= most_n * {q} AND least_n * {p} <= n * {q}"  # it holds a larger component, and sizes that can be linked
    # a class meets a group once a segment; only if enough of its segments are anywhere in the group, it meets the group's blocks
    targets = placed.groupBy("list", "width", *group).agg(*bounds)
    met = (
        placed.select(*key, "low", "times", "need", "rid", "s1", "n", order.alias("own"))
        .join(for_salts(targets), key)
        .where(larger)
        .groupBy("rid", "s1", *group, "low")
        .agg(F.sum("times").alias("alike"), F.first("need").alias("least"), F.first("n").alias("n"), F.first("own").alias("own"))
        .where("alike >= least")
        .groupBy("rid", "s1", *group)
        .agg(F.first("n").alias("n"), F.first("own").alias("own"))
    )
    met = materialise(met.withColumn("salt", F.pmod(F.xxhash64("rid", F.lit(13)), F.lit(SALTS)).cast("int")), "met-groups")
    blocks = place.groupBy(*block).agg(*bounds).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = met.join(blocks, [*group, "salt"]).where(larger).select("rid", "s1", *block)
    pairs = materialise(dealt(materialise(pairs, "pairs"), block, "salts"), "dealt-pairs")
    row = ["rid", "s1", "n", "bits", "component"]
    queries = pairs.withColumn("salt", part(3, "salts")).join(matrix.select(*row), ["rid", "s1"]).select(*UNIT, *row, F.lit(False).alias("member"), F.lit(True).alias("query"))
    loads = pairs.groupBy(*block).agg(F.max("salts").alias("salts"))
    members = matrix.join(loads, block).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*UNIT, *row, F.lit(True).alias("member"), F.lit(False).alias("query"))
    opened = materialise(open_blocks(queries.union(members), threshold), "opened")
    links2 = materialise(links.union(verify(opened, docs, threshold, width)), "links")
    final = components(links2).select(F.col("node").alias("rid"), "component")
    known = classes.select("s1", "s2", "rid").join(final, "rid", "left").select("s1", "s2", F.coalesce("component", "rid").alias("component_id"))
    # copies of one class may be a third of all rows: the class table is salted against them
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.select("doc_id", "n_shingles", "s1", "s2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")).join(known, ["s1", "s2", "salt"], "left")
    out = materialise(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "component-ids")
    discard(rows, shared, stored, links, found, placed, met, pairs, opened, links2)
    return out


def one_of_each(docs: DataFrame, threshold: Threshold = Threshold(80), width: int = 5) -> DataFrame:
    """Rows of docs, all columns as they are, of one document of each component: the one with the smallest doc_id.

    Rows without a doc_id stay, and so do all rows of a staying doc_id.
    """
    gone = similar_components(docs, threshold, width).where("doc_id <> component_id").select("doc_id").distinct()
    names = docs.columns
    told = maybe_among(docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("id")), "id", gone)
    stay = told.where("NOT maybe").select("row").union(told.where("maybe").join(gone.withColumnRenamed("doc_id", "id"), "id", "left_anti").select("row"))
    return stay.select("row.*")
