"""Exact encoding with a merge-type (BPE) SentencePiece model by backtracking.

Merging is a local affair: a sequence of pieces is what repeated merging yields if and only if every
adjacent pair is (re-merging the pair's own text gives the pair back). So a text is encoded left to
right: take the longest piece that starts here (Aho-Corasick), accept it if it is compatible with the
piece before it, else try its next shorter prefix piece, else step back over the last piece and mark
this position failed in a bitfield, so that no position is given up twice. Characters without a piece
become their UTF-8 byte ids.

No piece continues past a white-space mark that follows another character, so texts are cut there and
a worker remembers the words it has encoded (the memo is bounded).

Nulls count as empty. An empty text has only the end id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # the model's white-space mark
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MEMO_WORDS = 200_000
PAIR_MEMO = 400_000
#: Words longer than this are encoded without being remembered.
MEMO_LENGTH = 64


class Encoder:
    """Encodes and decodes with the pieces of one model file (read with the sentencepiece library, used for the table only)."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.eos = sp.eos_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.surface: list[bytes | str] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append("")
            else:
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
                self.surface.append(piece.replace(MARK, " "))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on past a white-space mark; words can't be encoded one by one")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            # only pieces that merging can make: others never stand in a result
            if len(p) == 1 or self._merge(p) == [p]:
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        self.shorter: dict[str, str | None] = {}
        for p in self.automaton:
            q = p[:-1]
            while q and not self.automaton.exists(q):
                q = q[:-1]
            self.shorter[p] = q or None
        self.decimal = {p: str(i) for p, i in self.ids.items()}
        self.piece_surface = {p: self.surface[i] for p, i in self.ids.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Of words with their marks: decimal ids, how many, and what these ids decode to.
        self.memo: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def _merge(self, text: str) -> list[str]:
        """Plain repeated merging of a short text: best score first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            ok = self.pairs[key] = self._merge(a + b) == [a, b]
        return ok

    def pieces(self, text: str) -> list[str]:
        """The merge result of a text, by backtracking."""
        n = len(text)
        longest: list[str | None] = [None] * n
        for end, (length, piece) in self.automaton.iter(text):
            longest[end - length] = piece  # matches from one start come shortest first
        failed = bytearray((n + 8) // 8)  # a bit per position from which no compatible rest was found
        any_failed = False
        out: list[str] = []
        shorter, pairs, compatible = self.shorter, self.pairs, self.compatible
        pos, last = 0, None
        piece = (longest[0] or text[0]) if n else None
        while pos < n:
            while piece is not None:
                end = pos + len(piece)
                if not (any_failed and failed[end >> 3] >> (end & 7) & 1):
                    if last is None:
                        break
                    ok = pairs.get((last, piece))
                    if ok or ok is None and compatible(last, piece):
                        break
                piece = shorter.get(piece)
            if piece is not None:
                out.append(piece)
                pos, last = end, piece
                piece = (longest[pos] or text[pos]) if pos < n else None
            else:
                if last is None:
                    raise AssertionError("no encoding; merging always has a result")
                failed[pos >> 3] |= 1 << (pos & 7)
                any_failed = True
                piece = out.pop()
                pos -= len(piece)
                last = out[-1] if out else None
        return out

    def encode_marked(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(text):
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte_id[b] for b in p.encode("utf-8"))
            else:
                out.append(i)
        return out

    def encode(self, text: str) -> list[int]:
        """All ids of a text, with the end id."""
        if not text:
            return [self.eos]
        out: list[int] = []
        for w in WORD.findall((MARK + text).replace(" ", MARK)):
            out.extend(self.encode_marked(w))
        return [*out, self.eos]

    def _surface(self, ids: list[int]) -> str:
        out, raw = [], b""
        for i in ids:
            s = self.surface[i]
            if isinstance(s, bytes):
                raw += s
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = b""
            out.append(s)
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the dummy space before it goes."""
        return self._surface(ids).removeprefix(" ")

    def word(self, w: str) -> tuple[str, int, str]:
        """Decimal ids of a word with its mark, their number, and the text that they decode to.

        Remembered; the words not used of late go when the memo is full. No character's bytes are in two words, so words decode one by one.
        """
        got = self.older.get(w)
        if got is None:
            pieces = self.pieces(w)
            try:
                got = " ".join([self.decimal[p] for p in pieces]), len(pieces), "".join([self.piece_surface[p] for p in pieces])
            except KeyError:  # characters without a piece
                ids = self.encode_marked(w)
                got = " ".join(map(str, ids)), len(ids), self._surface(ids)
        if len(w) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_WORDS:
                self.older, self.memo = self.memo, {}
            self.memo[w] = got
        return got

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids and of the text that they decode to."""
        end = str(self.eos)
        if not text:
            return 1, hashlib.sha256(end.encode()).hexdigest(), hashlib.sha256(b"").hexdigest()
        words = WORD.findall((MARK + text).replace(" ", MARK))
        try:
            got = list(map(self.memo.__getitem__, words))
        except KeyError:
            got = [self.memo.get(w) or self.word(w) for w in words]
        ids, sizes, back = zip(*got)
        ids_sha = hashlib.sha256(" ".join([*ids, end]).encode()).hexdigest()
        return sum(sizes) + 1, ids_sha, hashlib.sha256("".join(back).removeprefix(" ").encode()).hexdigest()


_ENCODERS: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    """One encoder per worker and model."""
    if model_file not in _ENCODERS:
        _ENCODERS[model_file] = Encoder(model_file)
    return _ENCODERS[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int, end id last) and decoded text of every row; null text counts as empty."""
    model = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(i) for i in ids], pa.string())], ["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like ``encode_documents``, with digests in place of ids and text: nothing long leaves the worker."""
    model = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            n, a, c = zip(*map(enc.digest, b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
