"""SentencePiece encoding by streaming Viterbi, and decoding.

The vocabulary and its scores come from a public SentencePiece model file. Encoding
finds the path of highest summed score (the earliest start wins ties) through the lattice of
pieces. It streams: only as many positions as the longest piece has characters are
live; whenever all live positions trace back to one boundary, the ids up to it are
committed and forgotten. Spans between boundaries that no piece can cross (before a run
of spaces, around line feeds, between Latin letters and other characters, where the
vocabulary has no piece across) are encoded once and remembered in a bounded memo that a
worker keeps from task to task.

A character that no piece covers costs the least score of the vocabulary less 10 and becomes its UTF-8
bytes; so does a literal U+2581, the mark that stands for a space, so that decoding
gives back every text exactly.

Cases: null and empty texts give no ids and decode to the empty text; very long words
need no more than the live window; no rows give no rows; extra columns stay, and the
new columns ``ids`` or ``decoded`` must be free.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import bound_batches, forget, table, text_of, worker_state

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
#: Entries of a task's memo, and the longest span that enters it.
MEMO, MEMO_CHARS = 150_000, 64
LATIN = "[A-Za-zÀ-ÖØ-öø-ɏ]"
#: How often the live paths are traced back.
TRACE_EVERY = 64


def _fields(blob: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message."""
    at, end = 0, len(blob)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = blob[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < end:
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire == 2:
            n = varint()
            yield key >> 3, blob[at : at + n]
            at += n
        else:
            n = 4 if wire == 5 else 8
            yield key >> 3, blob[at : at + n]
            at += n


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def model_bytes(path: str | None = None) -> bytes:
    """A model file as the driver reads it; executors get its bytes (some hundred kilobytes) with their tasks and need no file."""
    with open(path or default_model(), "rb") as f:
        return f.read()


class Pieces:
    """The pieces of a model file (its bytes), with the two directions."""

    def __init__(self, blob: bytes):
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        byte_ids = {}
        for number, value in _fields(blob):
            if number != 1:
                continue
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            at = len(self.scores)
            self.scores.append(score)
            if kind == BYTE:
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                byte_ids[self.bytes_of[-1][0]] = at
            elif kind in (NORMAL, USER_DEFINED):
                self.ids[piece] = at
                self.bytes_of.append(piece.replace(MARK, " ").encode())
            else:
                self.bytes_of.append(b"")
        self.byte_ids = [byte_ids[b] for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores) - 10.0
        self.spans = self._sure_spans()

    @cached_property
    def trie(self) -> dict:
        """Character -> (the next level, id, score), id -1 if it is no piece itself."""
        root: dict = {}
        for piece, i in sorted(self.ids.items()):  # prefixes first
            level = root
            for k, c in enumerate(piece, 1):
                node = level.get(c) or ({}, -1, 0.0)
                level[c] = node = (node[0], i, self.scores[i]) if k == len(piece) else node
                level = node[0]
        return root

    def _sure_spans(self) -> re.Pattern:
        """Cuts a text where no piece of this vocabulary can cross: before runs of spaces, around line feeds, between Latin letters and the rest."""
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            return re.compile(r"(?s).+")
        mixed = re.compile(f"{LATIN}[^{LATIN[1:]}|[^{LATIN[1:]}{LATIN}")
        if any(mixed.search(p.lstrip(MARK)) for p in self.ids):
            return re.compile(r"\n| *[^ \n]+| +")
        return re.compile(rf"\n| *{LATIN}+| *[^{LATIN[1:-1]} \n]+| +")

    def viterbi(self, text: str) -> list[int]:
        """The ids of ``text``, in which MARK stands for a space."""
        trie, longest, unknown = self.trie, self.longest, self.unknown
        out: list[int] = []
        n, base = len(text), 0  # everything before base is committed
        # of the ends within reach, relative to base: best score, where it starts, its id (-1: a character of its own bytes)
        best: list[float | None] = [None] * (min(n, TRACE_EVERY) + longest + 1)
        came, ids = [0] * len(best), [0] * len(best)
        best[0] = 0.0
        start, next_trace = 0, TRACE_EVERY
        while start < n:
            score = best[start - base]
            at = start - base
            if score is not None:
                level, to = trie, at
                for c in text[start : start + longest]:
                    node = level.get(c)
                    if node is None:
                        break
                    level, piece, gain = node
                    to += 1
                    if piece >= 0:
                        total, known = score + gain, best[to]
                        if known is None or total > known:
                            best[to], came[to], ids[to] = total, at, piece
                single = trie.get(text[start])
                if single is None or single[1] < 0:
                    total = score + unknown
                    if best[at + 1] is None or total > best[at + 1]:
                        best[at + 1], came[at + 1], ids[at + 1] = total, at, -1
            start += 1
            if start == next_trace and start < n:
                # all live ends, traced back until one boundary is left
                now = start - base
                live = {k for k in range(now, min(n - base, now + longest - 1) + 1) if best[k] is not None}
                while len(live) > 1 or max(live) > now:
                    last = max(live)
                    live.remove(last)
                    live.add(came[last])
                meet = live.pop()
                if meet:
                    out += self._path(text, came, ids, base, meet)
                    least = best[meet]
                    best = [None if x is None else x - least for x in best[meet:]]
                    came, ids = [x - meet for x in came[meet:]], ids[meet:]
                    base += meet
                # paths that don't meet are traced ever more rarely, so that the work stays in proportion
                next_trace = start + max(TRACE_EVERY, start - base)
                room = next_trace - base + longest + 1 - len(best)
                best += [None] * room
                came += [0] * room
                ids += [0] * room
        return out + self._path(text, came, ids, base, n - base)

    def _path(self, text: str, came: list[int], ids: list[int], base: int, end: int) -> list[int]:
        """The ids of the best path from ``base`` to ``end`` characters after it."""
        out: list[int] = []
        while end > 0:
            start, piece = came[end], ids[end]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte_ids[b] for b in reversed(text[base + start : base + end].encode())]
            end = start
        out.reverse()
        return out

    def span(self, span: str) -> list[int]:
        """The ids of a span with spaces written as spaces."""
        out: list[int] = []
        if MARK not in span:
            return self.viterbi(span.replace(" ", MARK))
        for k, part in enumerate(span.split(MARK)):  # a literal mark becomes bytes
            if k:
                out += [self.byte_ids[b] for b in MARK.encode()]
            out += self.viterbi(part.replace(" ", MARK))
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace")  # without the space put in front


class Memo(dict):
    """Span -> ids as little-endian 32-bit bytes; emptied when full."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, span: str) -> bytes:
        made = np.array(self.pieces.span(span), "<i4").tobytes()
        if len(span) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[span] = made
        return made

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.pieces.spans.findall(" " + text)))


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column exists already: {name}")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, model: str | None = None, text: str = "text", and_decode: bool = False) -> DataFrame:
    """``df`` with ``ids`` array<int>; with ``and_decode`` also ``decoded``, what those ids decode to, in the same pass."""
    bound_batches(df.sparkSession)
    blob, schema, names = df.sparkSession.sparkContext.broadcast(model_bytes(model)), _with(df, "ids", T.ArrayType(T.IntegerType())), df.columns
    mark = hashlib.sha256(blob.value).hexdigest()
    if and_decode:
        schema = T.StructType([*schema.fields, _with(df, "decoded", T.StringType()).fields[-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        memo = worker_state(f"pieces:{mark}", lambda: Memo(Pieces(blob.value)))
        for batch in batches:
            made = [memo.encode(t or "") for t in batch.column(names.index(text)).to_pylist()]
            ends = np.cumsum([0, *(len(b) // 4 for b in made)]).astype("<i4")
            columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))]
            if and_decode:
                columns.append(pa.array([memo.pieces.decode(np.frombuffer(b, "<i4").tolist()) for b in made], pa.string()))
            yield pa.record_batch(columns, schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of its ids; null ids give the empty text."""
    bound_batches(df.sparkSession)
    blob, schema, names = df.sparkSession.sparkContext.broadcast(model_bytes(model)), _with(df, "decoded", T.StringType()), df.columns
    mark = hashlib.sha256(blob.value).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        pieces = worker_state(f"table:{mark}", lambda: Pieces(blob.value))
        for batch in batches:
            column = batch.column(names.index(ids))
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(n or 0 for n in pc.list_value_length(column).to_pylist())])
            texts = [pieces.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    return df.mapInArrow(run, schema)


def digests() -> list:
    """Columns made of ``ids`` and ``decoded``."""
    return [
        F.size("ids").cast("long").alias("n_ids"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    ]


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    """Per document: number and digest (decimal, comma-joined) of its ids, and the digest of the text that they decode to."""
    documents = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    both = encode(documents, and_decode=True)
    return both.select("doc_id", *digests(), (F.col("text") == F.col("decoded")).alias("exact"))
