"""Incremental, reversible line deduplication.

State, sharded by line digest:

* an exact reference-count table: digest, number of documents that hold it, largest doc_id;
* per shard a cuckoo filter of the digests whose count has reached ``min_docs``.

Inserting documents raises counts, and digests that reach the threshold enter their
shard's filter; deleting documents lowers them, and digests that fall below it leave
the filter (a cuckoo filter can forget, a Bloom filter cannot). Lines are resolved by
the filter first, which rules most of them out, then by the exact table, so that false
positives of the filter never drop a line.

A line's key is the line without [\\x20\\x09-\\x0D] at its ends and with A-Z in lower case;
keys shorter than ``min_chars`` code points are never counted. A digest is 16 bytes of
BLAKE2b.

Cases: null or empty texts are one empty line; a line repeated in one document counts
once there; no rows give no rows; null doc_ids count as one document that is never the
largest, and their lines stay; rows that share a doc_id are one document. Extra columns stay, whatever their names; ``rewrite``
refuses those that it makes itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import bound_batches, forget, free_name, spread, table, text_of, written

MIN_CHARS = 20
MIN_DOCS = 3
#: Shards of the state, at least, and frequent digests that a shard holds on average, at most. A filter takes about 3 bytes a digest.
SHARDS, SHARD_DIGESTS = 64, 250_000
#: Each shard is probed by so many tasks, split by doc_id, so that a frequent line's holders spread.
SPLITS = 4
STRIP = b" \t\n\v\f\r"

BUCKET, KICKS = 4, 500


class CuckooFilter:
    """A set of 16-byte digests with deletion, after Fan, Andersen, Kaminsky and Mitzenmacher: buckets of four 16-bit fingerprints, two buckets a digest."""

    def __init__(self, capacity: int = 64, slots: np.ndarray | None = None):
        if slots is None:
            buckets = 1 << max(2, int(capacity / BUCKET / 0.9)).bit_length()
            slots = np.zeros((buckets, BUCKET), np.uint16)
        self.slots = slots

    @classmethod
    def of(cls, digests: list[bytes]) -> CuckooFilter:
        capacity = max(16, len(digests))
        while True:
            made = cls(capacity)
            if all(made.add(d) for d in made._fill(digests)):
                return made
            capacity *= 2

    def _fill(self, digests: list[bytes]) -> list[bytes]:
        """Puts digests into free slots of their two buckets, all at once; returns those that must move others."""
        mark, *places = self._all_places(digests)
        left, held = np.arange(len(digests)), (self.slots != 0).sum(1)
        for place in places:
            order = left[np.argsort(place[left], kind="stable")]
            buckets = place[order]
            slot = held[buckets] + np.arange(len(order)) - np.searchsorted(buckets, buckets)
            fits = slot < BUCKET
            self.slots[buckets[fits], slot[fits]] = mark[order[fits]]
            held += np.bincount(buckets[fits].astype(np.int64), minlength=len(held))
            left = order[~fits]
        return [digests[k] for k in left]

    @classmethod
    def loads(cls, blob: bytes) -> CuckooFilter:
        return cls(slots=np.frombuffer(blob, np.uint16).reshape(-1, BUCKET).copy())

    def dumps(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & (len(self.slots) - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (len(self.slots) - 1)

    def add(self, digest: bytes) -> bool:
        """False if the filter is too full; it must then be rebuilt, larger, from the exact table."""
        mark, *places = self._places(digest)
        for place in places:
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        place = places[0]
        for k in range(KICKS):
            slot = k % BUCKET
            mark, self.slots[place, slot] = int(self.slots[place, slot]), mark
            place = self._other(place, mark)
            free = np.flatnonzero(self.slots[place] == 0)
            if len(free):
                self.slots[place, free[0]] = mark
                return True
        return False

    def remove(self, digest: bytes) -> bool:
        mark, *places = self._places(digest)
        for place in places:
            found = np.flatnonzero(self.slots[place] == mark)
            if len(found):
                self.slots[place, found[0]] = 0
                return True
        return False

    def _all_places(self, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
        mark = np.maximum(np.ascontiguousarray(raw[:, 8:10]).view("<u2")[:, 0], 1)
        low = np.uint64(len(self.slots) - 1)
        first = np.ascontiguousarray(raw[:, :8]).view("<u8")[:, 0] & low
        return mark, first, (first ^ (mark.astype(np.uint64) * np.uint64(0x5BD1E995))) & low

    def holds(self, digests: list[bytes]) -> np.ndarray:
        """Which of the digests may be in the set."""
        mark, first, other = self._all_places(digests)
        return (self.slots[first] == mark[:, None]).any(1) | (self.slots[other] == mark[:, None]).any(1)


def keys_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """The digest of each line, None for lines too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(STRIP).lower()  # bytes.lower() changes A-Z alone
        n = len(key)
        if n < min_chars or n < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
            out.append(None)
        else:
            out.append(hashlib.blake2b(key, digest_size=16).digest())
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def postings(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(digest, doc_id), once for each row and key."""
    bound_batches(documents.sparkSession)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                held = {d for d in keys_of(text, min_chars) if d}
                digests += held
                ids += [doc] * len(held)
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(ids, pa.int64())], ["digest", "doc_id"])

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(explode, "digest binary, doc_id long")


def sharded(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with the shard of their digest."""
    return rows.withColumn("shard", spread("digest", buckets=shards))


def reference_counts(rows: DataFrame) -> DataFrame:
    """(digest, n_docs, max_doc), with partial sums before the shuffle; rows of one doc_id, or of none, are one document."""
    return rows.select("digest", "doc_id").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))


def build_filters(frequent: DataFrame) -> DataFrame:
    """(shard, filter): the cuckoo filter of each shard's frequent digests, of which a shard holds a bounded number."""

    def build(group: pa.Table) -> pa.Table:
        made = CuckooFilter.of(group.column("digest").to_pylist())
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([made.dumps()], pa.binary())})

    return frequent.select("shard", "digest").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def probe(rows: DataFrame, filters: DataFrame, splits: int = SPLITS) -> DataFrame:
    """The rows (shard, digest, doc_id) that their shard's filter lets through. Rows stream past the filter; only that is held."""
    tasks = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    left = filters.select("shard", tasks.alias("split"), F.col("filter").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("kind"))
    right = rows.select("shard", spread("doc_id", buckets=splits).alias("split"), "digest", "doc_id", F.lit(1).alias("kind"))
    both = left.unionByName(right).repartition("shard", "split").sortWithinPartitions("shard", "split", "kind")

    def pass_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        at, known = None, None
        for batch in batches:
            shards, parts, digests, docs, kinds = (batch.column(k).to_pylist() for k in range(5))
            keep: list[int] = []
            start = 0
            while start < len(shards):
                here = (shards[start], parts[start])
                if here != at:
                    at, known = here, None
                if kinds[start] == 0:
                    known = CuckooFilter.loads(digests[start])
                    start += 1
                    continue
                end = start
                while end < len(shards) and (shards[end], parts[end]) == here and kinds[end] == 1:
                    end += 1
                if known is not None:
                    keep += (start + np.flatnonzero(known.holds(digests[start:end]))).tolist()
                start = end
            yield pa.record_batch([pa.array([shards[k] for k in keep], pa.int32()), pa.array([digests[k] for k in keep], pa.binary()), pa.array([docs[k] for k in keep], pa.int64())], ["shard", "digest", "doc_id"])

    return both.mapInArrow(pass_through, "shard int, digest binary, doc_id long")


def losing_lines(rows: DataFrame, frequent: DataFrame, filters: DataFrame) -> DataFrame:
    """(doc_id, digests) of the lines that documents lose: frequent ones, except in the largest document.

    A digest's holders are spread over ``SPLITS`` keys, as one digest may be in a third of all documents.
    """
    maybe = probe(rows, filters).withColumn("split", spread("doc_id", buckets=SPLITS, seed=3))
    exact = frequent.select(F.col("digest").alias("of"), "max_doc", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))).alias("at"))
    lost = maybe.join(exact, (F.col("digest") == F.col("of")) & (F.col("split") == F.col("at"))).where(F.col("doc_id") != F.col("max_doc"))
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))  # bounded by the lines of a document


def rewrite(documents: DataFrame, lost: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``documents`` with ``kept`` (the text without its lost lines), ``n_lines``, ``n_dropped`` and ``kept_sha256``; other columns stay."""
    bound_batches(documents.sparkSession)
    made_names = ("kept", "n_lines", "n_dropped", "kept_sha256")
    if clash := {c.lower() for c in documents.columns} & set(made_names):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    given, of, lines_gone = [c for c in documents.columns if c != "text"], free_name(documents, "__of"), free_name(documents, "__digests")
    quoted = [F.col(f"`{c}`") for c in given]
    keyed = lost.select(F.col("doc_id").alias(of), F.col("digests").alias(lines_gone))
    joined = documents.select(*quoted, text_of().alias("text")).join(keyed, F.col("doc_id") == F.col(of), "left").select(*quoted, "text", lines_gone)
    schema = [f for f in documents.schema.fields if f.name != "text"]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            kept, lines, dropped, shas = [], [], [], []
            for text, gone in zip(_texts(batch.column("text")), batch.column(lines_gone).to_pylist()):
                parts, n_dropped = text.split(b"\n"), 0
                n_lines = len(parts)
                if gone:
                    gone = set(gone)
                    stay = [line for line, key in zip(parts, keys_of(text, min_chars)) if key is None or key not in gone]
                    n_dropped, text = n_lines - len(stay), b"\n".join(stay)
                kept.append(text)
                lines.append(n_lines)
                dropped.append(n_dropped)
                shas.append(hashlib.sha256(text).hexdigest())
            columns = [batch.column(c) for c in given]
            made = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas, pa.string())]
            yield pa.record_batch(columns + made, [*given, *made_names])

    out = T.StructType([*schema, T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(drop, out)


def dedup_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Inserts all ``documents`` into an empty index and resolves their lines; see ``rewrite`` for the columns."""
    rows = postings(documents, min_chars)
    frequent = written(reference_counts(rows).where(F.col("n_docs") >= min_docs), "frequent-lines")
    shards = max(SHARDS, -(-frequent.count() // SHARD_DIGESTS))  # they follow the data
    frequent = sharded(frequent, shards)
    return rewrite(documents, losing_lines(sharded(rows, shards), frequent, build_filters(frequent)), min_chars)


class LineIndex:
    """The incremental state in a folder that all executors share.

    Each change writes what it changes, as a version of its own: postings that are added, documents that are removed, the new counts of
    the digests concerned, the filters of the shards concerned. Reading a version takes the newest of each up to
    it, so a change can be repeated or undone; ``compact`` begins a new folder. ``shards`` is fixed for a folder.
    """

    TABLES = {"postings": "shard int, digest binary, doc_id long", "removed": "doc_id long", "counts": "shard int, digest binary, n_docs long, max_doc long", "filters": "shard int, filter binary"}

    def __init__(self, spark, path: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, version: int = -1, shards: int = SHARDS):
        self.spark, self.path, self.min_docs, self.min_chars, self.version, self.shards = spark, path, min_docs, min_chars, version, shards

    def _read(self, what: str) -> DataFrame:
        """All rows of versions up to this one, with ``version``."""
        schema = f"{self.TABLES[what]}, version int"
        if self.version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{what}").where(F.col("version") <= self.version)

    def _write(self, what: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{what}/version={self.version}")

    @property
    def postings(self) -> DataFrame:
        removed = self._read("removed").groupBy(F.col("doc_id").alias("gone")).agg(F.max("version").alias("until"))
        rows = self._read("postings").join(removed, F.col("doc_id") == F.col("gone"), "left")
        return rows.where(F.col("until").isNull() | (F.col("until") < F.col("version"))).select("shard", "digest", "doc_id")

    @property
    def counts(self) -> DataFrame:
        newest = self._read("counts").groupBy("shard", "digest").agg(F.max(F.struct("version", "n_docs", "max_doc")).alias("c"))
        return newest.where("c.n_docs > 0").select("shard", "digest", "c.n_docs", "c.max_doc")

    @property
    def filters(self) -> DataFrame:
        newest = self._read("filters").groupBy("shard").agg(F.max(F.struct("version", "filter")).alias("f"))
        return newest.select("shard", "f.filter")

    def _next(self) -> LineIndex:
        return LineIndex(self.spark, self.path, self.min_docs, self.min_chars, self.version + 1, self.shards)

    def _change(self, added: DataFrame, removed: DataFrame, changed: DataFrame) -> LineIndex:
        """Writes the next version. ``changed`` has the new counts (digest, n_docs, max_doc; 0 where none is left) of the digests concerned."""
        after = self._next()
        after._write("postings", sharded(added, self.shards).select("shard", "digest", "doc_id"))
        after._write("removed", removed)
        before = self.counts.select("digest", F.col("n_docs").alias("was"))
        counted = written(sharded(changed, self.shards).join(before, "digest", "left"), "line-changes")
        after._write("counts", counted.select("shard", "digest", "n_docs", "max_doc"))
        often = lambda c: F.coalesce(F.col(c), F.lit(0)) >= self.min_docs
        edits = counted.where(often("n_docs") != often("was")).select("shard", "digest", often("n_docs").alias("enters"))

        def edit(key, old: pa.Table, changes: pa.Table) -> pa.Table:
            schema = {"shard": pa.int32(), "filter": pa.binary()}
            if not changes.num_rows:  # nothing of this shard changes
                return pa.table({name: pa.array([], kind) for name, kind in schema.items()})
            known = CuckooFilter.loads(old.column("filter")[0].as_py()) if old.num_rows else None
            digests, enters = changes.column("digest").to_pylist(), changes.column("enters").to_pylist()
            if known is None:
                blob = CuckooFilter.of([d for d, e in zip(digests, enters) if e]).dumps()
            else:
                for d in (d for d, e in zip(digests, enters) if not e):
                    known.remove(d)
                blob = known.dumps() if all(known.add(d) for d, e in zip(digests, enters) if e) else None
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([blob], pa.binary())})

        edited = written(self.filters.groupBy("shard").cogroup(edits.groupBy("shard")).applyInArrow(edit, "shard int, filter binary"), "line-filters")
        full = edited.where("filter is null").select("shard")  # shards that outgrew their filter are built anew from the exact table
        often_now = after.counts.where(F.col("n_docs") >= self.min_docs).join(full, "shard", "left_semi")
        after._write("filters", edited.where("filter is not null").unionByName(build_filters(often_now)))
        return after

    def insert(self, documents: DataFrame) -> LineIndex:
        """Documents whose doc_id is there already are left as they are."""
        known = self.postings
        fresh = documents.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
        rows = postings(fresh, self.min_chars).distinct()
        nameless = known.where("doc_id IS NULL").select(F.col("digest").alias("known")).distinct()  # rows without id are one document
        rows = written(rows.join(nameless, rows.doc_id.isNull() & (rows.digest == F.col("known")), "left_anti"), "line-postings")
        more = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("more"), F.max("doc_id").alias("top"))
        old = self.counts.select("digest", "n_docs", "max_doc")
        changed = more.join(old, "digest", "left").select("digest", (F.coalesce("n_docs", F.lit(0)) + F.col("more")).alias("n_docs"), F.greatest("max_doc", "top").alias("max_doc"))
        return self._change(rows, self.spark.createDataFrame([], self.TABLES["removed"]), changed)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """``doc_ids`` has a column doc_id."""
        ids = written(doc_ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct(), "line-removed")
        known = self.postings
        concerned = written(known.join(ids, "doc_id", "left_semi").select("digest").distinct(), "line-concerned")
        left = reference_counts(known.join(ids, "doc_id", "left_anti").join(concerned, "digest", "left_semi"))
        changed = concerned.join(left, "digest", "left").select("digest", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "max_doc")
        return self._change(self.spark.createDataFrame([], "digest binary, doc_id long"), ids, changed)

    def compact(self, path: str) -> LineIndex:
        """The same state as the first version of another folder."""
        after = LineIndex(self.spark, path, self.min_docs, self.min_chars, 0, self.shards)
        for what in ("postings", "counts", "filters"):
            after._write(what, getattr(self, what))
        after._write("removed", self.spark.createDataFrame([], self.TABLES["removed"]))
        return after

    def resolve(self, documents: DataFrame) -> DataFrame:
        """``documents`` without the lines that the index holds as repeated; see ``rewrite``."""
        frequent = self.counts.where(F.col("n_docs") >= self.min_docs)
        return rewrite(documents, losing_lines(sharded(postings(documents, self.min_chars), self.shards), frequent, self.filters), self.min_chars)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(documents).select("doc_id", "n_lines", "n_dropped", "kept_sha256")
