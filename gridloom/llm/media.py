"""Media columns with content-defined chunking.

A payload is stored as uncompressed 8-bit mono sound (a 44-byte header, then one sample a
byte). Its file is cut where a rolling gear hash of the last 32 bytes has zeros, so equal
passages give equal chunks wherever they lie. Spark keeps one body of each chunk digest, and
for each distinct file the ordered list of its chunk digests; joining the two gives the files
back, each verified against its digest before anything is computed from it.

Bodies travel compressed, with a dictionary trained on a bounded sample (``DICTIONARY_ROWS``
chunks); that changes no stored byte.

Cases: null and empty texts give a payload of 64 zero bytes; equal texts share one file; no
rows give no rows; null doc_ids are kept; a file whose bytes don't match its digest raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bound_batches, forget, hot_keys, salted, skew_join, table, text_of, written

BLOCK = 64
RATE = 16_000
#: Least and greatest chunk, and the zeros that a cut's hash must have (about 2^13 bytes apart).
LEAST, MOST, ZEROS = 2048, 65536, 13
#: Chunks that the compression dictionary is trained on, at most, and its size.
DICTIONARY_ROWS, DICTIONARY_BYTES, LEVEL = 4000, 262_144, 15

_GEAR = np.random.default_rng(2016).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def to_media(payload: bytes) -> bytes:
    """A RIFF/WAVE file: PCM, one channel, unsigned 8-bit samples."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def from_media(media: bytes) -> bytes:
    kind, n = media[36:40], struct.unpack("<I", media[40:44])[0]
    if media[:4] != b"RIFF" or kind != b"data" or len(media) != 44 + n:
        raise ValueError("not a sound file of this form")
    return media[44:]


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i-j]] << j, j < 32, modulo 2^32: the rolling gear hash at every byte, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        rolled = h.copy()
        rolled[k:] += h[:-k] << np.uint32(k)
        h = rolled
    return h


def chunks_of(media: bytes) -> list[bytes]:
    """Cuts after bytes whose hash's upper ``ZEROS`` bits are zero, at least LEAST and at most MOST bytes apart."""
    n = len(media)
    if n <= LEAST:
        return [media]
    cuts = np.flatnonzero(gear_hashes(np.frombuffer(media, np.uint8)) < np.uint32(1 << (32 - ZEROS))) + 1
    out, begun, k = [], 0, 0
    while n - begun > LEAST:
        k = int(np.searchsorted(cuts, begun + LEAST))
        end = min(int(cuts[k]) if k < len(cuts) else n, begun + MOST, n)
        out.append(media[begun:end])
        begun = end
    return out + [media[begun:]] if begun < n else out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def feature_of(payload: bytes) -> str:
    """Of the samples around their middle 128: sum, energy, crossings of the middle, and peak; whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max())}"


def _media(column: pa.Array) -> Iterator[tuple[int, bytes]]:
    for text in column.cast(pa.binary()).to_pylist():
        yield len(text), to_media(payload_of(text))


def train_dictionary(documents: DataFrame) -> bytes:
    """From the documents of least doc_id hash, DICTIONARY_ROWS at most and 8 KB of each; empty if there are too few to train on."""
    ranked = documents.select("doc_id", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h")).orderBy("h").limit(DICTIONARY_ROWS)
    texts = documents.join(F.broadcast(ranked), "doc_id").select("h", F.substring(text_of(), 1, 8192).alias("t")).orderBy("h", "t").limit(DICTIONARY_ROWS)
    bodies = [r.t.encode() for r in texts.collect() if r.t]
    if len(bodies) < 100 or sum(map(len, bodies)) < 8 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, bodies, level=LEVEL).as_bytes()


def named(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, digests): each document's file and the ordered digests of its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            sizes, files, digests = [], [], []
            for n, media in _media(batch.column(1)):
                sizes.append(n)
                files.append(hashlib.sha256(media).digest())
                digests.append([digest_of(chunk) for chunk in chunks_of(media)])
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media", "digests"])

    return documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary, digests array<binary>")


def manifests(names: DataFrame) -> DataFrame:
    """(media, seq, digest, n): the ordered chunk list of each distinct file, and its length."""
    rows = names.select("media", F.size("digests").alias("n"), F.posexplode("digests").alias("seq", "digest"))
    return rows.groupBy("media", "seq").agg(F.first("digest").alias("digest"), F.first("n").alias("n"))


def chunk_store(documents: DataFrame, dictionary: bytes = b"", hot: DataFrame | None = None) -> DataFrame:
    """(digest, salt, body): one compressed body of each chunk; of those that are ``hot``, one for each salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        seen: set[bytes] = set()
        for batch in batches:
            digests, bodies = [], []
            for _, media in _media(batch.column(0)):
                for chunk in chunks_of(media):
                    digest = digest_of(chunk)
                    if digest not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        bodies.append(press.compress(chunk))
            if len(seen) > 500_000:
                seen.clear()
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["digest", "body"])

    bodies = documents.select(text_of().alias("text")).mapInArrow(run, "digest binary, body binary")
    # salted before they are grouped, so that the join finds them where they are and doesn't send them again
    spread_out = bodies.withColumn("salt", F.lit(0)) if hot is None else salted(bodies, "digest", hot, "salt", "right")
    return spread_out.groupBy("digest", "salt").agg(F.first("body").alias("body"))


def read_files(manifest: DataFrame, store: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """``manifest`` has a column salt, as the store. One row per distinct file, from its stored chunks: media (its digest), payload_bytes, payload_sha256, tail_crc32, media_bytes, feature."""
    schema = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        unpack = zstandard.ZstdDecompressor(dict_data=known)
        at, parts = None, []

        def close() -> tuple:
            media = b"".join(parts)
            if hashlib.sha256(media).digest() != at:
                raise ValueError(f"file {at.hex()} can't be put together again")
            payload = from_media(media)
            return at, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), feature_of(payload)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*rows) if rows else [[]] * len(kinds)
            return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            rows = []
            for media, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if media != at:
                    if at is not None:
                        rows.append(close())
                    at, parts = media, []
                parts.append(unpack.decompress(body))
            yield batch_of(rows)
        if at is not None:
            yield batch_of([close()])

    def joined(which: str) -> DataFrame:
        return manifest.where(which).join(store, ["digest", "salt"]).select("media", "seq", "body")

    # a file of one chunk is whole where its chunk is; only the others' bodies are sent on
    several = joined("n > 1").repartition("media").sortWithinPartitions("media", "seq")
    return joined("n = 1").mapInArrow(run, schema).unionByName(several.mapInArrow(run, schema))


def store_and_read(documents: DataFrame) -> DataFrame:
    """Stores the texts of ``documents`` (doc_id, text) and reads them back: the columns of ``read_files``, doc_id and n_bytes."""
    bound_batches(documents.sparkSession)
    documents = documents.select("doc_id", "text")  # extra columns aren't read

    names = written(named(documents), "media-names")
    dictionary = train_dictionary(documents)
    manifest = written(manifests(names), "media-manifests")
    hot = hot_keys(manifest, "digest")
    files = read_files(salted(manifest, "digest", hot, "salt", "left"), chunk_store(documents, dictionary, hot), dictionary)
    return skew_join(names.drop("digests"), files, "media")


def op8_media(spark, sf_dir: str) -> DataFrame:
    found = store_and_read(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")
