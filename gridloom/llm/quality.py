"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte is
embedded, learned filters of WIDTH bytes run over the chunk at a stride of half that, and
a chunk is the maximum of each filter after a ReLU. The chunks of a document are averaged
and combined into one probability by a logistic layer.

The network is fitted on the driver on a bounded sample of labelled rows (TRAIN_ROWS of
each label, those of least hash, with TRAIN_CHUNKS chunks of each at most: of longer texts, executors
draw those by hash from the whole text), with label noise in mind: few epochs, weight decay, classes weighed
equally. Scoring then runs over whole texts, batch by batch, with a model of a few kilobytes.

Cases: null and empty texts are one chunk of padding and get the score that it has; labels that are
null or neither 0 nor 1 are not learned from, and a document labelled twice counts once, by its greater
label; without labels of both kinds every score is the share of label 1, or 0.5; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import bound_batches, forget, table, text_of

#: Chunks of CHUNK bytes begin every CHUNK - OVERLAP bytes.
CHUNK, OVERLAP = 512, 64
#: Filters of WIDTH bytes at a stride of WIDTH / 2, over embeddings of DEPTH numbers a byte.
WIDTH, DEPTH, FILTERS = 16, 6, 24
#: Labelled rows that the fit takes of each label at most, and chunks of each row. Together they bound what the driver holds: 2 * 1500 * 96 * 512 bytes.
TRAIN_ROWS, TRAIN_CHUNKS = 1500, 96
#: Chunks that a step of the fit holds the intermediate results of at once.
SLICE = 4096
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.01, 1e-4
THRESHOLD = 0.3
HELD_OUT, FOLDS = 0, 5


@dataclass
class Network:
    embed: np.ndarray  # 256 x DEPTH
    first: np.ndarray  # the filters over the first half of their bytes: (WIDTH/2 * DEPTH) x FILTERS
    second: np.ndarray
    bias: np.ndarray
    out: np.ndarray  # FILTERS
    out_bias: float

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        half = WIDTH // 2 * DEPTH
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        return cls(draw(256, DEPTH, scale=0.5), draw(half, FILTERS, scale=0.3), draw(half, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32), draw(FILTERS, scale=0.1), 0.0)

    def forward(self, chunks: np.ndarray):
        """chunks: n x CHUNK bytes. Per chunk the maximum of each filter, and where it is."""
        n, half = len(chunks), WIDTH // 2
        parts = self.embed[chunks].reshape(n, CHUNK // half, half * DEPTH)
        a, b = parts @ self.first, parts @ self.second
        swept = a[:, :-1] + b[:, 1:]
        at = swept.argmax(1)
        return parts, at, np.maximum(np.take_along_axis(swept, at[:, None], 1)[:, 0] + self.bias, 0)

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        half = WIDTH // 2
        parts = self.embed[chunks].reshape(len(chunks), CHUNK // half, half * DEPTH)
        swept = (parts @ self.first)[:, :-1]
        swept += (parts @ self.second)[:, 1:]
        return np.maximum(swept.max(1) + self.bias, 0)

    def probability(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(means @ self.out + self.out_bias, -30, 30)))


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of the texts, padded with zeros, and how many each text has."""
    step = CHUNK - OVERLAP
    counts = np.array([max(1, -(-(len(t) - OVERLAP) // step)) for t in texts])
    out = np.zeros((int(counts.sum()), CHUNK), np.uint8)
    at = 0
    for text, n in zip(texts, counts):
        data = np.zeros((n - 1) * step + CHUNK, np.uint8)
        data[: len(text)] = np.frombuffer(text, np.uint8)
        out[at : at + n] = np.lib.stride_tricks.as_strided(data, (n, CHUNK), (step, 1))
        at += n
    return out, counts


def drawn(text: bytes, most: int = TRAIN_CHUNKS) -> np.ndarray:
    """The text's chunks, or ``most`` of them, drawn by hash from all of it and in its order."""
    chunks, _ = chunks_of([text])
    if len(chunks) <= most:
        return chunks
    marks = [hashlib.blake2b(k.to_bytes(8, "little") + c.tobytes(), digest_size=8).digest() for k, c in enumerate(chunks)]
    return chunks[sorted(sorted(range(len(chunks)), key=marks.__getitem__)[:most])]


def fit(chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 11, epochs: int = EPOCHS) -> Network:
    """Adam on the cross entropy, classes weighed equally; the same sample (chunks, how many each text has, labels) gives the same network."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    half = WIDTH // 2
    starts = np.cumsum(counts) - counts
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    names = ("embed", "first", "second", "bias", "out", "out_bias")
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(counts))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            own = np.repeat(np.arange(len(docs)), counts[docs])
            rows = np.concatenate([np.arange(starts[d], starts[d] + counts[d]) for d in docs])
            share = (1 / counts[docs])[own].astype(np.float32)
            means = np.zeros((len(docs), FILTERS), np.float32)
            slices = [slice(k, k + SLICE) for k in range(0, len(rows), SLICE)]
            for some in slices:
                passed = net.forward(chunks[rows[some]])
                np.add.at(means, own[some], passed[2] * share[some, None])
            p = net.probability(means)
            slope = ((p - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            grads = {"out": means.T @ slope, "out_bias": float(slope.sum())}
            grads |= {k: np.zeros_like(getattr(net, k)) for k in ("bias", "first", "second", "embed")}
            for some in slices:
                data = chunks[rows[some]]
                parts, at, top = passed if len(slices) == 1 else net.forward(data)
                to_top = (slope[:, None] * net.out)[own[some]] * share[some, None] * (top > 0)
                grads["bias"] += to_top.sum(0)
                chunk_at = np.arange(len(data))[:, None]
                one, two = parts[chunk_at, at], parts[chunk_at, at + 1]  # chunks x FILTERS x half*DEPTH
                grads["first"] += np.einsum("cf,cfk->kf", to_top, one)
                grads["second"] += np.einsum("cf,cfk->kf", to_top, two)
                windows = data.reshape(len(data), CHUNK // half, half)
                for weights, shift in ((net.first, 0), (net.second, 1)):
                    back = (to_top[:, :, None] * weights.T[None]).reshape(-1, DEPTH)
                    np.add.at(grads["embed"], windows[chunk_at, at + shift].reshape(-1), back)
            step += 1
            pace = RATE * (1 - epoch / epochs * 0.8)
            for k in names:
                g = grads[k] + DECAY * getattr(net, k)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                change = pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                now = getattr(net, k) - change
                setattr(net, k, float(now) if k == "out_bias" else now.astype(np.float32))
    return net


def held_out():
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS == HELD_OUT, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_CHUNKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bounded training sample (chunks, how many each text has, labels): of each label the ``rows`` rows of least hash that aren't held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ranked = known.withColumn("hash", F.md5(F.col("doc_id").cast("string")))
    chosen = ranked.where("quality = 0").orderBy("hash").limit(rows).unionByName(ranked.where("quality = 1").orderBy("hash").limit(rows))
    texts = documents.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # 2 * rows rows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            made = [drawn(t or b"", most).tobytes() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["hash", "quality", "chunks"])

    some = texts.select("hash", F.col("quality").cast("int"), "text").mapInArrow(cut, "hash string, quality int, chunks binary")
    taken = some.orderBy("hash", "chunks").limit(2 * rows).toArrow()
    flat = np.frombuffer(b"".join(taken.column("chunks").to_pylist()), np.uint8).reshape(-1, CHUNK)
    counts = np.array([len(c) // CHUNK for c in taken.column("chunks").to_pylist()], np.int64)
    return flat, counts, np.array(taken.column("quality").to_pylist(), np.int64)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` with ``score``, the probability of quality 1."""
    bound_batches(documents.sparkSession)
    if "score" in {c.lower() for c in documents.columns}:
        raise ValueError("column exists already: score")
    chunks, counts, marks = sample(documents, labels)
    if len(set(marks.tolist())) < 2:
        return documents.withColumn("score", F.lit(float(marks.mean()) if len(marks) else 0.5))
    net, at = fit(chunks, counts, marks), documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            scores: list[float] = []
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 1 << 18):  # stays in the processor's cache
                    size += len(texts[hi])
                    hi += 1
                chunks, counts = chunks_of(texts[lo:hi])
                tops = np.concatenate([net.pooled(chunks[k : k + 256]) for k in range(0, len(chunks), 256)])
                means = np.add.reduceat(tops, np.cumsum(counts) - counts, axis=0) / counts[:, None]
                scores += net.probability(means.astype(np.float64)).tolist()
                lo = hi
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("score", T.DoubleType())]))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
