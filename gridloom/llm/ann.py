"""Approximate nearest neighbours over learned partitions.

The parts are about BLOCK vectors each, PARTS[0] to PARTS[1] of them. On a bounded sample (EACH vectors
a part and SAMPLE[0] at least, SAMPLE[1] at most, those of least hash) the exact neighbour graph is built and cut
into balanced parts: capacity-bound seeding, then rounds that move vectors to the part that
holds most of their graph neighbours while parts stay within SLACK of equal size. A small classifier (one hidden
layer, numpy) learns to tell the part from the vector, from three quarters of the sample; on the last quarter it is measured in
how many of its most probable parts a query finds RECALL of its true neighbours, and so many are probed: few where
vectors lie in clusters, most of them where they don't. Every vector is indexed under its most probable part, and all
vectors of the probed parts are reranked by exact Euclidean distance in double precision.

Candidates and queries meet in packed blocks of bounded size, by an equi-join on part and block of candidates: a part
that holds a third of all vectors is many blocks in as many tasks, each of which holds one pair of blocks at a time.

Cases: vectors that are null, zero, of another length than the usual one, or hold null or non-finite components take no part; ties
go to the smaller vec_id; equal vectors are ordinary neighbours of each other; rows that repeat a vec_id are no neighbours of
each other, those with an equal vector are one row, and those with another vector are queries (with an answer each) and
candidates of their own; with fewer than 10 candidates all found are returned; no rows give no rows; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import bound_batches, table, written

#: The fit's sample, at least and at most, and for each part; its graph's degree.
SAMPLE, EACH, DEGREE = (4096, 32_768), 64, 16
#: The parts, at least and at most, and how far above equal size a part may grow.
PARTS, SLACK = (16, 512), 1.1
HIDDEN, EPOCHS = 96, 40
NEIGHBOURS = 10
#: The share of true neighbours that the probed parts must hold on the sample's last quarter.
RECALL = 0.94
#: Vectors of a packed block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 4096, 512
#: Queries: ids divisible by this.
EVERY = 100


@dataclass
class Router:
    """Vector -> probabilities of the parts."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.mean) * self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def top(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest others of each row, in blocks."""
    norms, out = (x * x).sum(1), []
    for lo in range(0, len(x), 512):
        d = norms[None] - 2 * x[lo : lo + 512] @ x.T
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        k = min(degree, len(x) - 1)
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(d), 0), int))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """A part for each row, none above SLACK times the equal share."""
    n = len(x)
    room = int(np.ceil(n / parts * SLACK))
    centres = x[rng.choice(n, parts, replace=False)].copy()
    part = np.zeros(n, int)
    for _ in range(6):  # seeding: nearest centre with room, the surest rows first
        d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None]
        near = np.sort(d, axis=1)
        held, wish = np.zeros(parts, int), np.argsort(d, axis=1)
        for i in np.argsort(near[:, 0] - near[:, min(1, parts - 1)], kind="stable"):
            for p in wish[i]:
                if held[p] < room:
                    part[i] = p
                    held[p] += 1
                    break
        for p in range(parts):
            if held[p]:
                centres[p] = x[part == p].mean(0)
    back = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    both = [np.unique(np.concatenate([graph[i], np.array(b, int)])) for i, b in enumerate(back)]
    held = np.bincount(part, minlength=parts)
    for _ in range(rounds):  # refinement: fewer cut edges, within the same room
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[both[i]], minlength=parts)
            best = int(np.where(held < room, votes, -1).argmax())
            if votes[best] > votes[part[i]]:
                held[part[i]] -= 1
                held[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def learn(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> Router:
    """Cross entropy against where a vector and its graph neighbours lie; Adam."""
    n, dim = x.shape
    aim = np.zeros((n, parts), np.float32)
    np.add.at(aim, (np.repeat(np.arange(n), graph.shape[1]), part[graph].reshape(-1)), 1.0)
    aim[np.arange(n), part] += max(1, graph.shape[1])
    aim /= aim.sum(1, keepdims=True)
    mean = x.mean(0)
    scale = 1 / max(1e-9, float((x - mean).std()))
    z = ((x - mean) * scale).astype(np.float32)
    w = [rng.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)).astype(np.float32), np.zeros(parts, np.float32)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, 128):
            rows = order[lo : lo + 128]
            a = z[rows] @ w[0] + w[1]
            h = np.maximum(a, 0)
            e = h @ w[2] + w[3]
            e = np.exp(e - e.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - aim[rows]) / len(rows)
            gh = (g @ w[2].T) * (a > 0)
            grads = [z[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0)]
            step += 1
            for k, grad in enumerate(grads):
                grad = grad + 1e-4 * w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                w[k] = w[k] - 0.004 * (1 - 0.9 * epoch / EPOCHS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(mean.astype(np.float32), scale, *w)


def fit_router(x: np.ndarray, parts: int, seed: int = 5, recall: float = RECALL) -> tuple[Router, int]:
    """The router, and how many parts a query must look into."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    parts = max(1, min(parts, len(x) // 8))
    graph = neighbour_graph(x, DEGREE)
    part = balanced_parts(x, graph, parts, rng)
    rest = rng.permutation(len(x))
    asked, known = rest[: len(x) // 4], np.sort(rest[len(x) // 4 :])
    at = np.full(len(x), -1)
    at[known] = np.arange(len(known))
    among = np.where(at[graph[known]] >= 0, at[graph[known]], np.arange(len(known))[:, None])  # neighbours that aren't known are the vector itself
    router = learn(x[known], part[known], among, parts, rng)
    if not len(asked) or parts == 1:
        return router, parts
    held = router.top(x, 1)[:, 0]  # where each vector is indexed
    place = np.empty((len(asked), parts), int)
    np.put_along_axis(place, router.top(x[asked], parts), np.arange(parts)[None].repeat(len(asked), 0), 1)
    d = neighbour_graph_of(x, asked)
    needed = np.take_along_axis(place, held[d], 1)
    found = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    return router, int(np.searchsorted(found, recall) + 1)


def neighbour_graph_of(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The NEIGHBOURS nearest others of some rows."""
    norms, out = (x * x).sum(1), []
    for lo in range(0, len(rows), 512):
        some = rows[lo : lo + 512]
        d = norms[None] - 2 * x[some] @ x.T
        d[np.arange(len(some)), some] = np.inf
        k = min(NEIGHBOURS, len(x) - 1)
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    given = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return given.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda c: c != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, is_query, k: int = NEIGHBOURS, probes: int | None = None, parts: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which ``is_query`` (of vec_id) holds, its ``k`` nearest others found. Parts and probes follow the data unless given."""
    spark = vectors.sparkSession
    bound_batches(spark)
    good = usable(vectors)
    # the usual length is that of most vectors; one row reaches the driver
    usual = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not usual:
        return spark.createDataFrame([], schema)
    dim, n_rows = usual[0]["n"], usual[0]["count"]
    good = good.where(F.size("embedding") == dim)
    parts = parts or min(PARTS[1], max(PARTS[0], n_rows // BLOCK))
    size = min(SAMPLE[1], max(SAMPLE[0], parts * EACH))
    sample = good.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "embedding").limit(size).select("embedding").toArrow()
    router, enough = fit_router(_matrix(sample.column(0).combine_chunks()), parts)
    probes = min(probes or enough, len(router.b2))

    def route(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1))
                tops = router.top(x.astype(np.float32), n) if len(x) else np.zeros((0, n), int)
                rows = pa.array(np.repeat(np.arange(len(x)), n))
                yield pa.record_batch([pa.array(tops.reshape(-1).astype(np.int32)), batch.column(0).take(rows), batch.column(1).take(rows)], ["part", "vec_id", "embedding"])

        return run

    shape = "part int, vec_id long, embedding array<double>"
    index = written(good.mapInArrow(route(1), shape), "ann-index")
    asked = good.where(is_query).dropDuplicates(["vec_id", "embedding"]).mapInArrow(route(probes), shape)
    blocks = index.groupBy("part").agg((F.count(F.lit(1)) / BLOCK + 1).cast("int").alias("blocks"))  # one row a part, PARTS[1] at most
    place = F.pmod(F.xxhash64("vec_id", "embedding"), "blocks").cast("int")
    candidates = index.join(F.broadcast(blocks), "part").withColumn("block", place)
    queries = asked.join(F.broadcast(blocks), "part").withColumn("some", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).cast("int"))
    chunks = asked.groupBy("part").agg((F.count(F.lit(1)) / QUERY_BLOCK + 1).cast("int").alias("chunks"))
    queries = queries.join(F.broadcast(chunks), "part").withColumn("chunk", F.col("some") % F.col("chunks")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = F.collect_list(F.struct("vec_id", "embedding"))
    pairs = candidates.groupBy("part", "block").agg(rows.alias("candidates")).join(queries.groupBy("part", "block", "chunk").agg(rows.alias("queries")), ["part", "block"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                c, q = (batch.column(name)[row].values for name in ("candidates", "queries"))
                c_ids, q_ids = c.field(0).to_numpy(), q.field(0).to_numpy()
                cx, qx = _matrix(c.field(1)), _matrix(q.field(1))
                if len(set(c_ids.tolist())) < len(c_ids):  # equal rows are in one block
                    once = list({(i, v.tobytes()): at for at, (i, v) in enumerate(zip(c_ids.tolist(), cx))}.values())
                    c_ids, cx = c_ids[once], cx[once]
                marks = [hashlib.blake2b(v.tobytes(), digest_size=8).digest() for v in qx]
                marks = np.frombuffer(b"".join(marks), "<i8")
                rough = (cx * cx).sum(1)[None] - 2 * qx @ cx.T
                rough[q_ids[:, None] == c_ids[None]] = np.inf
                queries, of, found, scores = [], [], [], []
                for i, line in enumerate(rough):
                    if len(line) > k:
                        edge = np.partition(line, k - 1)[k - 1]
                        near = np.flatnonzero(line <= edge + 1e-9 * (1 + abs(edge) + (qx[i] * qx[i]).sum()))  # ties and rounding stay in
                    else:
                        near = np.arange(len(line))
                    near = near[np.isfinite(line[near])]
                    exact = np.sqrt(((cx[near] - qx[i]) ** 2).sum(1))
                    best = np.lexsort((c_ids[near], exact))[:k]
                    queries.append(np.full(len(best), q_ids[i]))
                    of.append(np.full(len(best), marks[i]))
                    found.append(c_ids[near][best])
                    scores.append(exact[best])
                if queries:
                    yield pa.record_batch([pa.array(np.concatenate(a)) for a in (queries, of, found, scores)], ["query_id", "of", "vec_id", "score"])

    found = pairs.select("candidates", "queries").mapInArrow(rerank, "query_id long, of long, vec_id long, score double")
    nearest = Window.partitionBy("query_id", "of").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % EVERY == 0)
