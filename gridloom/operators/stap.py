"""Space-time adaptive processing: batched complex linear algebra over (p, ...) coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ieee import complex_mul, conj


def extract_snapshots(cube: DataFrame, n_dop: int, tdof: int, block: int) -> DataFrame:
    """(p, c, d, re, im) from (cell, dop, chan, re, im): each value goes to ``tdof`` Doppler-shifted snapshots; a map, no shuffle."""
    sent = cube.withColumn("tap", F.explode(F.sequence(F.lit(0), F.lit(tdof - 1))))
    at = F.floor(F.col("cell") / block)
    return sent.select(
        (at * n_dop + F.pmod(F.col("dop") + (tdof - 1) // 2 - F.col("tap"), F.lit(n_dop))).cast("long").alias("p"),
        (F.col("cell") - at * block).cast("int").alias("c"),
        (F.col("chan") * tdof + F.col("tap")).cast("int").alias("d"),
        "re",
        "im",
    )


def cgemm_batch(snapshots: DataFrame) -> DataFrame:
    """(p, i, j, re, im): sum over c of s_i * conj(s_j). The snapshots of a problem (a training block, a few dozen) are one Arrow row; its product is one matrix product."""
    packed = snapshots.groupBy("p").agg(F.collect_list(F.struct(F.col("c").cast("int"), F.col("d").cast("int"), "re", "im")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, entries in zip(batch.column(0).to_pylist(), batch.column(1)):
                c, d, re, im = (entries.values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                s = np.zeros((c.max() + 1, d.max() + 1), complex)
                s[c, d] = re + 1j * im
                made = s.T @ s.conj()
                i, j = np.indices(made.shape)
                out.append((np.full(made.size, p), i.ravel(), j.ravel(), made.real.ravel(), made.imag.ravel()))
            if out:
                p, i, j, re, im = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch([pa.array(p.astype(np.int64)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(re), pa.array(im)], ["p", "i", "j", "re", "im"])

    return packed.select(F.col("p").cast("long"), "s").mapInArrow(run, "p long, i int, j int, re double, im double")


def solve_batch(cov: DataFrame, steering: np.ndarray) -> DataFrame:
    """(p, s, d, re, im): cov[p] w = steering[s], with pivoting; one Arrow row a problem, LAPACK on the executors. Singular problems give NaN."""
    rhs = np.asarray(steering, complex).T.copy()
    n = rhs.shape[0]
    packed = cov.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("i", "j", "re", "im"))).alias("m")).select("p", F.transform("m", lambda e: e["re"]).alias("re"), F.transform("m", lambda e: e["im"]).alias("im"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = len(batch)
            if not k:
                continue
            a = (batch.column(1).flatten().to_numpy(zero_copy_only=False) + 1j * batch.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(k, n, n)
            try:
                w = np.linalg.solve(a, np.broadcast_to(rhs, (k, *rhs.shape)))
            except np.linalg.LinAlgError:
                w = np.full((k, *rhs.shape), np.nan + 0j)
                for i in range(k):
                    try:
                        w[i] = np.linalg.solve(a[i], rhs)
                    except np.linalg.LinAlgError:
                        pass
            w = w.transpose(0, 2, 1)
            s, d = np.meshgrid(np.arange(rhs.shape[1]), np.arange(n), indexing="ij")
            p = np.repeat(batch.column(0).to_numpy(), s.size)
            yield pa.record_batch([pa.array(p, pa.int64()), pa.array(np.tile(s.ravel(), k).astype(np.int32)), pa.array(np.tile(d.ravel(), k).astype(np.int32)), pa.array(w.real.ravel()), pa.array(w.imag.ravel())], ["p", "s", "d", "re", "im"])

    return packed.select(F.col("p").cast("long"), "re", "im").mapInArrow(run, "p long, s int, d int, re double, im double")


def steering_frame(spark, steering: np.ndarray) -> DataFrame:
    rows = [(s, d, float(w.real), float(w.imag)) for s, line in enumerate(np.asarray(steering, complex)) for d, w in enumerate(line)]
    return spark.createDataFrame(rows, "s int, d int, re double, im double")


def gamma_weights(weights: DataFrame, steering: DataFrame, mode: str = "kernel") -> DataFrame:
    """(p, s, re, im): with a = sum of conj(w) * steering, a / |a|^2; or 1 / |a| (1 where a is 0) in mode "magnitude"."""
    st = steering.select("s", "d", F.col("re").alias("sre"), F.col("im").alias("sim"))  # S x D rows: small, and broadcast where their size says so
    re, im = complex_mul(conj((F.col("re"), F.col("im"))), (F.col("sre"), F.col("sim")))
    a = weights.join(st, ["s", "d"]).groupBy("p", "s").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    size = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    if mode == "magnitude":
        return a.select("p", "s", F.when(size > 0, 1 / F.sqrt(F.when(size > 0, size))).otherwise(1.0).alias("re"), F.lit(0.0).alias("im"))
    safe = F.when(size != 0, size)
    nan = F.lit(float("nan"))
    return a.select("p", "s", F.coalesce(F.col("re") / safe, nan).alias("re"), F.coalesce(F.col("im") / safe, nan).alias("im"))


def inner_products(snapshots: DataFrame, weights: DataFrame, gamma: DataFrame) -> DataFrame:
    """(p, c, s, re, im): (sum over d of conj(snapshot) * w) * gamma."""
    w = weights.select("p", "s", "d", F.col("re").alias("wre"), F.col("im").alias("wim"))
    re, im = complex_mul(conj((F.col("re"), F.col("im"))), (F.col("wre"), F.col("wim")))
    sums = snapshots.join(w, ["p", "d"]).groupBy("p", "c", "s").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    g = gamma.select("p", "s", F.col("re").alias("gre"), F.col("im").alias("gim"))
    re, im = complex_mul((F.col("re"), F.col("im")), (F.col("gre"), F.col("gim")))
    return sums.join(g, ["p", "s"]).select("p", "c", "s", re.alias("re"), im.alias("im"))
