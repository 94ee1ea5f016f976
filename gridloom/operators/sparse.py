"""Sparse products: an equi-join on the contracted index, partial sums, then the dense row domain.

A column that holds a large share of all entries is one join key; the adaptive planner splits such a partition
(``spark.sql.adaptive.skewJoin``, on by default), as nothing between the shuffle and the join keeps it from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import frame


def _dense(sums: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    return domain.select(*keys).join(sums, keys, "left").select(*keys, F.coalesce("v", F.lit(0.0)).alias("v"))


def spmv_csr(a: DataFrame, x: DataFrame, rows: DataFrame) -> DataFrame:
    """y[i] = sum of a[i, j] * x[j]; a is (i, j, v), ``rows`` holds every i. Empty rows give 0."""
    at = x.select(F.col("i").alias("j"), F.col("v").alias("__x"))
    sums = a.join(at, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("__x")).alias("v"))
    return _dense(sums, rows, ["i"])


def spmv_dia(data: DataFrame, offsets: list[int], x: DataFrame, dim: int) -> DataFrame:
    """Diagonal storage (k, j, v): y[j - offset_k] += v * x[j], rows outside [0, dim) dropped."""
    offset = F.element_at(F.array(*map(F.lit, offsets)), F.col("k") + 1)
    at = x.select(F.col("i").alias("j"), F.col("v").alias("__x"))
    sums = data.join(at, "j").select((F.col("j") - offset).alias("i"), (F.col("v") * F.col("__x")).alias("v")).where(F.col("i").between(0, dim - 1)).groupBy("i").agg(F.sum("v").alias("v"))
    return _dense(sums, x.where(F.col("i").between(0, dim - 1)), ["i"])


def spmv_dia2d(data: DataFrame, offsets: list[tuple[int, int]], v: DataFrame, height: int, width: int) -> DataFrame:
    """Banded grid operator (k, y, x, v), its coefficient at the source cell: out[y - offy, x - offx] += coefficient * v[y, x]. One operator serves all frames of ``v`` if it has no frames itself."""
    ox = F.element_at(F.array(*[F.lit(o[0]) for o in offsets]), F.col("k") + 1)
    oy = F.element_at(F.array(*[F.lit(o[1]) for o in offsets]), F.col("k") + 1)
    keys = [*frame(v), "y", "x"]
    both = data.join(v.withColumnRenamed("v", "__v"), [*frame(data), "y", "x"])
    sent = both.select(*frame(v), (F.col("y") - oy).alias("y"), (F.col("x") - ox).alias("x"), (F.col("v") * F.col("__v")).alias("v"))
    sums = sent.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).groupBy(*keys).agg(F.sum("v").alias("v"))
    return _dense(sums, v, keys)
