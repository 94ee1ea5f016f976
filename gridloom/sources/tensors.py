"""Tensor sources and sinks: coordinates and a value a row.

A tensor is a DataFrame of integer coordinates (1-D ``i``; 2-D ``y, x``; 3-D ``z, y, x``; x is the
fastest axis) and ``v``, or ``re, im`` for complex values. Dense tensors carry every coordinate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = {1: ["i"], 2: ["y", "x"], 3: ["z", "y", "x"]}


def from_numpy(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """A small driver-side array as a tensor; large ones should be read from files."""
    axes = AXES[array.ndim]
    values = {"re": array.real.ravel(), "im": array.imag.ravel()} if np.iscomplexobj(array) else {"v": array.ravel()}
    grid = np.indices(array.shape).reshape(array.ndim, -1)
    import pyarrow as pa

    return spark.createDataFrame(pa.table({a: grid[k].astype(np.int64 if array.ndim == 1 else np.int32) for k, a in enumerate(axes)} | values))


def to_numpy(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Collects a small tensor; cells that it lacks are 0."""
    axes, rows = AXES[len(shape)], df.toPandas()
    out = np.zeros(shape, complex if "re" in rows else rows["v"].to_numpy().dtype)
    out[tuple(rows[a].to_numpy() for a in axes)] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy() if "re" in rows else rows["v"].to_numpy()
    return out


def coo_from_csr(spark: SparkSession, data, indices, indptr) -> DataFrame:
    """(i, j, v) of a CSR matrix given by its three arrays."""
    indptr = np.asarray(indptr)
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"i": np.repeat(np.arange(len(indptr) - 1), np.diff(indptr)).astype(np.int64), "j": np.asarray(indices).astype(np.int64), "v": np.asarray(data)}))


@dataclass(frozen=True)
class Stencil:
    """Weights with their offsets, one entry a tap."""

    data: np.ndarray
    offx: np.ndarray
    offy: np.ndarray

    @property
    def taps(self) -> list[tuple[int, int, float]]:
        """As the operators take them: (offx, offy, weight)."""
        return [(int(x), int(y), float(w)) for x, y, w in zip(self.offx, self.offy, self.data, strict=True)]


@dataclass(frozen=True)
class SpMat2D:
    """A banded operator on a grid: an image of coefficients (at their source cells) for each offset."""

    data: np.ndarray
    offx: np.ndarray
    offy: np.ndarray

    @property
    def offsets(self) -> list[tuple[int, int]]:
        return [(int(x), int(y)) for x, y in zip(self.offx, self.offy, strict=True)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(k, y, x, v)."""
        if len(self.data) != len(self.offx):
            raise ValueError("an image for each offset")
        return from_numpy(spark, np.asarray(self.data)).withColumnRenamed("z", "k")


def dia_from_arrays(spark: SparkSession, data, offsets) -> tuple[DataFrame, list[int]]:
    """(k, j, v) and the offsets of a matrix in diagonal storage: ``data`` has a line for each diagonal, in columns of the matrix."""
    data = np.atleast_2d(np.asarray(data))
    if len(data) != len(offsets):
        raise ValueError("a line for each offset")
    return from_numpy(spark, data).select(F.col("y").alias("k"), F.col("x").cast("long").alias("j"), "v"), [int(o) for o in offsets]


def dia_from_packed(packed: DataFrame) -> DataFrame:
    """(k, j, v) from rows of k, begin and data, an array of the coefficients from column ``begin`` on. Stays on the executors."""
    return packed.select("k", "begin", F.posexplode("data")).select("k", (F.col("begin") + F.col("pos")).cast("long").alias("j"), F.col("col").alias("v"))


def coo_from_packed_csr(packed: DataFrame) -> DataFrame:
    """(i, j, v) from one row a matrix row: i, indices array, data array. Stays on the executors."""
    return packed.select("i", F.explode(F.arrays_zip("indices", "data")).alias("e")).select("i", F.col("e.indices").cast("long").alias("j"), F.col("e.data").alias("v"))


def image(rows: DataFrame, y, values, f=None) -> DataFrame:
    """(y, x, v) from one row a line: ``y`` a Column, ``values`` an array column; with ``f``, a Column, a batch of images (f, y, x, v)."""
    lines = [y.cast("int").alias("y")] if f is None else [f.cast("int").alias("f"), y.cast("int").alias("y")]
    return rows.select(*lines, F.posexplode(values)).select(*["f"][: len(lines) - 1], "y", F.col("pos").alias("x"), F.col("col").cast("double").alias("v"))


def pack_rows(image_: DataFrame) -> DataFrame:
    """One row a line: y, row array ordered by x."""
    return image_.groupBy("y").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "v"))), lambda e: e["v"]).alias("row"))


def save(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
