"""Element-wise arithmetic, square roots, copies and reductions.

Operands of one lineage should be columns of one row (``fuse`` makes such rows with one join on shared
coordinates); then any chain of operators is one projection. Scalars are numbers or one-row frames (another
number of rows is an error). A column ``f`` makes a batch of tensors of a DataFrame: operators treat each frame on its own.
"""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ieee import apply, complex_apply


def coordinates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in ("f", "i", "z", "y", "x", "p", "s", "c", "d")]


def fuse(**tensors: DataFrame) -> DataFrame:
    """Coordinates and a column for each named tensor: an equi-join on all coordinates."""
    named = [df.withColumnRenamed("v", name) for name, df in tensors.items()]
    return fold(lambda a, b: a.join(b, coordinates(a)), named)


def array_op(op: str, a: DataFrame, b: DataFrame, integer: bool = False) -> DataFrame:
    """a op b for tensors of one rank, cell by cell."""
    keys = coordinates(a)
    return fuse(a=a, b=b).select(*keys, apply(op, F.col("a"), F.col("b"), integer).alias("v"))


def one(scalar: DataFrame) -> DataFrame:
    """The only row (v) of ``scalar``: an aggregate, so there is one row to broadcast whatever it holds."""
    n = F.count(F.lit(1))
    return scalar.agg(F.when(n == 1, F.first("v")).otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(" rows are no scalar")))).alias("v"))


def _scalar(df: DataFrame, scalar) -> tuple[DataFrame, Column]:
    if isinstance(scalar, DataFrame):
        return df.crossJoin(F.broadcast(one(scalar).select(F.col("v").alias("__s")))), F.col("__s")
    return df, F.lit(scalar)


def array_scalar_op(op: str, a: DataFrame, s, integer: bool = False) -> DataFrame:
    """a op s for a tensor of any rank and a scalar."""
    keys = coordinates(a)
    both, value = _scalar(a, s)
    return both.select(*keys, apply(op, F.col("v"), value, integer).alias("v"))


def scalar_array_op(op: str, s, a: DataFrame, integer: bool = False) -> DataFrame:
    """s op a."""
    keys = coordinates(a)
    both, value = _scalar(a, s)
    return both.select(*keys, apply(op, value, F.col("v"), integer).alias("v"))


def scalar_op(op: str, a: DataFrame, b: DataFrame, integer: bool = False) -> DataFrame:
    """a op b for one-row frames."""
    return one(a).select(F.col("v").alias("__a")).crossJoin(F.broadcast(one(b).select(F.col("v").alias("__b")))).select(apply(op, F.col("__a"), F.col("__b"), integer).alias("v"))


def hadamard_components(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Complex tensors, the real and imaginary parts each on their own."""
    keys = coordinates(a)
    both = a.join(b.withColumnsRenamed({"re": "__re", "im": "__im"}), keys)
    return both.select(*keys, apply(op, F.col("re"), F.col("__re")).alias("re"), apply(op, F.col("im"), F.col("__im")).alias("im"))


def complex_op(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """a op b for complex tensors of one rank, as complex numbers."""
    keys = coordinates(a)
    both = a.join(b.withColumnsRenamed({"re": "__re", "im": "__im"}), keys)
    re, im = complex_apply(op, (F.col("re"), F.col("im")), (F.col("__re"), F.col("__im")))
    return both.select(*keys, re.alias("re"), im.alias("im"))


def sqrt(a: DataFrame) -> DataFrame:
    """Element-wise for tensors and scalars; negative values give NaN."""
    return a.withColumn("v", F.sqrt("v"))


def copy(a: DataFrame) -> DataFrame:
    """Frames are immutable, so a copy is the same plan under another name."""
    return a.select("*")


def total(a: DataFrame, by: tuple[str, ...] = (), dtype: str | None = None) -> DataFrame:
    """The sum of all cells, of the cells' type unless ``dtype`` says otherwise: partial sums, then one row, or one for each of ``by``."""
    return a.groupBy(*by).agg(F.coalesce(F.sum("v"), F.lit(0)).cast(dtype or a.schema["v"].dataType).alias("v"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return total(array_op("mul", a, b))


def norm(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("v"))
