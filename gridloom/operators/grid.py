"""Structured grids: parity masks, stencils, neighbours.

A grid is an image (y, x, v), or a batch of images of one size with a column ``f`` as well: the frame, on which all operators work apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame(a: DataFrame) -> list[str]:
    return [c for c in a.columns if c == "f"]


def _mask(a: DataFrame, parity: int) -> DataFrame:
    return a.withColumn("v", F.when((F.col("x") + F.col("y")) % 2 == parity, F.col("v")).otherwise(F.lit(0.0)))


def red(a: DataFrame) -> DataFrame:
    """Cells of even x + y, 0 elsewhere."""
    return _mask(a, 0)


def black(a: DataFrame) -> DataFrame:
    return _mask(a, 1)


def _targets(at: Column, offset: Column, size: int) -> Column:
    """The cells t with clamp(t + offset, 0, size - 1) = at: one inside, a run at the borders."""
    low = F.when(at == 0, F.lit(0)).otherwise(at - offset)
    high = F.when(at == size - 1, F.lit(size - 1)).otherwise(at - offset)
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(size - 1))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def stencil(a: DataFrame, taps: list[tuple[int, int, float]], height: int, width: int) -> DataFrame:
    """Sum over taps (offx, offy, w) of w * a at the offset cell, the border repeated.

    Each cell is sent to where it is needed, with partial sums: one shuffle and no join.
    """
    if not taps:
        return a.withColumn("v", F.lit(0.0))
    tap = F.explode(F.array(*[F.struct(F.lit(ox).alias("ox"), F.lit(oy).alias("oy"), F.lit(float(w)).alias("w")) for ox, oy, w in taps]))
    of = frame(a)
    sent = a.withColumn("t", tap).select(*of, F.explode(_targets(F.col("y"), F.col("t.oy"), height)).alias("ty"), "x", "t", "v")
    sent = sent.select(*of, "ty", F.explode(_targets(F.col("x"), F.col("t.ox"), width)).alias("tx"), (F.col("t.w") * F.col("v")).alias("v"))
    return sent.groupBy(*of, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum("v").alias("v"))


def along_x(of: list[str]):
    """A line of the grid, in order; ``of``: ``frame`` of the grid."""
    return Window.partitionBy(*of, "y").orderBy("x")


def along_y(of: list[str]):
    return Window.partitionBy(*of, "x").orderBy("y")


def neighbours(name: str, of: list[str]) -> dict[str, Column]:
    """left, right, up, down of a column; null outside the grid."""
    return {"left": F.lag(name).over(along_x(of)), "right": F.lead(name).over(along_x(of)), "up": F.lag(name).over(along_y(of)), "down": F.lead(name).over(along_y(of))}
