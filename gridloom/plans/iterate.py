"""Counted loops over plans, with the lineage cut every few steps."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.elementwise import fuse, one
from gridloom.operators.grid import black, frame, red, stencil


def shared_folder(spark) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and all executors are this process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not known and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(known or "file://" + tempfile.mkdtemp(prefix="gridloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def iterate(step: Callable[[DataFrame], DataFrame], start: DataFrame, times: int, every: int = 5) -> DataFrame:
    for k in range(1, times + 1):
        start = step(start)
        if k % every == 0 and k < times:
            start = cut(start)
    return start


def iterate_until(step: Callable[[DataFrame], DataFrame], start: DataFrame, measure: Callable[[DataFrame, DataFrame], DataFrame], least: float, most: int) -> tuple[DataFrame, int]:
    """Steps until ``measure(before, after)``, a scalar, is ``least`` or below, or ``most`` steps are done; also how many were. Each step is cut, as its measure is an action."""
    for k in range(1, most + 1):
        after = cut(step(start))
        reached = one(measure(start, after)).first()["v"]
        start = after
        if reached <= least:
            return start, k
    return start, most


def cg_step(apply: Callable[[DataFrame], DataFrame], x: DataFrame, r: DataFrame, p: DataFrame) -> DataFrame:
    """One step of conjugate gradients: (y, x, nx, nr, np) from images x, r, p and the operator, frame by frame."""
    of = frame(x)
    rows = fuse(sx=x, sr=r, sp=p).join(apply(p).withColumnRenamed("v", "ap"), [*of, "y", "x"])
    sums = rows.groupBy(*of).agg(F.sum(F.col("sr") * F.col("sr")).alias("rr"), F.sum(F.col("sp") * F.col("ap")).alias("pap"))
    with_sums = lambda df, sums: df.join(sums, of) if of else df.crossJoin(F.broadcast(sums))  # noqa: E731  (an aggregate without keys is one row)
    moved = with_sums(rows, sums).withColumn("a", F.col("rr") / F.col("pap"))
    moved = moved.select(*of, "y", "x", (F.col("sx") + F.col("a") * F.col("sp")).alias("nx"), (F.col("sr") - F.col("a") * F.col("ap")).alias("nr"), "sp", "rr")
    again = moved.groupBy(*of).agg(F.sum(F.col("nr") * F.col("nr")).alias("nrr"))
    return with_sums(moved, again).select(*of, "y", "x", "nx", "nr", (F.col("nr") + F.col("nrr") / F.col("rr") * F.col("sp")).alias("np"))


def red_black_sweep(u: DataFrame, height: int, width: int) -> DataFrame:
    """One averaging sweep of the four neighbours: red cells first, then black ones from the new red ones."""
    quarter = [(0, -1, 0.25), (-1, 0, 0.25), (1, 0, 0.25), (0, 1, 0.25)]
    for mask, other in ((red, black), (black, red)):
        new = mask(stencil(u, quarter, height, width))
        u = fuse(a=new, b=other(u)).select(*frame(u), "y", "x", (F.col("a") + F.col("b")).alias("v"))
    return u
