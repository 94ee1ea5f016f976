"""Optical flow: warping, window least squares, matrix powers, diffusion matrices, preconditioners.

All take images (y, x, v) or batches of images of one size, with a column ``f`` as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.elementwise import fuse
from gridloom.operators.grid import along_x, along_y, frame, neighbours

#: Offsets (offx, offy) of the diagonals of ``set_brox_matrix``: top, left, middle, right, bottom.
BROX_OFFSETS = [(0, -1), (-1, 0), (0, 0), (1, 0), (0, 1)]
BROX_REDBLACK_OFFSETS = [(0, -1), (-1, 0), (1, 0), (0, 1)]


def warp_img2d(src: DataFrame, u: DataFrame, v: DataFrame, height: int, width: int) -> DataFrame:
    """src at (x + u, y + v), bilinear; where a tap would leave the grid, src itself."""
    shift = lambda c: F.when(F.col(c) < 0, F.col(c).cast("int") - 1).otherwise(F.col(c).cast("int"))
    part = lambda c: F.when(F.col(c) < 0, F.col(c) - F.col(c).cast("int") + 1).otherwise(F.col(c) - F.col(c).cast("int"))
    of = frame(src)
    cells = fuse(own=src, u=u, v=v).select(*of, "y", "x", "own", (F.col("x") + shift("u")).alias("bx"), (F.col("y") + shift("v")).alias("by"), part("u").alias("fx"), part("v").alias("fy"))
    inside = (F.col("bx") >= 0) & (F.col("bx") + 1 < width) & (F.col("by") >= 0) & (F.col("by") + 1 < height)
    fx, fy = F.col("fx"), F.col("fy")
    taps = [(0, 0, (1 - fx) * (1 - fy)), (1, 0, fx * (1 - fy)), (0, 1, (1 - fx) * fy), (1, 1, fx * fy)]
    tap = F.explode(F.array(*[F.struct((F.col("by") + dy).alias("y"), (F.col("bx") + dx).alias("x"), w.alias("w")) for dx, dy, w in taps]))
    sent = cells.where(inside).select(*of, F.col("y").alias("oy"), F.col("x").alias("ox"), tap.alias("t")).select(*of, "oy", "ox", "t.y", "t.x", "t.w")
    moved = sent.join(src, [*of, "y", "x"]).groupBy(*of, F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return moved.unionByName(cells.where(~inside).select(*of, "y", "x", F.col("own").alias("v")))


def lk_least_squares(it: DataFrame, ix: DataFrame, iy: DataFrame, radius: int, height: int, width: int, inclusive: bool = False) -> DataFrame:
    """(y, x, du, dv): least squares over windows [-radius, radius - 1] (to radius if ``inclusive``), 0 near the border and where singular."""
    names = {"xx": ("ix", "ix"), "yy": ("iy", "iy"), "xy": ("ix", "iy"), "xt": ("ix", "it"), "yt": ("iy", "it")}
    of = frame(it)
    sums = fuse(it=it, ix=ix, iy=iy).select(*of, "y", "x", *[(F.col(a) * F.col(b)).alias(n) for n, (a, b) in names.items()])
    end = radius if inclusive else radius - 1
    for along in (along_x(of), along_y(of)):
        sums = sums.select(*of, "y", "x", *[F.sum(n).over(along.rangeBetween(-radius, end)).alias(n) for n in names])
    xx, yy, xy, xt, yt = map(F.col, names)
    det = xx * yy - xy * xy
    good = F.col("x").between(radius, width - radius - 1) & F.col("y").between(radius, height - radius - 1) & (det != 0)
    safe = F.when(good, det)
    return sums.select(*of, "y", "x", F.coalesce((xt * yy - xy * yt) / safe, F.lit(0.0)).alias("du"), F.coalesce((xx * yt - xy * xt) / safe, F.lit(0.0)).alias("dv"))


def hs_matrix_powers(lam: float, ix: DataFrame, iy: DataFrame, r0: DataFrame, r1: DataFrame, steps: int, cut=None, every: int = 4) -> DataFrame:
    """(z, y, x, v0, v1): powers 0 to steps - 1 of the two-channel operator on (r0, r1).

    ``cut`` (a checkpointing function) is called every ``every`` steps to keep plans short.
    """
    state = fuse(ix=ix, iy=iy, u=r0, w=r1)
    of = frame(ix)
    out = state.select(*of, F.lit(0).alias("z"), "y", "x", F.col("u").alias("v0"), F.col("w").alias("v1"))
    for z in range(1, steps):
        near = {c: neighbours(c, of) for c in ("u", "w")}
        laplace = {c: sum((F.coalesce(F.col(c) - n, F.lit(0.0)) for n in near[c].values()), F.lit(0.0)) for c in near}
        both = F.col("ix") * F.col("u") + F.col("iy") * F.col("w")
        state = state.select(*of, "y", "x", "ix", "iy", (F.col("ix") * both + lam * laplace["u"]).alias("u"), (F.col("iy") * both + lam * laplace["w"]).alias("w"))
        if cut and z % every == 0:
            state = cut(state)
        out = out.unionByName(state.select(*of, F.lit(z).alias("z"), "y", "x", F.col("u").alias("v0"), F.col("w").alias("v1")))
    return out


def _coefficients(psi: DataFrame, alpha: float, height: int, width: int, ks: tuple) -> DataFrame:
    """(k, y, x, v): each coefficient at its source cell; ks: the numbers of top, left, middle, right, bottom (None: left out)."""
    of = frame(psi)
    near = psi.select(*of, "y", "x", "v", F.lag("v").over(along_y(of)).alias("up"), F.lag("v").over(along_x(of)).alias("left"))
    a = lambda c: F.coalesce(F.col(c) * alpha, F.lit(0.0))
    y, x = F.col("y"), F.col("x")
    middle = a("up") + a("left") + F.when(x < width - 1, a("v")).otherwise(0.0) + F.when(y < height - 1, a("v")).otherwise(0.0)
    cells = ((y > 0, y - 1, x, -a("up")), (x > 0, y, x - 1, -a("left")), (F.lit(True), y, x, middle), (x < width - 1, y, x + 1, -a("v")), (y < height - 1, y + 1, x, -a("v")))
    made = [F.when(ok, F.struct(F.lit(k).alias("k"), ty.alias("y"), tx.alias("x"), v.alias("v"))) for k, (ok, ty, tx, v) in zip(ks, cells) if k is not None]
    return near.select(*of, F.explode(F.array(*made)).alias("e")).where("e IS NOT NULL").select(*of, "e.k", "e.y", "e.x", "e.v")


def set_brox_matrix(psi: DataFrame, alpha: float, height: int, width: int) -> DataFrame:
    return _coefficients(psi, alpha, height, width, (0, 1, 2, 3, 4))


def set_brox_redblack_matrix(psi: DataFrame, alpha: float, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(off-diagonals 0 to 3, the diagonal as an image)."""
    return _coefficients(psi, alpha, height, width, (0, 1, None, 2, 3)), _coefficients(psi, alpha, height, width, (None, None, 0, None, None)).drop("k")


def _solve_blocks(cells: DataFrame, extra, eps: float) -> DataFrame:
    a, d, b = F.col("d0") + extra, F.col("d1") + extra, F.col("od")
    det = a * d - b * b
    safe, x0, x1 = F.when(F.abs(det) > eps, det), F.col("x0"), F.col("x1")
    return cells.select(*frame(cells), "y", "x", F.coalesce((x0 * d - b * x1) / safe, x0).alias("y0"), F.coalesce((a * x1 - b * x0) / safe, x1).alias("y1"))


def apply_hs_preconditioner(taps: list[tuple[int, int, float]], d0, d1, od, x0, x1, height: int, width: int, eps: float = 1e-15) -> DataFrame:
    """2x2 block solve; the weight of tap 2 is added to the diagonal once for each neighbour in the grid."""
    x, y = F.col("x"), F.col("y")
    n = (x > 0).cast("int") + (x < width - 1).cast("int") + (y > 0).cast("int") + (y < height - 1).cast("int")
    return _solve_blocks(fuse(d0=d0, d1=d1, od=od, x0=x0, x1=x1), n * float(taps[2][2]), eps)


def apply_brox_preconditioner(matrix: DataFrame, d0, d1, od, x0, x1, eps: float = 1e-4) -> DataFrame:
    """The same with the middle diagonal (k = 2) of ``matrix``."""
    middle = matrix.where("k = 2").select(*frame(matrix), "y", "x", "v")
    return _solve_blocks(fuse(d0=d0, d1=d1, od=od, x0=x0, x1=x1, m=middle), F.col("m"), eps)
