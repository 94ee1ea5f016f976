import numpy as np
import pytest

from gridloom.functions.ieee import apply
from gridloom.operators import elementwise as E
from gridloom.operators import flow, grid, sparse, stap
from gridloom.plans.iterate import iterate
from gridloom.sources.tensors import coo_from_csr, from_numpy, load, pack_rows, save, to_numpy

from pyspark.sql import functions as F

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("op", ["add", "sub", "mul", "div"])
def test_elementwise(spark, op):
    a, b = RNG.normal(size=(3, 4)), RNG.normal(size=(3, 4))
    want = {"add": a + b, "sub": a - b, "mul": a * b, "div": a / b}[op]
    assert np.allclose(to_numpy(E.array_op(op, from_numpy(spark, a), from_numpy(spark, b)), a.shape), want)
    left = {"add": 2 + a, "sub": 2 - a, "mul": 2 * a, "div": 2 / a}[op]
    assert np.allclose(to_numpy(E.scalar_array_op(op, 2.0, from_numpy(spark, a)), a.shape), left)


def test_division_corner_cases(spark):
    rows = spark.createDataFrame([(n, d) for n in (-1.0, 0.0, 1.0, float("nan")) for d in (0.0, 2.0)], "n double, d double")
    got = [r.v for r in rows.select(apply("div", F.col("n"), F.col("d")).alias("v")).collect()]
    assert np.array_equal(got, [-np.inf, -0.5, np.nan, 0.0, np.inf, 0.5, np.nan, np.nan], equal_nan=True)
    whole = spark.createDataFrame([(-7, 2), (7, -2), (7, 0)], "n long, d long")
    assert [r.v for r in whole.select(apply("div", F.col("n"), F.col("d"), integer=True).alias("v")).collect()] == [-3, -3, None]


def test_sums_roots_and_masks(spark):
    a = np.array([[4.0, np.nan], [np.inf, -9.0]])
    df = from_numpy(spark, a)
    assert np.isnan(E.total(df).first().v) and E.total(df.limit(0)).first().v == 0
    assert np.array_equal(to_numpy(E.sqrt(df), (2, 2)), [[2, np.nan], [np.inf, np.nan]], equal_nan=True)
    assert to_numpy(grid.red(df), (2, 2))[0, 1] == 0 and to_numpy(grid.black(df), (2, 2))[0, 0] == 0


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (5, 1), (3, 4), (8, 8)])
@pytest.mark.parametrize("taps", [[(0, 0, 1.0)], [(0, 0, 0.5), (1, 0, -0.25), (-2, 1, 0.75), (0, 1, 0.125)], [(3, -3, 1.0), (3, -3, 2.0), (-9, 9, 0.0)]])
def test_stencil(spark, shape, taps):
    a, (h, w) = RNG.normal(size=shape), shape
    want = np.zeros(shape)
    for y in range(h):
        for x in range(w):
            want[y, x] = sum(t * a[min(max(y + oy, 0), h - 1), min(max(x + ox, 0), w - 1)] for ox, oy, t in taps)
    assert np.allclose(to_numpy(grid.stencil(from_numpy(spark, a), taps, h, w), shape), want)


def test_sparse_products(spark):
    a = np.array([[0, 0, 0], [1, 0, 2], [0, 3, 0], [0, 0, 0]], float)
    x = RNG.normal(size=3)
    coo = coo_from_csr(spark, a[a != 0], np.nonzero(a)[1], [0, 0, 2, 3, 3])
    assert np.allclose(to_numpy(sparse.spmv_csr(coo, from_numpy(spark, x), spark.range(4).toDF("i")), (4,)), a @ x)
    data, offsets = RNG.normal(size=(3, 5)), [-1, 0, 3]
    x, want = RNG.normal(size=5), np.zeros(5)
    for k, off in enumerate(offsets):
        for j in range(5):
            if 0 <= j - off < 5:
                want[j - off] += data[k, j] * x[j]
    long = from_numpy(spark, data).select(F.col("y").alias("k"), F.col("x").cast("long").alias("j"), "v")
    assert np.allclose(to_numpy(sparse.spmv_dia(long, offsets, from_numpy(spark, x), 5), (5,)), want)


def brute_warp(s, u, v):
    h, w = s.shape
    out = s.copy()
    for y in range(h):
        for x in range(w):
            mx, my = int(np.trunc(u[y, x])), int(np.trunc(v[y, x]))
            fx, fy = u[y, x] - mx, v[y, x] - my
            mx, fx = (mx - 1, fx + 1) if u[y, x] < 0 else (mx, fx)
            my, fy = (my - 1, fy + 1) if v[y, x] < 0 else (my, fy)
            bx, by = x + mx, y + my
            if 0 <= bx and bx + 1 < w and 0 <= by and by + 1 < h:
                out[y, x] = s[by, bx] * (1 - fx) * (1 - fy) + s[by, bx + 1] * fx * (1 - fy) + s[by + 1, bx] * (1 - fx) * fy + s[by + 1, bx + 1] * fx * fy
    return out


@pytest.mark.parametrize("move", [0.0, -1.0, 1.0, 0.5, -0.5, 99.0])
def test_warp(spark, move):
    s = RNG.normal(size=(5, 6))
    u, v = np.full(s.shape, move), RNG.normal(size=s.shape)
    got = flow.warp_img2d(*(from_numpy(spark, a) for a in (s, u, v)), 5, 6)
    assert np.allclose(to_numpy(got, s.shape), brute_warp(s, u, v))


def test_flow_is_zero_where_singular_and_at_borders(spark):
    one = from_numpy(spark, np.ones((8, 8)))
    got = flow.lk_least_squares(one, one, one, 2, 8, 8).collect()
    assert len(got) == 64 and all(r.du == 0 and r.dv == 0 for r in got)


def test_diffusion_rows_sum_to_zero_and_powers_are_prefixes(spark):
    psi = from_numpy(spark, 1 + RNG.random((4, 5)))
    ones = from_numpy(spark, np.ones((4, 5)))
    assert np.allclose(to_numpy(sparse.spmv_dia2d(flow.set_brox_matrix(psi, 0.3, 4, 5), flow.BROX_OFFSETS, ones, 4, 5), (4, 5)), 0)
    off, diagonal = flow.set_brox_redblack_matrix(psi, 0.3, 4, 5)
    rest = sparse.spmv_dia2d(off, flow.BROX_REDBLACK_OFFSETS, ones, 4, 5)
    assert np.allclose(to_numpy(rest, (4, 5)), -to_numpy(diagonal, (4, 5)))
    two, three = (flow.hs_matrix_powers(0.5, psi, ones, psi, ones, n) for n in (2, 3))
    key = lambda df: sorted((r.z, r.y, r.x, round(r.v0, 9), round(r.v1, 9)) for r in df.collect())
    assert key(two) == key(three.where("z < 2"))


def test_preconditioners_copy_singular_cells(spark):
    zero, one = from_numpy(spark, np.zeros((3, 3))), from_numpy(spark, np.ones((3, 3)))
    got = flow.apply_hs_preconditioner([(0, 0, 0.0)] * 3, one, one, one, one, zero, 3, 3).collect()
    assert all((r.y0, r.y1) == (1.0, 0.0) for r in got)
    solved = flow.apply_hs_preconditioner([(0, 0, 1.0)] * 3, one, one, zero, one, one, 3, 3)
    assert to_numpy(solved.select("y", "x", F.col("y0").alias("v")), (3, 3))[1, 1] == 1 / 5


def test_radar_chain(spark):
    c = lambda *shape: RNG.normal(size=shape) + 1j * RNG.normal(size=shape)
    cube, (dop, tdof, block) = c(8, 4, 2), (4, 3, 4)
    frame = from_numpy(spark, cube).withColumnsRenamed({"z": "cell", "y": "dop", "x": "chan"})
    want = {(cell // block * dop + d, cell % block, ch * tdof + f): cube[cell, (d - 1 + f) % dop, ch] for cell in range(8) for d in range(dop) for ch in range(2) for f in range(tdof)}
    snap = stap.extract_snapshots(frame, dop, tdof, block)
    assert all(np.isclose(r.re + 1j * r.im, want[r.p, r.c, r.d]) for r in snap.collect()) and snap.count() == len(want)
    s = np.zeros((8, 4, 6), complex)
    for k, v in want.items():
        s[k] = v
    cov = np.einsum("pci,pcj->pij", s, s.conj()) + np.eye(6)
    loaded = stap.cgemm_batch(snap).withColumn("re", F.col("re") + (F.col("i") == F.col("j")).cast("double"))
    steering = c(2, 6)
    w = np.zeros((8, 2, 6), complex)
    for r in stap.solve_batch(loaded, steering).collect():
        w[r.p, r.s, r.d] = r.re + 1j * r.im
    assert np.allclose(np.einsum("pij,psj->psi", cov, w), steering[None])
    weights = from_numpy(spark, w).withColumnsRenamed({"z": "p", "y": "s", "x": "d"})
    a = np.einsum("psd,sd->ps", w.conj(), steering)
    gamma = stap.gamma_weights(weights, stap.steering_frame(spark, steering))
    assert all(np.isclose(r.re + 1j * r.im, a[r.p, r.s] / abs(a[r.p, r.s]) ** 2) for r in gamma.collect())
    out = np.einsum("pcd,psd->pcs", s.conj(), w) * (a / abs(a) ** 2)[:, None]
    assert all(np.isclose(r.re + 1j * r.im, out[r.p, r.c, r.s]) for r in stap.inner_products(snap, weights, gamma).collect())


def test_sources_loops_and_streams(spark, tmp_path):
    a = RNG.normal(size=(3, 4))
    save(from_numpy(spark, a), f"{tmp_path}/a")
    assert np.array_equal(to_numpy(load(spark, f"{tmp_path}/a"), (3, 4)), a)
    assert [list(r.row) for r in pack_rows(from_numpy(spark, a)).orderBy("y").collect()] == a.tolist()
    got = iterate(lambda df: E.array_scalar_op("add", df, 1.0), from_numpy(spark, a), 7)
    assert np.allclose(to_numpy(got, (3, 4)), a + 7)
    from gridloom.streaming.frames import each_frame

    stream = spark.readStream.schema("y int, x int, v double").parquet(f"{tmp_path}/a")
    each_frame(stream, grid.red, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert np.array_equal(to_numpy(load(spark, f"{tmp_path}/out").drop("frame"), (3, 4)), np.where(np.indices((3, 4)).sum(0) % 2 == 0, a, 0))
