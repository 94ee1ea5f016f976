import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.operators import elementwise as E
from gridloom.operators import flow, grid, sparse, stap
from gridloom.plans import registry
from gridloom.plans.fixtures import ASYMMETRIC
from gridloom.plans.iterate import cg_step, iterate_until, red_black_sweep
from gridloom.sources.tensors import SpMat2D, Stencil, dia_from_arrays, dia_from_packed, from_numpy, to_numpy

RNG = np.random.default_rng(3)
QUARTER = [(0, -1, 0.25), (-1, 0, 0.25), (1, 0, 0.25), (0, 1, 0.25)]


def rows(df):
    return {tuple(r[c] for c in df.columns if c in ("f", "z", "k", "y", "x")): tuple(round(r[c], 9) for c in df.columns if c not in ("f", "z", "k", "y", "x")) for r in df.collect()}


def test_frames_of_a_batch_are_treated_apart(spark):
    """Each operator on two frames at once gives what it gives on each alone."""
    images = [[from_numpy(spark, a) for a in RNG.normal(size=(5, 6, 7))] for _ in range(2)]
    batch = [a.select(F.lit(0).alias("f"), "*").unionByName(b.select(F.lit(1).alias("f"), "*")) for a, b in zip(*images)]
    square = lambda a: a.withColumn("v", 1 + F.col("v") * F.col("v"))
    plans = {
        "sum of two": lambda a, b, c, d, e: E.array_op("mul", a, b),
        "stencil": lambda a, b, c, d, e: grid.stencil(a, ASYMMETRIC, 6, 7),
        "red": lambda a, b, c, d, e: grid.red(a),
        "warp": lambda a, b, c, d, e: flow.warp_img2d(a, b, c, 6, 7),
        "windows": lambda a, b, c, d, e: flow.lk_least_squares(a, b, c, 1, 6, 7),
        "inclusive windows": lambda a, b, c, d, e: flow.lk_least_squares(a, b, c, 1, 6, 7, True),
        "powers": lambda a, b, c, d, e: flow.hs_matrix_powers(0.5, a, b, c, d, 3),
        "matrix": lambda a, b, c, d, e: flow.set_brox_matrix(square(a), 0.3, 6, 7),
        "product": lambda a, b, c, d, e: sparse.spmv_dia2d(flow.set_brox_matrix(square(a), 0.3, 6, 7), flow.BROX_OFFSETS, b, 6, 7),
        "precond": lambda a, b, c, d, e: flow.apply_brox_preconditioner(flow.set_brox_matrix(square(a), 0.3, 6, 7), square(a), square(b), c, d, e),
        "hs precond": lambda a, b, c, d, e: flow.apply_hs_preconditioner([(0, 0, 0.5)] * 3, square(a), square(b), c, d, e, 6, 7),
        "cg": lambda a, b, c, d, e: cg_step(lambda p: grid.stencil(p, QUARTER, 6, 7), a, b, c),
        "sweep": lambda a, b, c, d, e: red_black_sweep(a, 6, 7),
    }
    for name, plan in plans.items():
        got = rows(plan(*batch))
        want = {(k, *key): v for k in range(2) for key, v in rows(plan(*images[k])).items()}
        assert got == want, name
    sums = {r.f: r.v for r in E.total(batch[0], ("f",)).collect()}
    assert np.allclose([sums[0], sums[1]], [E.total(images[k][0]).first().v for k in range(2)])


def test_image_queries_read_all_vectors(spark, tmp_path):
    n = 200  # three frames and the first lines of a fourth
    e = RNG.normal(size=(n, 64)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(e)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    lines = lambda which: e.astype(float)[(np.arange(256) + 64 * which) % n].reshape(4, 64, 64)
    get = lambda q: to_numpy(registry.queries()[q](spark, str(tmp_path)).withColumnRenamed("f", "z"), (4, 64, 64))
    a, b = lines(0), lines(1)
    at = lambda oy, ox: a[:, np.clip(np.arange(64) + oy, 0, 63)][:, :, np.clip(np.arange(64) + ox, 0, 63)]
    assert np.allclose(get("array2d_copy"), a, atol=1e-8) and np.allclose(get("array2d_op_add"), a + b + 2, atol=1e-8)
    assert np.allclose(get("stencil_asym"), sum(w * at(oy, ox) for ox, oy, w in ASYMMETRIC), atol=1e-8)


@pytest.mark.parametrize("op", ["add", "sub", "mul", "div"])
def test_complex_arithmetic(spark, op):
    a, b = (RNG.normal(size=(3, 4)) + 1j * RNG.normal(size=(3, 4)) for _ in range(2))
    want = {"add": a + b, "sub": a - b, "mul": a * b, "div": a / b}[op]
    assert np.allclose(to_numpy(E.complex_op(op, from_numpy(spark, a), from_numpy(spark, b)), a.shape), want)
    parts = {"add": a + b, "sub": a - b, "mul": a.real * b.real + 1j * a.imag * b.imag, "div": a.real / b.real + 1j * a.imag / b.imag}[op]
    assert np.allclose(to_numpy(E.hadamard_components(op, from_numpy(spark, a), from_numpy(spark, b)), a.shape), parts)
    if op == "div":
        assert np.isnan(to_numpy(E.complex_op(op, from_numpy(spark, a), from_numpy(spark, b * 0)), a.shape)).all()


def test_scalars_are_one_row_and_sums_keep_their_type(spark):
    a = from_numpy(spark, np.arange(4))
    assert E.total(a).schema["v"].dataType.simpleString() == "bigint" and E.total(a).first().v == 6
    assert E.total(a, dtype="double").schema["v"].dataType.simpleString() == "double"
    assert E.total(a.withColumn("v", F.col("v").cast("float"))).schema["v"].dataType.simpleString() == "float"
    for bad in (a, a.limit(0)):
        with pytest.raises(PySparkException, match="no scalar"):
            E.array_scalar_op("add", a, bad.select("v")).collect()


def test_sparse_adapters(spark):
    data, offsets, x = RNG.normal(size=(3, 5)), [-1, 0, 3], RNG.normal(size=5)
    want = np.zeros(5)
    for k, off in enumerate(offsets):
        for j in range(5):
            if 0 <= j - off < 5:
                want[j - off] += data[k, j] * x[j]
    cells, found = dia_from_arrays(spark, data, np.array(offsets))
    assert np.allclose(to_numpy(sparse.spmv_dia(cells, found, from_numpy(spark, x), 5), (5,)), want)
    packed = spark.createDataFrame([(k, lo, data[k, lo:hi].tolist()) for k in range(3) for lo, hi in ((0, 2), (2, 5))], "k int, begin long, data array<double>")
    assert sorted(map(tuple, dia_from_packed(packed).collect())) == sorted(map(tuple, cells.collect()))
    taps = Stencil(np.array([0.5, -0.25]), np.array([0, 1]), np.array([0, -1])).taps
    assert taps == [(0, 0, 0.5), (1, -1, -0.25)]
    psi = RNG.random((4, 5))
    banded = SpMat2D(np.stack([psi, 2 * psi]), np.array([0, 1]), np.array([0, 0]))
    v = RNG.normal(size=(4, 5))
    got = to_numpy(sparse.spmv_dia2d(banded.frame(spark), banded.offsets, from_numpy(spark, v), 4, 5), (4, 5))
    wide = np.pad(psi * v * 2, ((0, 0), (0, 1)))[:, 1:]
    assert np.allclose(got, psi * v + wide)
    with pytest.raises(ValueError):
        SpMat2D(psi[None], np.array([0, 1]), np.array([0, 0])).frame(spark)


def test_loop_until_it_settles(spark):
    a = RNG.normal(size=(4, 4))
    change = lambda before, after: E.norm(E.array_op("sub", after, before))
    made, steps = iterate_until(lambda u: grid.stencil(u, QUARTER, 4, 4), from_numpy(spark, a), change, 0.2, 30)
    want, last = a, np.inf
    for n in range(1, 31):
        at = lambda oy, ox: want[np.clip(np.arange(4) + oy, 0, 3)][:, np.clip(np.arange(4) + ox, 0, 3)]  # noqa: B023, E731
        new = sum(w * at(oy, ox) for ox, oy, w in QUARTER)
        last, want = np.linalg.norm(new - want), new
        if last <= 0.2:
            break
    assert steps == n and np.allclose(to_numpy(made, (4, 4)), want)
    assert iterate_until(lambda u: u, from_numpy(spark, a), change, -1.0, 2)[1] == 2


def test_products_of_problems_of_many_snapshots(spark):
    s = RNG.normal(size=(3, 70, 4)) + 1j * RNG.normal(size=(3, 70, 4))
    got = stap.cgemm_batch(from_numpy(spark, s).withColumnsRenamed({"z": "p", "y": "c", "x": "d"}))
    cov = to_numpy(got.withColumnsRenamed({"p": "z", "i": "y", "j": "x"}), (3, 4, 4))
    assert np.allclose(cov, np.einsum("pci,pcj->pij", s, s.conj()))
