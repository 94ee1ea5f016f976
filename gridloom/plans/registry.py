"""Query name -> (Spark callable, oracle SQL)."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ieee import OPS, apply, on_grid
from gridloom.operators import elementwise as E
from gridloom.operators import flow, grid, sparse, stap
from gridloom.plans.fixtures import ALPHA, ASYMMETRIC, CELLS, DIA_OFFSETS, FIVE_POINT, LAMBDA, N_DOP, SIDE, STEERING, TDOF, Fixtures, with_fixtures
from gridloom.plans.iterate import cg_step, iterate, red_black_sweep, shared_folder
from gridloom.sources.tensors import SpMat2D, Stencil, coo_from_packed_csr, dia_from_packed, image, load
from gridloom.streaming.frames import each_frame, stream_of

SIGN = dict(zip(OPS, "+-*/"))
_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def _q(e: str, digits: int = 9) -> str:
    return f"floor({e} * 1e{digits} + 0.5)::BIGINT / 1e{digits}::DOUBLE"


def _rounded(df: DataFrame, *values: str, digits: int = 9) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in values], *[on_grid(F.col(c), digits).alias(c) for c in values])


def _add(name: str, plan, sql: str | None, *values: str, digits: int = 9) -> None:
    """Registers plan(fixtures); ``values`` are brought to a grid of 1e-9 on both sides, or of fewer digits where sums of many cells go into each value."""
    values = values or ("v",)
    _QUERIES[name] = lambda spark, sf_dir: _rounded(plan(Fixtures(spark, sf_dir)), *values, digits=digits)
    if sql:
        _ORACLES[name] = sql


def _elementwise() -> None:
    for op, sign in SIGN.items():
        _add(f"scalar_op_{op}", lambda f, op=op: E.scalar_op(op, f.scalar("sum(o_totalprice) / 1e10", "orders"), f.scalar("count(1) / 1e3", "part")), with_fixtures("scalar_a", "scalar_b") + f"SELECT {_q(f'(a.v {sign} b.v)')} AS v FROM scalar_a a, scalar_b b")
        _add(f"array_op_{op}", lambda f, op=op: E.array_op(op, f.vec_orders(), f.vec_orders2()), with_fixtures("vec_orders", "vec_orders2") + f"SELECT i, {_q(f'(a.v {sign} b.v)')} AS v FROM vec_orders a JOIN vec_orders2 b USING (i)")
        _add(f"array2d_op_{op}", lambda f, op=op: E.array_op(op, f.img(0), E.array_scalar_op("add", f.img(1), 2.0)), with_fixtures("img_a", "img_b") + f"SELECT f, y, x, {_q(f'(a.v {sign} (b.v + 2.0))')} AS v FROM img_a a JOIN img_b b USING (f, y, x)")
        _add(f"array3d_op_{op}", lambda f, op=op: E.array_op(op, f.cube(0), E.array_scalar_op("add", f.cube(1), 2.0)), with_fixtures("cube_a", "cube_b") + f"SELECT z, y, x, {_q(f'(a.v {sign} (b.v + 2.0))')} AS v FROM cube_a a JOIN cube_b b USING (z, y, x)")
        for name, table, keys, get in (("array", "vec_orders2", "i", lambda f: f.vec_orders2()), ("array2d", "psi", "f, y, x", lambda f: f.psi()), ("array3d", "cube_a", "z, y, x", lambda f: E.array_scalar_op("add", f.cube(0), 2.0))):
            value = "(v + 2.0)" if name == "array3d" else "v"
            needs = with_fixtures(*(("img_a",) if table == "psi" else ()), table, "scalar_b")
            _add(f"{name}_scalar_op_{op}", lambda f, op=op, get=get: E.array_scalar_op(op, get(f), f.scalar("count(1) / 1e3", "part")), needs + f"SELECT {keys}, {_q(f'({value} {sign} (SELECT v FROM scalar_b))')} AS v FROM {table}")
            _add(f"scalar_{name}_op_{op}", lambda f, op=op, get=get: E.scalar_array_op(op, f.scalar("count(1) / 1e3", "part"), get(f)), needs + f"SELECT {keys}, {_q(f'((SELECT v FROM scalar_b) {sign} {value})')} AS v FROM {table}")
    _QUERIES["int_div_trunc"] = lambda spark, d: Fixtures(spark, d).table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", apply("div", F.col("l_partkey") - 700, F.col("l_linenumber") - 8, integer=True).alias("v"))
    _ORACLES["int_div_trunc"] = "SELECT l_orderkey, l_partkey, l_linenumber, ((l_partkey - 700) // (l_linenumber - 8))::BIGINT AS v FROM lineitem"
    second = lambda f: f.snapshots().select("p", "c", "d", (F.col("im") + 2).alias("re"), (F.col("re") - 0.5).alias("im"))
    pair = with_fixtures("snapshots") + ", pair AS (SELECT p, c, d, re AS a, im AS b, im + 2 AS u, re - 0.5 AS w FROM snapshots) "
    parts = {"add": ("a + u", "b + w"), "sub": ("a - u", "b - w"), "mul": ("a * u - b * w", "a * w + b * u"), "div": ("(a * u + b * w) / (u * u + w * w)", "(b * u - a * w) / (u * u + w * w)")}
    for op, sign in SIGN.items():
        name = "hadamard_components" if op == "mul" else f"hadamard_components_{op}"
        _add(name, lambda f, op=op: E.hadamard_components(op, f.snapshots(), second(f)), pair + f"SELECT p, c, d, {_q(f'(a {sign} u)')} AS re, {_q(f'(b {sign} w)')} AS im FROM pair", "re", "im")
        _add(f"complex_op_{op}", lambda f, op=op: E.complex_op(op, f.snapshots(), second(f)), pair + f"SELECT p, c, d, {_q(f'({parts[op][0]})')} AS re, {_q(f'({parts[op][1]})')} AS im FROM pair", "re", "im")
    _add("scalar_sqrt", lambda f: E.sqrt(f.scalar("sum(o_totalprice) / 1e10", "orders")), with_fixtures("scalar_a") + f"SELECT {_q('sqrt(v)')} AS v FROM scalar_a")
    _add("array_sqrt", lambda f: E.sqrt(f.vec_orders()), with_fixtures("vec_orders") + f"SELECT i, {_q('sqrt(v)')} AS v FROM vec_orders")
    _add("array2d_sqrt", lambda f: E.sqrt(f.psi()), with_fixtures("img_a", "psi") + f"SELECT f, y, x, {_q('sqrt(v)')} AS v FROM psi")
    _add("scalar_copy", lambda f: E.copy(f.scalar("count(1) / 1e3", "part")), with_fixtures("scalar_b") + "SELECT v FROM scalar_b")
    _add("array_copy", lambda f: E.copy(f.vec_orders()), with_fixtures("vec_orders") + f"SELECT i, {_q('v')} AS v FROM vec_orders")
    _add("array2d_copy", lambda f: E.copy(f.img(0)), with_fixtures("img_a") + f"SELECT f, y, x, {_q('v')} AS v FROM img_a")
    _add("array3d_copy", lambda f: E.copy(f.cube(0)), with_fixtures("cube_a") + f"SELECT z, y, x, {_q('v')} AS v FROM cube_a")
    _add("return_tuple", lambda f: E.fuse(v=f.img(0), w=f.psi()), with_fixtures("img_a", "psi") + f"SELECT f, y, x, {_q('a.v')} AS v, {_q('p.v')} AS w FROM img_a a JOIN psi p USING (f, y, x)", "v", "w")


def _reductions() -> None:
    _QUERIES["array_sum_int"] = lambda spark, d: E.total(Fixtures(spark, d).table("lineitem").select(F.col("l_linenumber").cast("long").alias("v")))
    _ORACLES["array_sum_int"] = "SELECT sum(l_linenumber)::BIGINT AS v FROM lineitem"
    _add("array_sum", lambda f: E.array_scalar_op("div", E.total(f.vec_orders()), 1e6), with_fixtures("vec_orders") + f"SELECT {_q('(sum(v) / 1e6)')} AS v FROM vec_orders")
    _add("array2d_sum", lambda f: E.total(f.img(0), ("f",)), with_fixtures("img_a") + f"SELECT f, {_q('sum(v)')} AS v FROM img_a GROUP BY f")
    _add("dot", lambda f: E.array_scalar_op("div", E.dot(f.vec_orders(), f.vec_orders2()), 1e6), with_fixtures("vec_orders", "vec_orders2") + f"SELECT {_q('(sum(a.v * b.v) / 1e6)')} AS v FROM vec_orders a JOIN vec_orders2 b USING (i)")
    _add("norm", lambda f: E.array_scalar_op("div", E.norm(f.vec_orders()), 1e3), with_fixtures("vec_orders") + f"SELECT {_q('(sqrt(sum(v * v)) / 1e3)')} AS v FROM vec_orders")


_CSR = with_fixtures("csr_lineitem", "vec_part", "vec_orders")


def _product(f: Fixtures) -> DataFrame:
    return sparse.spmv_csr(f.csr_lineitem(), f.vec_part(), f.vec_orders())


def _sparse() -> None:
    product = "SELECT o.i, coalesce(s.v, 0.0) AS v FROM vec_orders o LEFT JOIN (SELECT a.i, sum(a.v * x.v) AS v FROM csr_lineitem a JOIN vec_part x ON a.j = x.i GROUP BY a.i) s ON o.i = s.i"
    _add("spmv_csr", _product, _CSR + f"SELECT i, {_q('v')} AS v FROM ({product})")
    _add("residual", lambda f: E.array_op("sub", _product(f), f.vec_orders()), _CSR + f"SELECT o.i, {_q('(p.v - o.v)')} AS v FROM ({product}) p JOIN vec_orders o ON p.i = o.i")
    _add("residual_norm", lambda f: E.array_scalar_op("div", E.norm(E.array_op("sub", _product(f), f.vec_orders())), 1e6), _CSR + f"SELECT {_q('(sqrt(sum((p.v - o.v) * (p.v - o.v))) / 1e6)')} AS v FROM ({product}) p JOIN vec_orders o ON p.i = o.i")

    def dia(f: Fixtures) -> DataFrame:
        return sparse.spmv_dia(f.dia_part(), DIA_OFFSETS, f.vec_part(), f.table("part").count())

    _add("spmv_dia", dia, with_fixtures("dia_part", "vec_part") + f"SELECT x.i, {_q('coalesce(s.v, 0.0)')} AS v FROM vec_part x LEFT JOIN (SELECT d.j - d.off AS i, sum(d.v * x.v) AS v FROM dia_part d JOIN vec_part x ON d.j = x.i GROUP BY ALL) s ON x.i = s.i")
    _add("spmv_dia2d", lambda f: sparse.spmv_dia2d(flow.set_brox_matrix(f.psi(), ALPHA, SIDE, SIDE), flow.BROX_OFFSETS, f.img(0), SIDE, SIDE), with_fixtures("img_a", "psi") + f", m AS ({_brox_sql((0, 1, 2, 3, 4))}), o(k, ox, oy) AS (VALUES (0, 0, -1), (1, -1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 1)) SELECT t.f, t.y, t.x, {_q('sum(m.v * s.v)')} AS v FROM img_a t JOIN o ON true JOIN m ON m.f = t.f AND m.k = o.k AND m.y = t.y + o.oy AND m.x = t.x + o.ox JOIN img_a s ON s.f = m.f AND s.y = m.y AND s.x = m.x GROUP BY t.f, t.y, t.x")


def _brox_sql(ks: tuple) -> str:
    """Each coefficient at its source cell, written from the cell that it belongs to."""
    t = f"(SELECT p.f, p.y, p.x, {ALPHA}::DOUBLE * p.v AS own, {ALPHA}::DOUBLE * u.v AS up, {ALPHA}::DOUBLE * l.v AS lft FROM psi p LEFT JOIN psi u ON u.f = p.f AND u.y = p.y - 1 AND u.x = p.x LEFT JOIN psi l ON l.f = p.f AND l.y = p.y AND l.x = p.x - 1)"
    last = SIDE - 1
    parts = (
        f"y - 1 AS y, x, -up AS v FROM {t} WHERE y > 0",
        f"y, x - 1 AS x, -lft AS v FROM {t} WHERE x > 0",
        f"y, x, coalesce(up, 0) + coalesce(lft, 0) + CASE WHEN x < {last} THEN own ELSE 0 END + CASE WHEN y < {last} THEN own ELSE 0 END AS v FROM {t}",
        f"y, x + 1 AS x, -own AS v FROM {t} WHERE x < {last}",
        f"y + 1 AS y, x, -own AS v FROM {t} WHERE y < {last}",
    )
    return " UNION ALL ".join(f"SELECT {k} AS k, f, {part}" for k, part in zip(ks, parts) if k is not None)


def _stencil_sql(taps: list, table: str = "img_a") -> str:
    values = ", ".join(f"({ox}, {oy}, {w}::DOUBLE)" for ox, oy, w in taps)
    last = SIDE - 1
    asked = f"SELECT t.f, t.y, t.x, o.w, least(greatest(t.y + o.oy, 0), {last}) AS sy, least(greatest(t.x + o.ox, 0), {last}) AS sx FROM {table} t, (VALUES {values}) AS o(ox, oy, w)"
    return f"SELECT q.f, q.y, q.x, sum(q.w * s.v) AS v FROM ({asked}) q JOIN {table} s ON s.f = q.f AND s.y = q.sy AND s.x = q.sx GROUP BY q.f, q.y, q.x"


def _grid() -> None:
    for name, parity, op in (("red", 0, grid.red), ("black", 1, grid.black)):
        _add(name, lambda f, op=op: op(f.img(0)), with_fixtures("img_a") + f"SELECT f, y, x, {_q(f'(CASE WHEN (x + y) % 2 = {parity} THEN v ELSE 0.0 END)')} AS v FROM img_a")
    _add("red_black_partition", lambda f: E.array_op("add", grid.red(f.img(0)), grid.black(f.img(0))), with_fixtures("img_a") + f"SELECT f, y, x, {_q('v')} AS v FROM img_a")
    _add("stencil_5pt", lambda f: grid.stencil(f.img(0), FIVE_POINT, SIDE, SIDE), with_fixtures("img_a") + f"SELECT f, y, x, {_q('v')} AS v FROM ({_stencil_sql(FIVE_POINT)})")
    _add("stencil_asym", lambda f: grid.stencil(f.img(0), ASYMMETRIC, SIDE, SIDE), with_fixtures("img_a") + f"SELECT f, y, x, {_q('v')} AS v FROM ({_stencil_sql(ASYMMETRIC)})")


def _flow() -> None:
    def warp(f: Fixtures) -> DataFrame:
        return flow.warp_img2d(f.img(0), E.scalar_array_op("mul", 5.0, f.img(1)), E.scalar_array_op("mul", -7.0, f.img(2)), SIDE, SIDE)

    shifted = "SELECT a.f, a.y, a.x, a.v AS s, 5.0::DOUBLE * b.v AS u, -7.0::DOUBLE * c.v AS w FROM img_a a JOIN img_b b USING (f, y, x) JOIN img_c c USING (f, y, x)"
    cells = "SELECT f, y, x, s, x + CASE WHEN u < 0 THEN trunc(u)::INT - 1 ELSE trunc(u)::INT END AS bx, y + CASE WHEN w < 0 THEN trunc(w)::INT - 1 ELSE trunc(w)::INT END AS byy, u - trunc(u) + CASE WHEN u < 0 THEN 1 ELSE 0 END AS fx, w - trunc(w) + CASE WHEN w < 0 THEN 1 ELSE 0 END AS fy FROM shifted"
    taps = "SELECT c.f, c.y, c.x, sum(CASE WHEN t.dx = 0 THEN 1 - fx ELSE fx END * CASE WHEN t.dy = 0 THEN 1 - fy ELSE fy END * i.v) AS v, count(i.v) AS n FROM cells c, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS t(dx, dy), img_a i WHERE i.f = c.f AND i.x = c.bx + t.dx AND i.y = c.byy + t.dy GROUP BY c.f, c.y, c.x"
    _add("warp", warp, with_fixtures("img_a", "img_b", "img_c") + f", shifted AS ({shifted}), cells AS ({cells}), taps AS ({taps}) SELECT c.f, c.y, c.x, {_q('(CASE WHEN t.n = 4 THEN t.v ELSE c.s END)')} AS v FROM cells c LEFT JOIN taps t USING (f, y, x)")
    for radius, inclusive in ((2, False), (5, False), (2, True)):
        box = f"RANGE BETWEEN {radius} PRECEDING AND {radius if inclusive else radius - 1} FOLLOWING"
        prods = "SELECT f, y, x, b.v * b.v AS xx, c.v * c.v AS yy, b.v * c.v AS xy, b.v * a.v AS xt, c.v * a.v AS yt FROM img_a a JOIN img_b b USING (f, y, x) JOIN img_c c USING (f, y, x)"
        names = ("xx", "yy", "xy", "xt", "yt")
        over = lambda part, order, box=box: ", ".join(f"sum({n}) OVER (PARTITION BY f, {part} ORDER BY {order} {box}) AS {n}" for n in names)
        sums = f"SELECT f, y, x, {over('x', 'y')} FROM (SELECT f, y, x, {over('y', 'x')} FROM ({prods}))"
        good = f"x BETWEEN {radius} AND {SIDE - radius - 1} AND y BETWEEN {radius} AND {SIDE - radius - 1} AND xx * yy - xy * xy <> 0"
        _add(f"lk_r{radius}" + ("_inclusive" if inclusive else ""), lambda f, radius=radius, inclusive=inclusive: flow.lk_least_squares(f.img(0), f.img(1), f.img(2), radius, SIDE, SIDE, inclusive), with_fixtures("img_a", "img_b", "img_c") + f"SELECT f, y, x, {_q(f'(CASE WHEN {good} THEN (xt * yy - xy * yt) / (xx * yy - xy * xy) ELSE 0.0 END)')} AS du, {_q(f'(CASE WHEN {good} THEN (xx * yt - xy * xt) / (xx * yy - xy * xy) ELSE 0.0 END)')} AS dv FROM ({sums})", "du", "dv")
    power = lambda z: f"s{z} AS (SELECT c.f, c.y, c.x, c.ix, c.iy, c.ix * (c.ix * c.u + c.iy * c.w) + {LAMBDA}::DOUBLE * sum(coalesce(c.u - n.u, 0)) AS u, c.iy * (c.ix * c.u + c.iy * c.w) + {LAMBDA}::DOUBLE * sum(coalesce(c.w - n.w, 0)) AS w FROM s{z - 1} c LEFT JOIN s{z - 1} n ON n.f = c.f AND abs(n.y - c.y) + abs(n.x - c.x) = 1 AND n.y BETWEEN c.y - 1 AND c.y + 1 GROUP BY c.f, c.y, c.x, c.ix, c.iy, c.u, c.w)"
    start = "s0 AS (SELECT f, y, x, a.v AS ix, b.v AS iy, c.v AS u, a.v + b.v AS w FROM img_a a JOIN img_b b USING (f, y, x) JOIN img_c c USING (f, y, x))"
    _add("hs_matrix_powers", lambda f: flow.hs_matrix_powers(LAMBDA, f.img(0), f.img(1), f.img(2), E.array_op("add", f.img(0), f.img(1)), 3), with_fixtures("img_a", "img_b", "img_c") + f", {start}, {power(1)}, {power(2)} " + " UNION ALL ".join(f"SELECT f, {z} AS z, y, x, {_q('u')} AS v0, {_q('w')} AS v1 FROM s{z}" for z in range(3)), "v0", "v1")
    base = with_fixtures("img_a", "psi")
    _add("set_brox", lambda f: flow.set_brox_matrix(f.psi(), ALPHA, SIDE, SIDE), base + f"SELECT f, k, y, x, {_q('v')} AS v FROM ({_brox_sql((0, 1, 2, 3, 4))})")
    _add("set_brox_redblack", lambda f: flow.set_brox_redblack_matrix(f.psi(), ALPHA, SIDE, SIDE)[0], base + f"SELECT f, k, y, x, {_q('v')} AS v FROM ({_brox_sql((0, 1, None, 2, 3))})")
    _add("set_brox_redblack_diagonal", lambda f: flow.set_brox_redblack_matrix(f.psi(), ALPHA, SIDE, SIDE)[1], base + f"SELECT f, y, x, {_q('v')} AS v FROM ({_brox_sql((None, None, 0, None, None))})")
    images = lambda f: (f.psi(), E.array_scalar_op("add", f.psi(), 0.5), f.img(1), f.img(2), f.img(0))
    solved = ", ".join(f"{_q(e)} AS {n}" for n, e in (("y0", "((x0 * d - od * x1) / (a * d - od * od))"), ("y1", "((a * x1 - od * x0) / (a * d - od * od))")))
    joined = "SELECT f, y, x, p.v + {0} AS a, p.v + 0.5 + {0} AS d, b.v AS od, c.v AS x0, i.v AS x1 FROM psi p JOIN img_b b USING (f, y, x) JOIN img_c c USING (f, y, x) JOIN img_a i USING (f, y, x)"
    count = f"{LAMBDA} * ((x > 0)::INT + (x < {SIDE - 1})::INT + (y > 0)::INT + (y < {SIDE - 1})::INT)"
    _add("hs_precond", lambda f: flow.apply_hs_preconditioner(FIVE_POINT, *images(f), SIDE, SIDE), with_fixtures("img_a", "img_b", "img_c", "psi") + f"SELECT f, y, x, {solved} FROM ({joined.format(count)})", "y0", "y1")
    _add("brox_precond", lambda f: flow.apply_brox_preconditioner(flow.set_brox_matrix(f.psi(), ALPHA, SIDE, SIDE), *images(f)), with_fixtures("img_a", "img_b", "img_c", "psi") + f", m AS ({_brox_sql((None, None, 2, None, None))}) SELECT f, y, x, {solved} FROM ({joined.format('m.v')} JOIN m USING (f, y, x))", "y0", "y1")


    # cells of odd parity have a determinant of 0 and keep their values
    kept = ", ".join(f"{_q(e)} AS {n}" for n, e in (("y0", "(CASE WHEN (x + y) % 2 = 0 THEN x0 / a ELSE x0 END)"), ("y1", "(CASE WHEN (x + y) % 2 = 0 THEN x1 / d ELSE x1 END)")))
    halves = lambda f, extra=None: (grid.red(f.psi()) if extra is None else E.array_op("sub", grid.red(f.psi()), extra), E.array_scalar_op("add", f.psi(), 0.5), E.array_scalar_op("mul", f.img(0), 0.0), f.img(1), f.img(2))
    single = "SELECT f, y, x, p.v AS a, p.v + 0.5 + {0} AS d, b.v AS x0, c.v AS x1 FROM psi p JOIN img_b b USING (f, y, x) JOIN img_c c USING (f, y, x)"
    needs = with_fixtures("img_a", "img_b", "img_c", "psi")
    _add("hs_precond_singular", lambda f: flow.apply_hs_preconditioner([(0, 0, 0.0)] * 3, *halves(f), SIDE, SIDE), needs + f"SELECT f, y, x, {kept} FROM ({single.format(0)})", "y0", "y1")

    def brox_singular(f: Fixtures) -> DataFrame:
        matrix = flow.set_brox_matrix(f.psi(), ALPHA, SIDE, SIDE)
        return flow.apply_brox_preconditioner(matrix, *halves(f, matrix.where("k = 2").select("f", "y", "x", "v")))

    _add("brox_precond_singular", brox_singular, needs + f", m AS ({_brox_sql((None, None, 2, None, None))}) SELECT f, y, x, {kept} FROM ({single.format('m.v')} JOIN m USING (f, y, x))", "y0", "y1")


def _solve_sql() -> str:
    """Cramer's rule for 3 x 3 complex systems: cofactors, determinant, adjugate times right-hand side."""
    mul = lambda a, b: (f"({a[0]} * {b[0]} - {a[1]} * {b[1]})", f"({a[0]} * {b[1]} + {a[1]} * {b[0]})")
    add = lambda *t: tuple("(" + " + ".join(x[k] for x in t) + ")" for k in (0, 1))
    sub = lambda a, b: tuple(f"({x} - {y})" for x, y in zip(a, b))
    m = lambda i, j: (f"r{i}{j}", f"i{i}{j}")
    c = lambda i, j: (f"cr{i}{j}", f"ci{i}{j}")
    nine = [(i, j) for i in range(3) for j in range(3)]
    wide = ", ".join(f"max(CASE WHEN i = {i} AND j = {j} THEN {part} END) AS {name}{i}{j}" for i, j in nine for name, part in (("r", "re"), ("i", "im")))
    cofactors = []
    for i, j in nine:
        (a, b), (u, w) = [(i + k) % 3 for k in (1, 2)], [(j + k) % 3 for k in (1, 2)]
        e = sub(mul(m(a, u), m(b, w)), mul(m(a, w), m(b, u)))
        cofactors += [f"{e[0]} AS cr{i}{j}", f"{e[1]} AS ci{i}{j}"]
    det = add(*(mul(m(0, j), c(0, j)) for j in range(3)))
    solved = []
    for d in range(3):  # w[d] = sum over i of C[i][d] * t[i] / det
        top = add(*(mul(c(i, d), (f"t{i}.re", f"t{i}.im")) for i in range(3)))
        solved.append(f"SELECT p, t0.s, {d} AS d, {top[0]} AS re, {top[1]} AS im, dr, di FROM dets, steering t0, steering t1, steering t2 WHERE t0.d = 0 AND t1.d = 1 AND t2.d = 2 AND t1.s = t0.s AND t2.s = t0.s")
    cov = "SELECT a.p, a.d AS i, b.d AS j, sum(a.re * b.re + a.im * b.im) + CASE WHEN a.d = b.d THEN 0.1 ELSE 0 END AS re, sum(a.im * b.re - a.re * b.im) AS im FROM snapshots a JOIN snapshots b ON a.p = b.p AND a.c = b.c GROUP BY a.p, a.d, b.d"
    size = "(dr * dr + di * di)"
    return (
        with_fixtures("snapshots", "steering") + f", cov AS ({cov}), wide AS (SELECT p, {wide} FROM cov GROUP BY p), cofactors AS (SELECT *, {', '.join(cofactors)} FROM wide), "
        f"dets AS (SELECT *, {det[0]} AS dr, {det[1]} AS di FROM cofactors), solved AS ({' UNION ALL '.join(solved)}) "
        f"SELECT p, s, d, {_q(f'((re * dr + im * di) / {size})')} AS re, {_q(f'((im * dr - re * di) / {size})')} AS im FROM solved"
    )


def _stap() -> None:
    snap = f"SELECT ((cell // {CELLS}) * {N_DOP} + (dop + {(TDOF - 1) // 2} - f + {N_DOP}) % {N_DOP})::BIGINT AS p, (cell % {CELLS})::INT AS c, (chan * {TDOF} + f)::INT AS d, {_q('re')} AS re, {_q('im')} AS im FROM datacube, range(0, {TDOF}) AS r(f)"
    _add("extract_snapshots", lambda f: stap.extract_snapshots(f.datacube(), N_DOP, TDOF, CELLS), with_fixtures("datacube") + snap, "re", "im")
    _add("cgemm", lambda f: stap.cgemm_batch(f.snapshots()), with_fixtures("snapshots") + f"SELECT a.p, a.d AS i, b.d AS j, {_q('sum(a.re * b.re + a.im * b.im)')} AS re, {_q('sum(a.im * b.re - a.re * b.im)')} AS im FROM snapshots a JOIN snapshots b ON a.p = b.p AND a.c = b.c GROUP BY a.p, a.d, b.d", "re", "im")
    steering = np.array(STEERING)
    loaded = lambda f: stap.cgemm_batch(f.snapshots()).withColumn("re", F.col("re") + F.when(F.col("i") == F.col("j"), 0.1).otherwise(0.0))
    _add("solve", lambda f: stap.solve_batch(loaded(f), steering), _solve_sql(), "re", "im")
    gamma = "SELECT p, s, are / (are * are + aim * aim) AS re, aim / (are * are + aim * aim) AS im FROM (SELECT w.p, w.s, sum(w.re * t.re + w.im * t.im) AS are, sum(w.re * t.im - w.im * t.re) AS aim FROM weights w JOIN steering t USING (s, d) GROUP BY w.p, w.s)"
    _add("gamma", lambda f: stap.gamma_weights(f.weights(), stap.steering_frame(f.spark, steering)), with_fixtures("weights", "steering") + f"SELECT p, s, {_q('re')} AS re, {_q('im')} AS im FROM ({gamma})", "re", "im")
    inverse = "CASE WHEN are * are + aim * aim > 0 THEN 1 / sqrt(are * are + aim * aim) ELSE 1 END"
    _add("gamma_magnitude", lambda f: stap.gamma_weights(f.weights(), stap.steering_frame(f.spark, steering), "magnitude"), with_fixtures("weights", "steering") + f"SELECT p, s, {_q(f'({inverse})')} AS re, 0.0::DOUBLE AS im FROM ({gamma.split('FROM (', 1)[1].rsplit(')', 1)[0]})", "re", "im")
    sums = "SELECT n.p, n.c, w.s, sum(n.re * w.re + n.im * w.im) AS re, sum(n.re * w.im - n.im * w.re) AS im FROM snapshots n JOIN weights w USING (p, d) GROUP BY n.p, n.c, w.s"
    _add("inner_products", lambda f: stap.inner_products(f.snapshots(), f.weights(), stap.gamma_weights(f.weights(), stap.steering_frame(f.spark, steering))), with_fixtures("snapshots", "weights", "steering") + f", g AS ({gamma}), i AS ({sums}) SELECT i.p, i.c, i.s, {_q('(i.re * g.re - i.im * g.im)')} AS re, {_q('(i.re * g.im + i.im * g.re)')} AS im FROM i JOIN g USING (p, s)", "re", "im")


def _recipes() -> None:
    five = lambda f: lambda p: grid.stencil(p, FIVE_POINT, SIDE, SIDE)
    cg = (
        f", ap AS ({_stencil_sql(FIVE_POINT)}), n AS (SELECT a.f, a.y, a.x, a.v AS s, ap.v AS t FROM img_a a JOIN ap USING (f, y, x)), k AS (SELECT f, sum(s * s) AS rr, sum(s * t) AS pap FROM n GROUP BY f), "
        "m AS (SELECT f, y, x, rr / pap * s AS nx, s - rr / pap * t AS nr, s, rr FROM n JOIN k USING (f)), q AS (SELECT f, sum(nr * nr) AS nrr FROM m GROUP BY f) "
    )
    zero = lambda f: E.array_scalar_op("mul", f.img(0), 0.0)
    _add("cg_step", lambda f: cg_step(five(f), zero(f), f.img(0), f.img(0)), with_fixtures("img_a") + cg + f"SELECT f, y, x, {_q('nx', 6)} AS nx, {_q('nr', 6)} AS nr, {_q('(nr + nrr / rr * s)', 6)} AS np FROM m JOIN q USING (f)", "nx", "nr", "np", digits=6)
    quarter = [(0, -1, 0.25), (-1, 0, 0.25), (1, 0, 0.25), (0, 1, 0.25)]
    first = f", a1 AS ({_stencil_sql(quarter)}), u1 AS (SELECT f, y, x, CASE WHEN (x + y) % 2 = 0 THEN a1.v ELSE i.v END AS v FROM a1 JOIN img_a i USING (f, y, x)), a2 AS ({_stencil_sql(quarter, 'u1')}) "
    _add("red_black_sweep", lambda f: red_black_sweep(f.img(0), SIDE, SIDE), with_fixtures("img_a") + first + f"SELECT f, y, x, {_q('(CASE WHEN (x + y) % 2 = 1 THEN a2.v ELSE u1.v END)')} AS v FROM a2 JOIN u1 USING (f, y, x)")


    thrice = ", ".join(f"u{k} AS ({_stencil_sql(quarter, f'u{k - 1}')})" for k in (1, 2, 3))
    average = lambda f: lambda u: grid.stencil(u, quarter, SIDE, SIDE)
    _add("iterate_average", lambda f: iterate(average(f), f.img(0), 3, every=2), with_fixtures("img_a") + f", u0 AS (SELECT * FROM img_a), {thrice} SELECT f, y, x, {_q('v')} AS v FROM u3")


def _sources() -> None:
    """Sources and adapters, each followed by what reads it."""
    row = lambda f: f.csr_lineitem().groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e")).select("i", F.col("e.j").alias("indices"), F.col("e.v").alias("data"))
    _add("csr_packed", lambda f: coo_from_packed_csr(row(f)), with_fixtures("csr_lineitem") + f"SELECT i, j, {_q('v')} AS v FROM csr_lineitem")

    def packed_diagonals(f: Fixtures) -> DataFrame:
        runs = f.dia_part().groupBy("k", F.expr("j div 100").alias("run")).agg(F.min("j").alias("begin"), F.sort_array(F.collect_list(F.struct("j", "v"))).alias("e"))
        return dia_from_packed(runs.select("k", "begin", F.col("e.v").alias("data")))

    _add("dia_packed", packed_diagonals, with_fixtures("dia_part") + f"SELECT k, j, {_q('v')} AS v FROM dia_part")
    shape = Stencil(np.array([w for _, _, w in ASYMMETRIC]), np.array([x for x, _, _ in ASYMMETRIC]), np.array([y for _, y, _ in ASYMMETRIC]))
    _add("stencil_object", lambda f: grid.stencil(f.img(1), shape.taps, SIDE, SIDE), with_fixtures("img_b") + f"SELECT f, y, x, {_q('v')} AS v FROM ({_stencil_sql(ASYMMETRIC, 'img_b')})")
    k, y, x = np.indices((2, SIDE, SIDE))
    band = SpMat2D((k + 1) * (y - x) / 64.0, np.array([0, 1]), np.array([0, 0]))
    cells = f"SELECT k, y, x, (k + 1) * (y - x) / 64.0::DOUBLE AS v FROM range(0, 2) AS a(k), range(0, {SIDE}) AS b(y), range(0, {SIDE}) AS c(x)"
    _add("spmat2d_object", lambda f: sparse.spmv_dia2d(band.frame(f.spark), band.offsets, f.img(0), SIDE, SIDE), with_fixtures("img_a") + f", m AS ({cells}) SELECT t.f, t.y, t.x, {_q('sum(m.v * s.v)')} AS v FROM img_a t JOIN m ON m.y = t.y AND m.x IN (t.x, t.x + 1) AND m.x = t.x + m.k JOIN img_a s ON s.f = t.f AND s.y = m.y AND s.x = m.x GROUP BY t.f, t.y, t.x")

    def streamed(spark, d: str) -> DataFrame:
        at = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
        plan = lambda rows: grid.red(image(rows, F.col("vec_id") % SIDE, F.col("embedding"), F.expr(f"vec_id div {SIDE}")))
        each_frame(stream_of(spark, f"{d}/embeddings.parquet"), plan, f"{at}/out", f"{at}/state").awaitTermination()
        return _rounded(load(spark, f"{at}/out").drop("frame"), "v")

    _QUERIES["stream_red"] = streamed
    _ORACLES["stream_red"] = f"SELECT (vec_id // {SIDE})::INT AS f, (vec_id % {SIDE})::INT AS y, x::INT AS x, {_q('(CASE WHEN (x + vec_id % 64) % 2 = 0 THEN v ELSE 0.0 END)')} AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings)"


for _part in (_elementwise, _reductions, _sparse, _grid, _flow, _stap, _recipes, _sources):
    _part()


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
