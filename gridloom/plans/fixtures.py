"""Tensors derived from the test tables, and the same ones as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.tensors import image

SIDE = 64
DIA_OFFSETS = [-1, 0, 1, 3]
#: (offx, offy, w); tap 2 of the five-point operator is one +lambda, as the preconditioner adds it once a neighbour.
LAMBDA = 0.5
FIVE_POINT = [(0, -1, -LAMBDA), (-1, 0, -LAMBDA), (0, 0, LAMBDA), (1, 0, -LAMBDA), (0, 1, -LAMBDA), (0, 0, LAMBDA), (0, 0, LAMBDA), (0, 0, LAMBDA)]
ASYMMETRIC = [(0, 0, 0.5), (1, 0, -0.25), (-2, 1, 0.75), (0, 1, 0.125)]
ALPHA = 0.3
CELLS, N_DOP, N_CHAN, TDOF = 50, 8, 4, 3
STEERING = [[1 + 0.5j, -0.25 + 1j, 0.75 - 0.5j], [0.5 - 1j, 1 + 0.25j, -0.5 + 0.125j]]


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def vec_orders(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 1e5).alias("v"))

    def vec_orders2(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("i"), (1 + F.col("o_custkey") / 1e3).alias("v"))

    def vec_part(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("i"), (F.col("p_retailprice") / 1e3).alias("v"))

    def csr_lineitem(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))

    def dia_part(self) -> DataFrame:
        k = F.explode(F.sequence(F.lit(0), F.lit(len(DIA_OFFSETS) - 1)))
        return self.table("part").select(k.alias("k"), F.col("p_partkey").alias("j"), "p_size").select("k", "j", ((F.col("k") + 1) * F.col("p_size") / 50).alias("v"))

    def counted(self) -> DataFrame:
        """embeddings with their number ``n``, the one row of an aggregate."""
        e = self.table("embeddings")
        return e.crossJoin(F.broadcast(e.agg(F.count(F.lit(1)).alias("n"))))

    def img(self, which: int) -> DataFrame:
        """(f, y, x, v): all vectors as images of 64 x 64. Line y of frame f is vector 64 * (f + which) + y, counted round, so the last frame is whole too."""
        lines = F.sequence(F.pmod(F.col("vec_id") - SIDE * which, F.col("n")), F.expr(f"(n + {SIDE - 1}) div {SIDE} * {SIDE} - 1"), F.col("n"))
        rows = self.counted().select(F.explode(lines).alias("k"), "embedding")
        return image(rows, F.col("k") % SIDE, F.col("embedding"), F.expr(f"k div {SIDE}"))

    def psi(self) -> DataFrame:
        return self.img(0).withColumn("v", 1 + F.col("v") * F.col("v"))

    def cube(self, shift: int) -> DataFrame:
        rows = self.counted().select(F.pmod(F.col("vec_id") - shift, F.col("n")).cast("int").alias("z"), F.posexplode("embedding"))
        return rows.select("z", F.expr("CAST(pos div 8 AS INT)").alias("y"), (F.col("pos") % 8).alias("x"), F.col("col").cast("double").alias("v"))

    def datacube(self) -> DataFrame:
        e = self.table("embeddings").select(F.col("vec_id").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("q"), "embedding")
        at = lambda k: F.get("embedding", 2 * F.col("q") + k).cast("double")
        return e.select("cell", F.expr("CAST(q div 4 AS INT)").alias("dop"), (F.col("q") % 4).alias("chan"), at(0).alias("re"), at(1).alias("im"))

    def snapshots(self) -> DataFrame:
        e = self.table("embeddings").select(F.expr(f"vec_id div {CELLS}").alias("p"), (F.col("vec_id") % CELLS).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("d"), "embedding")
        at = lambda k: F.get("embedding", 2 * F.col("d") + k).cast("double")
        return e.select("p", "c", "d", at(0).alias("re"), at(1).alias("im"))

    def weights(self) -> DataFrame:
        """(p, s, d, re, im) from other components of the first vector of each block."""
        e = self.table("embeddings").where(F.col("vec_id") % CELLS == 0).select(F.expr(f"vec_id div {CELLS}").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("q"), "embedding")
        at = lambda k: F.get("embedding", 20 + 2 * F.col("q") + k).cast("double")
        return e.select("p", F.expr("CAST(q div 3 AS INT)").alias("s"), (F.col("q") % 3).alias("d"), at(0).alias("re"), at(1).alias("im"))

    def scalar(self, expression: str, table: str) -> DataFrame:
        return self.table(table).agg(F.expr(expression).alias("v"))


def _image_sql(which: int) -> str:
    lines = f"SELECT n, unnest(range(0, (n + {SIDE - 1}) // {SIDE} * {SIDE})) AS k FROM (SELECT count(*) AS n FROM embeddings)"
    return f"SELECT (k // {SIDE})::INT AS f, (k % {SIDE})::INT AS y, x::INT AS x, v::DOUBLE AS v FROM (SELECT k, unnest(range(0, 64)) AS x, unnest(embedding) AS v FROM ({lines}) JOIN embeddings ON vec_id = (k + {SIDE * which}) % n)"


_STEERING_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({s}, {d}, {w.real}::DOUBLE, {w.imag}::DOUBLE)" for s, line in enumerate(STEERING) for d, w in enumerate(map(complex, line))) + ") AS t(s, d, re, im)"

SQL = {
    "vec_orders": "SELECT o_orderkey AS i, o_totalprice / 1e5 AS v FROM orders",
    "vec_orders2": "SELECT o_orderkey AS i, 1 + o_custkey / 1e3 AS v FROM orders",
    "vec_part": "SELECT p_partkey AS i, p_retailprice / 1e3 AS v FROM part",
    "csr_lineitem": "SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL",
    "dia_part": "SELECT k, off, p_partkey AS j, (k + 1) * p_size / 50.0::DOUBLE AS v FROM part, (VALUES (0, -1), (1, 0), (2, 1), (3, 3)) AS o(k, off)",
    "img_a": _image_sql(0),
    "img_b": _image_sql(1),
    "img_c": _image_sql(2),
    "psi": "SELECT f, y, x, 1 + v * v AS v FROM img_a",
    "cube_a": "SELECT vec_id::INT AS z, (q // 8)::INT AS y, (q % 8)::INT AS x, v::DOUBLE AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS q, unnest(embedding) AS v FROM embeddings)",
    "cube_b": "SELECT ((vec_id - 1 + (SELECT count(*) FROM embeddings)) % (SELECT count(*) FROM embeddings))::INT AS z, (q // 8)::INT AS y, (q % 8)::INT AS x, v::DOUBLE AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS q, unnest(embedding) AS v FROM embeddings)",
    "datacube": "SELECT vec_id AS cell, (q // 4)::INT AS dop, (q % 4)::INT AS chan, embedding[2 * q + 1]::DOUBLE AS re, embedding[2 * q + 2]::DOUBLE AS im FROM embeddings, range(0, 32) AS r(q)",
    "snapshots": f"SELECT vec_id // {CELLS} AS p, (vec_id % {CELLS})::INT AS c, d::INT AS d, embedding[2 * d + 1]::DOUBLE AS re, embedding[2 * d + 2]::DOUBLE AS im FROM embeddings, range(0, 3) AS r(d)",
    "weights": f"SELECT vec_id // {CELLS} AS p, (q // 3)::INT AS s, (q % 3)::INT AS d, embedding[21 + 2 * q]::DOUBLE AS re, embedding[22 + 2 * q]::DOUBLE AS im FROM embeddings, range(0, 6) AS r(q) WHERE vec_id % {CELLS} = 0",
    "steering": _STEERING_SQL,
    "scalar_a": "SELECT sum(o_totalprice) / 1e10 AS v FROM orders",
    "scalar_b": "SELECT count(*) / 1e3 AS v FROM part",
}


def with_fixtures(*names: str) -> str:
    """The WITH clause of the named fixtures."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "
