"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound of one Arrow batch sent to a Python worker, so that batches of very long texts stay small.
ARROW_BATCH_BYTES = 4 << 20
ARROW_BATCH_ROWS = 2048

#: White space of the contracts, as a Java regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds the size of Arrow batches in this session; smaller settings stay."""
    for key, most in (("maxBytesPerBatch", ARROW_BATCH_BYTES), ("maxRecordsPerBatch", ARROW_BATCH_ROWS)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name)).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all executors are this process (tests)."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not known:
        known = context.getCheckpointDir()
        if not known and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = known or "file://" + tempfile.mkdtemp(prefix="gridloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


#: Folders of tables that ``written`` made and ``discard`` hasn't deleted.
_written: set[str] = set()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet below the shared folder and reads it back: this cuts the lineage, is smaller than a checkpoint, and columns can be pruned."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.add(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._gridloom_path = path
    return made


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _written.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``written`` that no plan needs any more."""
    for each in tables:
        if path := getattr(each, "_gridloom_path", None):
            _delete(each.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes all tables that the operators of this process have written; results that aren't saved yet are lost."""
    for path in list(_written):
        _delete(spark, path)


def text_of(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def worker_state(key: str, make):
    """What ``make`` returns, once in each Python worker; it lives on from task to task, and is made again if the worker is lost."""
    holder = sys.modules.setdefault("gridloom_worker_state", types.ModuleType("gridloom_worker_state"))
    if key not in holder.__dict__:
        holder.__dict__[key] = make()
    return holder.__dict__[key]


def forget() -> None:
    """Frees what the functions of a worker's earlier tasks held: garbage in cycles, whose size doesn't set off a collection."""
    gc.collect()


def free_name(df: DataFrame, want: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = "_" + want
    return want


def spread(*columns: Column | str, buckets: int, seed: int = 0) -> Column:
    """A bucket in [0, buckets) by a stable hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(buckets)).cast("int")


#: At most so many keys are called hot, and at least so many rows a hot key has.
HOT_KEYS, HOT_ROWS = 4096, 10_000


def hot_keys(left: DataFrame, key: str) -> DataFrame:
    """(__hot): the keys with so many rows in ``left`` that there can be HOT_KEYS of them at most, which bounds their broadcast."""
    least = max(HOT_ROWS, left.count() // HOT_KEYS + 1)
    return left.groupBy(key).count().where(F.col("count") >= least).select(F.col(key).alias("__hot"))


def salted(df: DataFrame, key: str, hot: DataFrame, salt: str, side: str, salts: int = 32) -> DataFrame:
    """``df`` with a column ``salt``: 0, but for hot keys a hash of the other columns (side "left"), or every salt in turn ("right")."""
    marked = df.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    if side == "left":
        at = F.when(F.col("__hot").isNull(), 0).otherwise(spread(*[F.col(c) for c in df.columns if c != key], buckets=salts))
    else:
        at = F.explode(F.when(F.col("__hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1))))
    return marked.withColumn(salt, at).drop("__hot")


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key``, which is unique in ``right``; a hot key of ``left`` is spread over tasks.

    ``left`` is read three times, so it should be a narrow table.
    """
    hot, salt = hot_keys(left, key), free_name(left, "__salt")
    return salted(left, key, hot, salt, "left").join(salted(right, key, hot, salt, "right"), [key, salt], how).drop(salt)
