"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in logical blocks (a stable hash, so a rerun or a lost executor finds the
same blocks). How many rows of each block go to each shard is drawn exactly: row by
row, a multivariate hypergeometric draw from what the shards still lack. Each block
then permutes its rows and cuts them by its counts, the shards exchange, and each
shard permutes again. Which rows meet in a shard is as likely as any other choice,
and shard sizes are exact: at most one apart.

Cases: no rows give no rows; null ids or sizes are ordinary values; equal rows are
interchangeable, and where there are very many of them they are numbered first and spread like others; all input
columns stay, whatever their names, but ``shard`` and ``slot`` are refused.
"""

from __future__ import annotations

import json
import math
import random

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import HOT_ROWS, free_name, hot_keys, table, text_of, written

#: Logical blocks, and cells of a shard in which the second permutation sorts, at least; rows of each on average, at most, as long as there
#: are no more than MOST of them. The matrix of blocks x shards counts is all that reaches the driver.
BLOCKS, CELLS, BLOCK_ROWS, MOST = 512, 256, 4_000_000, 8192
SHARDS = 16
#: Beyond this many standard deviations a hypergeometric mass is below 1e-30.
REACH = 12


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are good ones, of ``good`` and ``bad``: inversion around the mode, for any sizes."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mean = drawn * good / total
    deviation = math.sqrt(max(1e-9, mean * (bad / total) * ((total - drawn) / max(1, total - 1))))
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    reach = int(REACH * deviation) + 30
    low, high = max(low, mode - reach), min(high, mode + reach)
    # masses relative to that of the mode, by the ratio of neighbours
    k = np.arange(mode, high, dtype=float)
    up = np.cumprod((good - k) * (drawn - k) / ((k + 1) * (bad - drawn + k + 1)))
    k = np.arange(mode, low, -1, dtype=float)
    down = np.cumprod(k * (bad - drawn + k) / ((good - k + 1) * (drawn - k + 1)))
    ends = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return mode - len(down) + min(int(np.searchsorted(ends, rng.random() * ends[-1], side="right")), len(ends) - 1)


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Counts with the given row and column sums, distributed as those of a uniform permutation."""
    rng = random.Random(seed)
    lack, matrix = list(shards), []
    for n in rows:
        total, line = sum(lack), []
        for k, column in enumerate(lack):
            drawn = n if k == len(lack) - 1 else hypergeometric(rng, column, total - column, n)
            line.append(drawn)
            total -= column
            n -= drawn
        lack = [a - b for a, b in zip(lack, line)]
        matrix.append(line)
    return matrix


def _follows(rows: int, least: int) -> int:
    """Blocks or cells for so many rows: ``least``, and more where they would be too large, but MOST at most."""
    return min(MOST, max(least, rows // BLOCK_ROWS))


def _numbered(df: DataFrame, by: list[str], hot: DataFrame, nr: str) -> DataFrame:
    """``df`` with ``nr``: 0, but for rows equal in ``by`` that are ``hot`` the numbers from 0, of which it doesn't matter which is whose.

    Rows are numbered within the partitions of a written table, so that no task sees all equal rows.
    """
    key, place, row = (free_name(df, name) for name in ("__key", "__place", "__row"))
    kept = written(df.withColumn(key, F.xxhash64(*[F.col(f"`{c}`") for c in by])).join(F.broadcast(hot.withColumnRenamed("__hot", row)), F.col(key) == F.col(row), "left").withColumn(place, F.monotonically_increasing_id()), "shard-rows")
    inner = Window.partitionBy(key, f"{place}s").orderBy(place)
    equal = kept.where(F.col(row).isNotNull()).withColumn(f"{place}s", F.shiftright(place, 33))
    sizes = equal.groupBy(F.col(key).alias(f"{key}2"), F.col(f"{place}s").alias("p")).agg(F.count(F.lit(1)).alias("k"))
    starts = sizes.select(f"{key}2", "p", (F.sum("k").over(Window.partitionBy(f"{key}2").orderBy("p")) - F.col("k")).alias("start"))
    starts = starts.select(F.col(f"{key}2").alias(f"{key}_"), F.col("p").alias(f"{place}_"), F.col("start").alias(f"{nr}_"))
    equal = equal.withColumn(nr, F.row_number().over(inner) - 1).join(starts, (F.col(key) == F.col(f"{key}_")) & (F.col(f"{place}s") == F.col(f"{place}_")))
    equal = equal.withColumn(nr, (F.col(nr) + F.col(f"{nr}_")).cast("long"))
    given = [F.col(f"`{c}`") for c in df.columns]
    return equal.select(*given, nr).unionByName(kept.where(F.col(row).isNull()).select(*given, F.lit(0).cast("long").alias(nr)))


def shuffle_to_shards(df: DataFrame, by: list[str], shards: int = SHARDS, seed: int = 7, blocks: int | None = None, cells: int | None = None) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1, sizes at most one apart) and ``slot`` (gapless from 0 in each shard).

    ``by`` names the columns whose hash stands for the randomness; rows equal in all of them are interchangeable.
    """
    if clash := {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    spark = df.sparkSession
    block, cell, at, last, first, nr = (free_name(df, name) for name in ("__block", "__cell", "__at", "__ends", "__start", "__nr"))
    columns = [F.col(f"`{c}`") for c in by]

    def mark(salt: int):
        """A hash of ``by``; rows that are numbered get one each."""
        return F.when(F.col(nr) == 0, F.xxhash64(F.lit(salt), *columns)).otherwise(F.xxhash64(F.lit(salt), *columns, F.col(nr)))

    def counted(rows: DataFrame, n_blocks: int) -> dict:
        return {r[block]: r["count"] for r in rows.groupBy(F.pmod(mark(seed), F.lit(n_blocks)).cast("int").alias(block)).count().collect()}  # at most ``n_blocks`` rows

    numbered = df.withColumn(nr, F.lit(0).cast("long"))
    counts = counted(numbered, blocks or BLOCKS)
    n = sum(counts.values())
    many, ordinary = blocks or _follows(n, BLOCKS), 2 * n // (blocks or BLOCKS) + HOT_ROWS
    crowded = [b for b, k in counts.items() if k > ordinary]
    if crowded:  # rows that are equal in ``by``, many times over
        key = free_name(df, "__key")
        some = numbered.where(F.pmod(mark(seed), F.lit(blocks or BLOCKS)).cast("int").isin(crowded)).select(F.xxhash64(*columns).alias(key))
        numbered = _numbered(df, by, hot_keys(some, key), nr)
    if crowded or many != (blocks or BLOCKS):
        counts = counted(numbered, many)
    blocked = numbered.withColumn(block, F.pmod(mark(seed), F.lit(many)).cast("int"))
    matrix = communication_matrix([counts.get(b, 0) for b in range(many)], [n // shards + (s < n % shards) for s in range(shards)], seed)
    cuts = []
    for b, line in enumerate(matrix):
        ends, reached = [], 0
        for k in line:
            reached += k
            ends.append(reached)
        cuts.append({"b": b, "ends": ends})
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(cuts)), "array<struct<b:int,ends:array<bigint>>>")).alias("p")).select(F.col("p.b").alias(block), F.col("p.ends").alias(last))
    local = Window.partitionBy(block).orderBy(mark(seed + 1), *columns, nr)
    sent = (
        blocked.withColumn(at, F.row_number().over(local))
        .join(F.broadcast(plan), block)  # ``many`` rows, MOST at most
        .withColumn("shard", F.size(F.filter(last, lambda end: end < F.col(at))))
        .withColumn(cell, F.pmod(mark(seed + 2), F.lit(cells or _follows(n // shards, CELLS))).cast("int"))
        .drop(block, at, last)
    )
    # the second permutation: cells of each shard in order, rows of each cell by another hash
    sizes = sent.groupBy("shard", cell).count()  # at most shards x cells rows
    starts = sizes.select("shard", cell, (F.sum("count").over(Window.partitionBy("shard").orderBy(cell)) - F.col("count")).alias(first))
    inner = Window.partitionBy("shard", cell).orderBy(mark(seed + 3), *columns, nr)
    return sent.withColumn(at, F.row_number().over(inner)).join(F.broadcast(starts), ["shard", cell]).withColumn("slot", (F.col(first) + F.col(at) - 1).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 16 shards under the law ``rows``."""
    bytes_of = F.encode(text_of(), "UTF-8")
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_of()) + 1).cast("long").alias("size"),
        F.crc32(bytes_of).alias("text_crc32"),
    )
    placed = shuffle_to_shards(narrow, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharding_sizes(spark, sf_dir: str) -> DataFrame:
    """What the law promises, shard by shard: rows, slots, and all bytes."""
    found = op5_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("n_slots"), F.sum("size").alias("bytes"))
    return found.select("shard", "n_rows", "first_slot", "last_slot", "n_slots", F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))  # one row a shard
