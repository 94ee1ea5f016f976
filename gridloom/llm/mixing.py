"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target of words (its share by weight, at most ``cap`` times what it
holds) and a schedule: a piecewise-linear density over training time 0 to 1. Its
documents queue in a stable random order, whole epochs first. A document's copy that
begins after a share u of its source's demand is given the time t at which the
integral of the schedule reaches u; documents are range-sorted by that time.

A source with a target of r epochs gives floor(r) copies of each document, and of the
rest the queue's first documents that fit; the last one is the untaken document whose
size comes nearest to what is still lacking, if that is nearer than nothing.

Cases: no rows give no rows; a null source is a source, the last one; null or empty texts
have size 0 and are taken as often as the epochs say; ties in the queue are broken by doc_id, then size. Each row is
a document of its own, also where its doc_id or all of it is repeated; equal rows are interchangeable. Extra columns stay, whatever
their names; ``assign`` refuses those that it makes itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE, table, text_of, written

#: A document is repeated at most so often.
CAP = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Schedules (time, density) of the sources in that order, repeating: fading, steady, rising.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 1.75)))
#: Hex digits of a document's hash by which its source's queue is cut into cells, so that no task sorts a whole source.
CELL_DIGITS = 3


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes`` (source, source_size: one row a source) with ``rank`` (from 0) and ``target``.

    The capped sources are those of least size by weight. Windows here run over one row a source, in one task: right for up to some millions of sources.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("long"))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    capped = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rest", F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # at the level of those that remain, is this one above its cap?
        .withColumn("free", F.col("weight") * F.col("rest") <= cap * F.col("source_size") * F.col("weights"))
    )
    level = capped.withColumn("first_free", F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), "rank", "rest", "weights"))).over(everything))
    is_free = F.struct(F.col("source_size") / F.col("weight"), F.col("rank")) >= F.struct(F.col("first_free.col1"), F.col("first_free.rank"))
    return level.select(
        "source",
        "source_size",
        "rank",
        F.when(is_free, (F.col("weight") * F.col("first_free.rest")).cast("double") / F.col("first_free.weights")).otherwise((cap * F.col("source_size")).cast("double")).alias("target"),
    )


def when_reached(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The time at which the integral of the source's normalised schedule reaches ``share``."""

    def inverse(knots) -> Column:
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        total, out, reached = sum(areas), F.lit(1.0), sum(areas)
        for (a, b), area in reversed(list(zip(zip(knots, knots[1:]), areas))):
            begun = reached - area
            need = F.greatest(share * total - begun, F.lit(0.0))
            slope = (b[1] - a[1]) / (b[0] - a[0])
            gone = 2 * need / (a[1] + F.sqrt(F.greatest(a[1] * a[1] + 2 * slope * need, F.lit(0.0))))
            out = F.when(share * total < reached, F.least(a[0] + gone, F.lit(b[0]))).otherwise(out)
            reached = begun
        return out

    found = inverse(schedules[0])
    for k, knots in enumerate(schedules[1:], 1):
        found = F.when(rank % len(schedules) == k, inverse(knots)).otherwise(found)
    return found


def _source_key(source: Column) -> Column:
    """A text of its own for each source, null included, so that keys are never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def assign(sized: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, cap: int = CAP) -> DataFrame:
    """One row per row of ``sized`` (doc_id, source, size; narrow, as it is read twice): also source_size, target, copies, taken, and ``positions``, the times of its copies.

    Rows are joined by (source, cell) alone, of which a source has 16^CELL_DIGITS, and by their place in a cell; so no source meets in one task.
    """
    made = ("source_size", "target", "copies", "taken", "positions")
    if clash := {c.lower() for c in sized.columns} & set(made):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    given = sized.select(
        F.struct(*sized.columns).alias("row"), F.col("source").alias("named"), _source_key(F.col("source")).alias("source"), F.col("doc_id").alias("doc"), F.col("size").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("hash")
    ).withColumn("cell", F.substring("hash", 1, CELL_DIGITS))
    # prefix sums in two steps: cells of a source, then documents of a cell
    cells = written(given.groupBy("source", "cell").agg(F.sum("size").alias("held"), F.first("named").alias("named")), "mix-cells")
    sizes = cells.groupBy("source").agg(F.sum("held").alias("source_size"), F.first("named").alias("named"))
    shares = targets(sizes.select(F.col("named").alias("source"), "source_size"), weights, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = shares.select(_source_key(F.col("source")).alias("source"), "source_size", "rank", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("part"))
    starts = cells.select("source", "cell", (F.sum("held").over(Window.partitionBy("source").orderBy("cell")) - F.col("held")).alias("start")).join(plan, "source")
    inner = Window.partitionBy("source", "cell").orderBy("hash", "doc", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = given.withColumn("within", F.sum("size").over(inner) - F.col("size")).withColumn("nr", F.row_number().over(inner))
    fits = (F.col("before") + F.col("size") <= F.col("part")) & (F.col("part") > 0)
    queued = written(summed.join(starts, ["source", "cell"]).withColumn("before", F.col("start") + F.col("within")).withColumn("fits", fits).drop("named", "within", "start"), "mix-queue")
    # the document that comes nearest to what the fitting ones leave
    left = queued.groupBy("source").agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("fitted"))
    lacks = starts.join(left, "source").select("source", "cell", (F.col("part") - F.col("fitted")).alias("lack"))
    off = F.abs(F.col("size") - F.col("lack"))
    near = queued.where(~F.col("fits")).join(lacks, ["source", "cell"]).where(off < F.col("lack"))
    chosen = near.groupBy("source").agg(F.min(F.struct(off.alias("off"), "hash", "doc", "size", "cell", "nr")).alias("c")).select("source", "c.cell", "c.nr", F.lit(1).alias("last"))
    full = queued.join(chosen, ["source", "cell", "nr"], "left")
    copies = F.least(F.col("epochs") + F.when(F.col("last").isNotNull() | F.col("fits"), 1).otherwise(0), F.lit(cap)).cast("int")
    share = lambda c: (c * F.col("source_size") + F.col("before")) / F.greatest(F.col("target"), F.lit(1.0))
    times = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda c: when_reached(F.least(share(c), F.lit(1.0)), F.col("rank"), schedules))
    return full.withColumn("copies", copies).select(
        "row.*",
        F.coalesce("source_size", F.lit(0)).alias("source_size"),
        "target",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.when(F.col("copies") > 0, times).otherwise(F.array().cast("array<double>")).alias("positions"),
    )


def in_order(assigned: DataFrame) -> DataFrame:
    """A row per copy taken, range-sorted by ``position``: the partitions in order are the training order."""
    return assigned.withColumn("position", F.explode("positions")).drop("positions").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def mix_documents(documents: DataFrame) -> DataFrame:
    """``documents`` as the mix takes them, in training order: untaken ones go, repeated ones come again. The columns stay.

    Texts meet their positions by a digest of the whole row; rows that are equal in all columns are interchangeable, so
    one of them stands for all, and comes as often as all of them are taken.
    """
    columns = [F.col(f"`{c}`") for c in documents.columns]
    digest = [F.xxhash64(F.lit(salt), *columns).alias(f"row{salt}") for salt in (1, 2)]
    sized = written(documents.select("doc_id", "source", words(text_of()).alias("size"), *digest), "mix-sizes")
    order = assign(sized).select("row1", "row2", F.explode("positions").alias("at"))
    one = documents.select(*digest, F.struct(*columns).alias("row")).groupBy("row1", "row2").agg(F.first("row").alias("row"))
    mixed = order.join(one, ["row1", "row2"]).select("at", "row", F.col("row.doc_id").alias("doc"))
    return mixed.repartitionByRange("at", "doc").sortWithinPartitions("at", "doc").select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    sized = written(table(spark, sf_dir, "documents").select("doc_id", "source", words(text_of()).alias("size")), "mix-sizes")
    mixed = assign(sized).withColumn("first_position", F.try_element_at("positions", F.lit(1)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position").repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")
