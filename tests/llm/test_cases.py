"""The same cases for every operator: nulls, empty tables, repeated rows, and extra columns whose names the operators use inside."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import ann, chat, common, linededup, media, mixing, neardup, pieces, pii, quality, sharding

LINE = "a line that some documents share"
ROWS = [
    (1, LINE, "a"),
    (1, LINE, "a"),
    (1, "other text of document one", "b"),
    (2, LINE + "\nown line", None),
    (None, LINE, "a"),
    (None, None, None),
    (3, "", "c"),
    (4, "one two three four five six seven", "a"),
    (5, "one two three four five six seven", "a"),
]
#: Names that the operators give to columns of their own.
NAMES = sorted(
    {name for path in Path(common.__file__).parent.glob("*.py") for name in re.findall(r'"(_*[a-z][a-z_0-9]*)"', path.read_text())}
    - {"doc_id", "text", "source", "lang", "n_chars", "score", "kept", "n_lines", "n_dropped", "kept_sha256", "shard", "slot", "source_size", "target", "copies", "taken", "positions", "ids", "decoded"}
)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with a column for each of those names."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return rows.select("*", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *[F.lit(f"x{k}").alias(name) for k, name in enumerate(NAMES)])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")


OPERATORS = {
    "lines": lambda d, labels: linededup.dedup_lines(d),
    "mixing": lambda d, labels: mixing.mix_documents(d),
    "pii": lambda d, labels: pii.find_pii(d),
    "quality": lambda d, labels: quality.score(d, labels),
    "sharding": lambda d, labels: sharding.shuffle_to_shards(d, ["doc_id", "text"]),
    "pieces": lambda d, labels: pieces.decode(pieces.encode(d)),
    "media": lambda d, labels: media.store_and_read(d),
    "near": lambda d, labels: neardup.near_duplicates(d),
    "near drop": lambda d, labels: neardup.drop_near_duplicates(d),
}


def test_there_are_names():
    assert len(NAMES) > 60 and {"__of", "__at", "hash", "cell", "rank", "band", "part"} & set(NAMES) > {"hash", "cell"}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_repeated_and_empty_rows(spark, docs, labels, name):
    made = OPERATORS[name](docs, labels)
    rows = made.collect()
    if name == "mixing":
        assert made.columns == docs.columns
    elif name != "near drop":
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    if "text" in made.columns and name not in ("mixing", "near drop"):
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(r[:2] for r in ROWS)
    kept = [c for c in NAMES if c in made.columns and set(docs.columns) <= {*made.columns, "text"}]
    assert not kept or all(r[c] == f"x{NAMES.index(c)}" for c in kept for r in rows)
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_mixing_takes_repeated_rows_as_documents(spark):
    rows = [(1, "a", "w " * 10)] * 2 + [(1, "a", "w " * 4), (1, "b", "v"), (None, None, "u u"), (None, None, "u u")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"))
    assigned = mixing.assign(sized).collect()
    assert len(assigned) == len(rows) and all(r.taken <= 3 * r.size for r in assigned)
    want = Counter()
    for r in assigned:
        want[r.doc_id, r.source, r["size"]] += r.copies
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mix_documents(docs).collect())
    assert got == +want


def test_ann_keeps_repeated_rows_apart(spark):
    rows = [(k, [float(k), 1.0]) for k in range(1, 30)] + [(100, [3.2, 1.0]), (100, [3.2, 1.0]), (100, [20.4, 1.0]), (5, [5.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("x")).withColumn("block", F.lit("y"))
    got = ann.search(docs, F.col("vec_id") == 100, parts=1).collect()
    assert Counter(r["rank"] for r in got) == {k: 2 for k in range(1, 11)}  # two different vectors: two answers
    near = sorted(got, key=lambda r: (r["rank"], r.score))
    assert {(r.vec_id, round(r.score, 9)) for r in near if r["rank"] == 1} == {(3, 0.2), (20, 0.4)}
    assert sum(r.vec_id == 5 for r in got) == 1 and 100 not in {r.vec_id for r in got}


def test_chat_of_empty_tables_and_extra_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (None, None, None, None, None)], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.format_chat(turns).collect()}
    assert got[1].n_turns == 2 and got[None].n_turns == 1 and not got[None].valid
    assert chat.format_chat(turns.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_pipeline_stages(spark, docs, labels, name, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    made = stage(spark, docs, str(tmp_path))
    if name != corpus_pipeline.STAGES[-1][0]:
        assert made.columns == docs.columns
    assert made.count() > 0 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_tables_are_deleted(spark):
    table = common.written(spark.range(3), "some")
    path = Path(table._gridloom_path.removeprefix("file:").replace("//", "/"))
    assert path.exists() and table.count() == 3
    common.discard(table)
    assert not path.exists()
