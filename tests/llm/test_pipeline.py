"""Each stage of the pipeline, on what the one before it kept, against a plain version of it; then the whole run."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import pieces, quality
from gridloom.llm.common import table, written
from gridloom.llm.sql import OP2

from test_neardup import brute as near_brute
from test_rest import brute_lines

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


def quality_brute(spark, docs):
    """The forward pass in float64, chunk by chunk, with the weights that the fit gives."""
    net = quality.fit(*quality.sample(docs, table(spark, SF, "labels")))
    filters, half, step, kept = np.concatenate([net.first, net.second]).astype(float), quality.WIDTH // 2, quality.CHUNK - quality.OVERLAP, Counter()
    for r in docs.collect():
        data, tops, at = (r.text or "").encode(), [], 0
        while True:
            chunk = np.frombuffer(data[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0"), np.uint8)
            windows = np.stack([net.embed[chunk[lo : lo + quality.WIDTH]].reshape(-1) for lo in range(0, quality.CHUNK - half, half)])
            tops.append(np.maximum((windows @ filters).max(0) + net.bias, 0))
            at += step
            if at + quality.OVERLAP >= len(data):
                break
        score = 1 / (1 + np.exp(-(np.mean(tops, 0) @ net.out + net.out_bias)))
        assert abs(score - quality.THRESHOLD) > 1e-4, "a score too near to the threshold to compare"
        if score >= quality.THRESHOLD:
            kept[r.doc_id, r.text, r.lang, r.source, r.n_chars] += 1
    return kept


def lines_brute(spark, docs):
    given = docs.collect()
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for r in given:
        for line in r.text.split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(r.doc_id)
    left = lambda r: "\n".join(x for x in r.text.split("\n") if not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != r.doc_id))
    made = Counter((r.doc_id, left(r), r.lang, r.source, len(left(r))) for r in given)
    shas = {k: v[2] for k, v in brute_lines({r.doc_id: r.text for r in given}).items()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == shas[k] for k, t, *_ in made)
    return made


def near_duplicates_brute(spark, docs):
    group = near_brute({r.doc_id: r.text for r in docs.collect()})
    return Counter({row: n for row, n in rows(docs).items() if group[row[0]] == row[0]})


def mixing_brute(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    copies = {k: n for k, n in con.execute(f"SELECT doc_id, copies FROM ({OP2})").fetchall()}
    return Counter({row: copies[row[0]] for row in rows(docs) if copies[row[0]]})


def pieces_brute(spark, docs):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    model, made = pieces.Pieces(pieces.model_bytes()), Counter()
    for r in docs.collect():
        ids = model.span(" " + r.text) if r.text else []
        made[r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text)] += 1
    return made


BRUTE = {"quality": quality_brute, "line dedup": lines_brute, "near duplicates": near_duplicates_brute, "mixing": mixing_brute, "pieces": pieces_brute}


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        want, made = BRUTE[name](spark, docs), stage(spark, docs, SF)
        if name == "pieces":
            got = Counter(tuple(r) for r in made.select("doc_id", "n_ids", "ids_sha256", "decoded_sha256").collect())
        else:
            assert made.columns == docs.columns
            docs = written(made, "stage")
            got = rows(docs)
        assert got == want, name
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_ids", "ids_sha256", "decoded_sha256").collect()) == got


def test_mixing_orders_by_position(spark):
    docs = table(spark, SF, "documents")
    from gridloom.llm.mixing import assign, in_order, mix_documents, words

    sized = docs.select("doc_id", "source", words(F.coalesce("text", F.lit(""))).alias("size"))
    assert [r.doc_id for r in mix_documents(docs).collect()] == [r.doc_id for r in in_order(assign(sized)).collect()]
