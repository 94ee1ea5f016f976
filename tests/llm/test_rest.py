import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, chat, linededup, mixing, pieces, quality, sharding

SF = "/root/testdata/sf0.001"


def brute_lines(texts):
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for doc, text in texts.items():
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(doc)
    out = {}
    for doc, text in texts.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != doc)]
        out[doc] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def line_cases():
    shared = ["A line that many documents share, é", "  \ta LINE that many documents share, é\v", "another shared line of text", "exactly twenty chars", "ééééééééééééééééééé"]
    rng = random.Random(5)
    texts = {k: "\n".join(rng.choice(shared + [f"own line number {k} {j} of this document", "", "short"]) for j in range(rng.randrange(1, 9))) for k in range(40)}
    return texts | {40: None, 41: "", 42: "\n\n", 43: "\n".join(shared * 2), 44: "x" * 200_000}


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "z") for k, t in texts.items()], "doc_id long, text string, shard string")


def answers(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()}


def test_lines_match_brute_force(spark):
    texts = line_cases()
    assert answers(linededup.dedup_lines(frame(spark, texts))) == brute_lines(texts)
    assert linededup.dedup_lines(frame(spark, texts).limit(0)).count() == 0


def test_line_index_is_reversible(spark, tmp_path):
    texts = line_cases()
    some = {k: t for k, t in texts.items() if k % 3}
    index = linededup.LineIndex(spark, str(tmp_path)).insert(frame(spark, some))
    assert answers(index.resolve(frame(spark, some))) == brute_lines(some)
    more = index.insert(frame(spark, texts))
    assert answers(more.resolve(frame(spark, texts))) == brute_lines(texts)
    back = more.delete(spark.createDataFrame([(k,) for k in texts if k not in some], "doc_id long"))
    assert answers(back.resolve(frame(spark, some))) == brute_lines(some)
    counts = lambda i: sorted((bytes(r.digest), r.n_docs, r.max_doc) for r in i.counts.collect())
    assert counts(back) == counts(index)
    packed = back.compact(f"{tmp_path}/packed")
    assert counts(packed) == counts(index) and answers(packed.resolve(frame(spark, some))) == brute_lines(some)
    # a change writes what it changes
    one = back.insert(spark.createDataFrame([(900, line_cases()[0], "z")], "doc_id long, text string, shard string"))
    lines = {key for key in linededup.keys_of(line_cases()[0].encode(), 20) if key}
    for what in ("postings", "counts"):
        assert spark.read.parquet(f"{tmp_path}/{what}/version={one.version}").count() == len(lines)
    assert answers(back.resolve(frame(spark, some))) == brute_lines(some)
    again = one.insert(frame(spark, {900: "other", 901: line_cases()[0]}))
    with_both = some | {900: line_cases()[0], 901: line_cases()[0]}
    assert answers(again.resolve(frame(spark, with_both))) == brute_lines(with_both)


def test_rows_of_one_document_count_once(spark, tmp_path):
    twice, lone, common = ("a line of two documents", "a line of the rows without id", "a line of three documents")
    rows = [(1, twice), (2, twice + "\nown"), (2, twice), (None, lone), (None, lone), (3, lone)]
    rows += [(4, common), (5, common), (5, common), (None, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = linededup.LineIndex(spark, str(tmp_path)).insert(docs)
    for made in (linededup.dedup_lines(docs), index.resolve(docs)):
        got = sorted((r.doc_id or 0, r.kept) for r in made.collect())
        assert got == sorted((k or 0, "" if k == 4 else t) for k, t in rows)


def test_cuckoo_filter():
    digests = [hashlib.blake2b(str(k).encode(), digest_size=16).digest() for k in range(5000)]
    made = linededup.CuckooFilter.of(digests[:3000])
    assert made.holds(digests[:3000]).all() and made.holds(digests[3000:]).mean() < 0.01
    for d in digests[:1500]:
        assert made.remove(d)
    made = linededup.CuckooFilter.loads(made.dumps())
    assert made.holds(digests[1500:3000]).all() and made.holds(digests[:1500]).mean() < 0.01


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "b", "b", "b", "c", None]), " w" * rng.randrange(0, 60)) for k in range(600)] + [(600, "d", "tiny"), (601, "e", None), (602, "e", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sized = docs.select("doc_id", "source", mixing.words(F.coalesce("text", F.lit(""))).alias("size"))
    got = mixing.assign(sized).collect()
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, _, t in rows}
    total, order = Counter(), ["a", "b", "c", "d", "e", None]
    for k, s, _ in rows:
        total[s] += size[k]
    capped, weight = set(), {s: k % 3 + 1 for k, s in enumerate(order)}
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * rest / free > 3 * total[s]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in got:
        want = 3 * total[r.source] if r.source in capped else weight[r.source] * rest / free
        assert r.size == size[r.doc_id] and r.source_size == total[r.source] and np.isclose(r.target, want) and r.taken <= 3 * r.size
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    for r in got:
        assert abs(taken[r.source] - r.target) <= 30
    mixed = mixing.mix_documents(docs).collect()
    assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: r.copies for r in got if r.copies})
    positions = [r.position for r in mixing.in_order(mixing.assign(sized)).collect()]
    assert positions == sorted(positions)
    assert mixing.assign(sized.limit(0)).count() == 0 and mixing.mix_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 15, 1000])
def test_sharding_sizes_slots_and_reruns(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("x"))
    place = lambda: {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_to_shards(df, ["doc_id"]).collect()}
    got = place()
    sizes = Counter(s for s, _ in got.values())
    assert len(got) == n and got == place()
    assert max((sizes[s] for s in range(16)), default=0) - min(sizes[s] for s in range(16)) <= 1
    for s in sizes:
        assert sorted(slot for t, slot in got.values() if t == s) == list(range(sizes[s]))


def test_rows_equal_many_times_over_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 100)
    monkeypatch.setattr("gridloom.llm.common.HOT_ROWS", 100)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a").alias("__at"), F.lit("b").alias("__block"))
    place = lambda: Counter((r.doc_id, r["__at"], r["__block"], r.shard, r.slot) for r in sharding.shuffle_to_shards(df, ["doc_id"]).collect())
    got = place()
    assert got == place() and sum(got.values()) == 3000 and max(got.values()) == 1
    hot, sizes = Counter(s for d, _, _, s, _ in got if d == 7), Counter(s for _, _, _, s, _ in got)
    assert set(sizes.values()) == {187, 188} and all(30 <= hot[s] <= 100 for s in range(16))
    slots = sorted(slot for d, _, _, s, slot in got if d == 7 and s == 0)
    assert slots[0] < 40 and slots[-1] > 140


def test_sharding_query_against_brute_force(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sharding.op5_sharding(spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {k: (len(t) + 1, zlib.crc32(t), "rows", None) for k, t in texts.items()}
    assert len(got) == len(texts) and sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(16) for k in range(len(texts) // 16 + (s < len(texts) % 16))]


def test_communication_matrix_is_hypergeometric():
    rng, hits = random.Random(7), Counter()
    for k in range(4000):
        m = sharding.communication_matrix([5, 7, 3], [8, 7], rng.randrange(1 << 30))
        assert [sum(r) for r in m] == [5, 7, 3] and [sum(c) for c in zip(*m)] == [8, 7]
        hits[m[0][0]] += 1
    from math import comb

    for k in range(6):
        assert abs(hits[k] / 4000 - comb(8, k) * comb(7, 5 - k) / comb(15, 5)) < 0.03
    assert 0 <= sharding.hypergeometric(rng, 10**12, 10**12, 10**11) <= 10**11


def test_chat_round_trip(spark):
    texts = [chat.ATTACK, "\\", "\\</s>", "<|user|>", "a\\<|b", "", None, "<", "|>", "<<s>", "</s", "<|assistant|></s>", "é😀\n"]
    rows = [(k, j, role, t) for k, t in enumerate(texts) for j, role in enumerate(("user", "assistant", None, "x|>y"))]
    rows += [(100, 0, "system", "s"), (100, 1, "user", "u"), (100, 2, "assistant", "a"), (101, 0, "assistant", "a")]
    made = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in made.withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    for k in {r[0] for r in rows}:
        assert [(t.role, t.text) for t in got[k].back] == [(r or "", t or "") for c, _, r, t in rows if c == k]
        assert "".join(s.text for s in got[k].segments) == got[k].formatted
    assert got[100].valid and not got[101].valid and got[101].first_bad == 0 and got[0].first_bad == 2


def test_viterbi_streams_as_the_whole_search_does():
    table, rng = pieces.Pieces(pieces.model_bytes()), random.Random(8)
    memo = pieces.Memo(table)

    def whole(text):
        best, back = [0.0], [None]
        for end in range(1, len(text) + 1):
            top = came = None
            for start in range(max(0, end - table.longest), end):
                i = table.ids.get(text[start:end])
                if i is not None and (top is None or best[start] + table.scores[i] > top):
                    top, came = best[start] + table.scores[i], (start, i)
            if text[end - 1] not in table.ids and (top is None or best[end - 1] + table.unknown > top):
                top, came = best[end - 1] + table.unknown, (end - 1, -1)
            best.append(top)
            back.append(came)
        return table._path(text, [b and b[0] for b in back], [b and b[1] for b in back], 0, len(text))

    for _ in range(60):
        text = "".join(rng.choice("abcdehnorsté😀\nththeinger▁12.,") for _ in range(rng.randrange(0, 700)))
        assert table.viterbi(text) == whole(text)
        text = text.replace("t", " ")
        ids = np.frombuffer(memo.encode(text), "<i4").tolist()
        assert table.decode(ids) == text
        if "▁" not in text and text:
            assert ids == whole("▁" + text.replace(" ", "▁"))
    assert memo.encode("") == b"" and table.decode([]) == ""


def test_pieces_in_spark(spark):
    texts = [None, "", " ", "a" * 50_000, "▁ x ▁", "<0x41> <unk> </s>", "\u0000é"]
    docs = frame(spark, dict(enumerate(texts)))
    for r in pieces.decode(pieces.encode(docs)).collect():
        assert r.decoded == (texts[r.doc_id] or "") and r.shard == "z"
    both = pieces.encode(docs, and_decode=True).collect()
    assert all(r.decoded == (texts[r.doc_id] or "") for r in both) and pieces.encode(docs.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where(quality.held_out()).select("score", "quality").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97 and (good >= quality.THRESHOLD).mean() > 0.97 and (bad < quality.THRESHOLD).mean() > 0.7


def test_quality_covers_whole_texts_and_empty_ones(spark):
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        chunks, counts = quality.chunks_of([bytes(range(1, 255)) * (n // 254 + 1)][:1] and [(bytes(range(1, 255)) * (n // 254 + 1))[:n]])
        assert counts[0] == len(chunks) and (chunks != 0).sum() >= n
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "text " * 40_000)], "doc_id long, text string")
    assert quality.score(docs, spark.createDataFrame([], "doc_id long, quality int")).where("score = 0.5").count() == 3
    labels = spark.createDataFrame([(1, 0), (3, 1), (2, 1), (4, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(docs, labels).collect())
    assert [r.held_out for r in docs.select(quality.held_out().alias("held_out")).collect()] == [zlib.crc32(str(k).encode()) % 5 == 0 for k in (1, 2, 3)]


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "good text " * 14_000 + ("" if k % 2 else "#@!$ " * 4000)) for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    chunks, counts, marks = quality.sample(docs, labels, most=1000)
    step = quality.CHUNK - quality.OVERLAP
    assert set(zip(counts.tolist(), marks.tolist())) == {(-(-(160_000 - 64) // step), 0), (-(-(140_000 - 64) // step), 1)} and len(chunks) == counts.sum()
    whole = quality.fit(chunks, counts, marks, epochs=1)
    monkeypatch.setattr(quality, "SLICE", 100)
    sliced = quality.fit(chunks, counts, marks, epochs=1)
    assert all(np.allclose(getattr(whole, k), getattr(sliced, k), atol=1e-4) for k in ("embed", "first", "second", "bias", "out"))
    # what is drawn of a long text comes from all of it
    few, counts, marks = quality.sample(docs, labels)
    assert set(counts.tolist()) == {quality.TRAIN_CHUNKS}
    junk = [b"#@!$" in c.tobytes() for c, n in zip(few, np.repeat(marks, counts)) if n == 0]
    assert 0.05 < np.mean(junk) < 0.25  # an eighth of those texts


def test_quality_score_is_the_network_by_hand(spark):
    rng = random.Random(3)
    texts = {k: "".join(rng.choice("abc é#@\n") for _ in range(n)) for k, n in enumerate([0, 1, 15, 16, 17, 447, 512, 513, 3000, 1, 90, 700])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, quality int")
    net = quality.fit(*quality.sample(docs, labels))
    half = quality.WIDTH // 2
    filters = np.concatenate([net.first, net.second])

    def brute(text):
        data, tops, at = text.encode(), [], 0
        while True:
            chunk = data[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            best = np.full(quality.FILTERS, -np.inf)
            for lo in range(0, quality.CHUNK - half, half):
                best = np.maximum(best, np.concatenate([net.embed[b] for b in chunk[lo : lo + quality.WIDTH]]) @ filters)
            tops.append(np.maximum(best + net.bias, 0))
            at += quality.CHUNK - quality.OVERLAP
            if at + quality.OVERLAP >= len(data):
                break
        return 1 / (1 + np.exp(-(np.mean(tops, 0) @ net.out + net.out_bias)))

    for r in quality.score(docs, labels).collect():
        assert abs(r.score - brute(texts[r.doc_id])) < 1e-4, r.doc_id


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 16))
    rows = [(k, [float(c) for c in v], "z") for k, v in enumerate(x)] + [(-1, None, "z"), (-2, [0.0] * 16, "z"), (-3, [float("nan")] * 16, "z"), (-4, [1.0], "z"), (-100, [None] * 16, "z")]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, part string"), F.col("vec_id") % 100 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 6000, 100))
    found = 0
    for q, hits in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits.sort(key=lambda r: r.rank)
        assert [r.rank for r in hits] == list(range(1, 11)) and all(np.isclose(r.score, d[r.vec_id], rtol=1e-12) for r in hits)
        assert [(r.score, r.vec_id) for r in hits] == sorted((r.score, r.vec_id) for r in hits)
        found += len({r.vec_id for r in hits} & set(np.argsort(d)[:10].tolist()))
    assert found / (10 * len(by)) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.search(few, F.col("vec_id") == 0).collect()] == [(1, 0.0), (2, 1.0)]
    assert ann.search(few.limit(0), F.col("vec_id") == 0).count() == 0
