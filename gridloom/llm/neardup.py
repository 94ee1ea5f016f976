"""Near duplicates by BagMinHash.

A document is the multiset of its shingles of five words (white-space runs apart, as
they stand); a document of one to four words is one shingle. Two documents are linked if
their weighted Jaccard similarity, the sum of least over the sum of greatest counts, is
0.8 or more.

Signatures. The weights of a shingle are discretised into the intervals [0,1), [1,2), [2,4),
[4,8) and so on. Each interval has its own Poisson process in time, seeded by shingle and interval, whose rate is
the interval's length times the signature's size; a point falls on a random component and
a random height of the interval, and counts for documents whose weight is above that height. A component's value is
its first point's time, so two documents agree in it with probability equal to their weighted Jaccard
similarity. Points are made in ascending order and end at the signature's greatest value.

Banding. BANDS bands of ROWS components; at 0.8 all bands miss with probability below 1e-4.

Links. Equal multisets are one class first, so copies cost nothing. In each bucket every class
is verified against the bucket's least one; the links make components. Buckets that still hold several components
may hide links between them (and many hold documents that merely share a passage); their classes are joined by an
exact prefix filter instead of in pairs: with shingles in one order for all, rarest first, two multisets of similarity
SIMILAR share a shingle in the first parts of their weights of which the rest is under SIMILAR of the whole. So only classes that share
such a rare shingle, are of different components, of similar sizes, and have enough weight from there on, are
verified: no link is lost, and no bucket emits its pairs. How rare a shingle is comes from counts in a table of
fixed size; collisions there cost time, never a link.

Cases: null texts are empty; documents without words are one class; ties in a group go to the least doc_id; rows
that repeat a doc_id with another text are two members of that id; null doc_ids stand for the least
possible id and come back as null; no rows give no rows; extra columns stay in ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import bound_batches, discard, forget, free_name, hot_keys, salted, skew_join, spread, table, text_of, worker_state, written

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
COMPONENTS = BANDS * ROWS
#: Text bytes that are hashed together.
TOGETHER = 1 << 20
#: Bits of the fixed-size filter that keeps texts without candidates out of the verifying shuffle.
FILTER_BITS = 1 << 23
#: Counters of the table that shingles are ordered by.
COUNTERS = 1 << 18
NO_ID = -(1 << 63)

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2^64. A worker keeps those that common texts need."""

    def make(size: int) -> list[np.ndarray]:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, _U(base))
            p[0] = _U(1)
            made.append(np.multiply.accumulate(p))
        return made

    usual = TOGETHER + 65536
    power, inverse = worker_state("shingle-powers", lambda: make(usual)) if n <= usual else make(n)
    return power[:n], inverse[:n]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of the texts, sorted by document and shingle."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) > len(starts):
        ends = ends[len(ends) - len(starts) :]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    power, inverse = _powers(len(data))
    total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * power, dtype=_U)])
    word = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U) * _GOLD)
    lengths = np.array([len(t) + 1 for t in texts])
    doc = np.repeat(np.arange(len(texts)), lengths)[starts]
    count = np.bincount(doc, minlength=len(texts))
    weights = np.multiply.accumulate(np.full(WORDS, _GOLD | _U(1)))
    n = len(word)
    if n >= WORDS:
        grams = sum(word[k : n - WORDS + 1 + k] * weights[k] for k in range(WORDS))
        whole = doc[: n - WORDS + 1] == doc[WORDS - 1 :]
        of, made = doc[: n - WORDS + 1][whole], mix(grams[whole])
    else:
        of, made = np.zeros(0, np.int64), np.zeros(0, _U)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        first = np.searchsorted(doc, short)
        own = [mix(np.array([sum((int(w) * int(g) for w, g in zip(word[a : a + c], weights)), int(c)) & (2**64 - 1)], _U))[0] for a, c in zip(first, count[short])]
        of, made = np.concatenate([of, short]), np.concatenate([made, np.array(own, _U)])
    order = np.lexsort((made, of))
    of, made = of[order], made[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (made[1:] != made[:-1])
    at = np.flatnonzero(new)
    return of[at], made[at], np.diff(np.append(at, len(of)))


def bagminhash(n_docs: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, size: int = COMPONENTS) -> np.ndarray:
    """n_docs x size times of first points; infinite for documents without shingles."""
    h = np.full(n_docs * size, np.inf)
    # a process for each interval that begins below the weight
    level = np.zeros(len(doc), np.int64)
    parts = [(doc, shingle, weight, level)]
    k, more = 1, weight > 1
    while more.any():
        parts.append((doc[more], shingle[more], weight[more], np.full(int(more.sum()), k)))
        more = weight > (1 << k)
        k += 1
    doc, shingle, weight, level = (np.concatenate(c) for c in zip(*parts))
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(float)
    length = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(float)
    seed = mix(shingle ^ (level.astype(_U) * _U(0xA24BAED4963EE407)))
    step = 1 / (length * size)
    weight, x = weight.astype(float), np.zeros(len(doc))
    base = doc * size
    j = 0
    while len(doc):
        j += 1
        r = mix(seed + _U((j * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        x = x - np.log(((r >> _U(11)).astype(float) + 0.5) * 2.0**-53) * step
        r = mix(r)
        component = ((r & _U(0xFFFFFFFF)) * _U(size) >> _U(32)).astype(np.int64)
        inside = low + (r >> _U(32)).astype(float) * 2.0**-32 * length < weight
        np.minimum.at(h, (base + component)[inside], x[inside])
        live = np.unique(doc)
        top = np.full(n_docs, -np.inf)
        top[live] = h.reshape(n_docs, size)[live].max(1)
        on = x < top[doc]
        doc, seed, step, weight, x, base, low, length = (a[on] for a in (doc, seed, step, weight, x, base, low, length))
    return h.reshape(n_docs, size)


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    bits = h.view(_U).reshape(len(h), bands, rows)
    keys = np.zeros((len(h), bands), _U) + np.arange(bands, dtype=_U) * _U(0x8CB92BA72F3D8DD7)
    for k in range(rows):
        keys = mix(keys ^ bits[:, :, k])
    return keys.view(np.int64)


def _grouped(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) < TOGETHER):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def signatures(documents: DataFrame) -> DataFrame:
    """(id, n, key, bands): doc_id, number of shingles, 16 bytes that stand for the multiset, band keys (none without shingles)."""
    bound_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            sizes, keys, bands = [], [], []
            for lo, hi in _grouped(texts):
                doc, made, weight = shingles(texts[lo:hi])
                some = np.bincount(doc, weights=weight, minlength=hi - lo).astype(np.int64)
                sums = []
                for salt in (1, 2):
                    total = np.zeros(hi - lo, _U)
                    np.add.at(total, doc, mix(mix(made + _U(salt)) ^ weight.astype(_U)))
                    sums.append(total)
                both = np.stack(sums, 1).tobytes()
                keys += [both[k : k + 16] for k in range(0, len(both), 16)]
                sizes += some.tolist()
                made_keys = band_keys(bagminhash(hi - lo, doc, made, weight))
                bands += [row if n else [] for row, n in zip(made_keys, some)]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "key", "bands"])

    given = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text_of().alias("text"))
    return given.mapInArrow(run, "id long, n long, key binary, bands array<long>")


def _similar_sizes(a, b):
    return F.least(a, b) >= SIMILAR * F.greatest(a, b)


def _possible(ids: DataFrame) -> DataFrame:
    """(word, bits): a bitmap of FILTER_BITS bits of the hashed ids, in at most FILTER_BITS / 64 rows, whatever the number of ids."""
    place = spread("id", buckets=FILTER_BITS, seed=9)
    return ids.select(F.floor(place / 64).cast("int").alias("word"), F.expr("shiftleft(1L, 0)").alias("one"), (place % 64).alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits"))


def texts_of(ids: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, text) of rows of ``documents`` that include those of the distinct ``ids`` (a bitmap keeps most others out, so that their texts aren't shuffled)."""
    place = spread("id", buckets=FILTER_BITS, seed=9)
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text_of().alias("text")).withColumn("word", F.floor(place / 64).cast("int"))
    may = F.expr(f"(shiftright(bits, CAST(pmod(xxhash64(9, id), {FILTER_BITS}) % 64 AS INT)) & 1) = 1")
    return texts.join(F.broadcast(_possible(ids)), "word").where(may).select("id", "text")


def verify(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts' similarity is SIMILAR or more.

    Each pair sends the text of b to where that of a is; the members of a hot a are spread over salts, each
    of which gets a's text first. A task holds one text's shingles and those of the batch's members in turn.
    """
    bound_batches(documents.sparkSession)
    sent = written(salted(pairs.select("a", "b"), "a", hot_keys(pairs, "a"), "split", "left"), "near-pairs")
    wanted = sent.select("a", F.col("b").alias("id"), "split", F.lit(1).alias("kind")).unionByName(sent.select("a", F.col("a").alias("id"), "split", F.lit(0).alias("kind")).distinct())
    rows = wanted.join(texts_of(wanted.select("id"), documents), "id").select("a", "split", "kind", F.col("id").alias("b"), "text").repartition("a", "split").sortWithinPartitions("a", "split", "kind", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        at, own = None, []  # own: one, or more where rows repeat a doc_id
        for batch in batches:
            firsts, splits, kinds, seconds = (batch.column(k).to_pylist() for k in range(4))
            texts = batch.column(4).cast(pa.binary()).to_pylist()
            out_a, out_b = [], []
            for lo, hi in _grouped(texts):
                doc, made, weight = shingles(texts[lo:hi])
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                for k in range(lo, hi):
                    s = slice(edges[k - lo], edges[k - lo + 1])
                    if kinds[k] == 0:
                        if (firsts[k], splits[k]) != at:
                            at, own = (firsts[k], splits[k]), []
                        own.append((made[s], weight[s], int(weight[s].sum())))
                        continue
                    if (firsts[k], splits[k]) != at:
                        raise ValueError("a pair came before its first text")
                    for mine, weights, whole in own:
                        _, i, j = np.intersect1d(mine, made[s], assume_unique=True, return_indices=True)
                        common = int(np.minimum(weights[i], weight[s][j]).sum())
                        if common and common >= SIMILAR * (whole + int(weight[s].sum()) - common) - 1e-9:
                            out_a.append(firsts[k])
                            out_b.append(seconds[k])
                            break
            yield pa.record_batch([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _rarity(texts: DataFrame) -> np.ndarray:
    """How many of ``texts`` (id, text) hold shingles of each of COUNTERS slots; COUNTERS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in _grouped(texts):
                counts += np.bincount((shingles(texts[lo:hi])[1] % _U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        slots = np.flatnonzero(counts)
        for lo in range(0, len(slots), 1 << 16):
            some = slots[lo : lo + (1 << 16)]
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["slot", "n"])

    table_ = texts.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[table_.column("slot").to_numpy()] = table_.column("n").to_numpy()
    return counts


def prefixes(texts: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(id, shingle, rest): the shingles of each text's prefix, and the weight from each on in the common order."""
    known = texts.sparkSession.sparkContext.broadcast(np.minimum(rarity, 2**31 - 1).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts, ids = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(0).to_numpy()
            for lo, hi in _grouped(texts):
                doc, made, weight = shingles(texts[lo:hi])
                order = np.lexsort((made, known.value[(made % _U(COUNTERS)).astype(np.int64)], doc))
                doc, made, weight = doc[order], made[order], weight[order]
                whole = np.bincount(doc, weights=weight, minlength=hi - lo)
                before = np.cumsum(weight) - weight
                first = np.searchsorted(doc, np.arange(hi - lo))
                rest = whole[doc] - (before - before[np.minimum(first, len(doc) - 1)][doc])
                keep = rest >= SIMILAR * whole[doc] - 1e-9
                yield pa.record_batch([pa.array(ids[lo:hi][doc[keep]]), pa.array(made[keep].view(np.int64)), pa.array(rest[keep].astype(np.int64))], ["id", "shingle", "rest"])

    return texts.mapInArrow(run, "id long, shingle long, rest long")


def across(open_: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``open_`` (rep, n, component) that can be similar and are in different components."""
    texts = written(texts_of(open_.select(F.col("rep").alias("id")), documents).join(open_.select(F.col("rep").alias("id")), "id", "left_semi"), "near-open")
    made = prefixes(texts, _rarity(texts))
    rows = made.join(open_.withColumnRenamed("rep", "id"), "id").select("shingle", "id", "rest", "n", "component")
    # a shingle that one component holds alone makes no pairs
    shared = written(rows, "near-prefixes")
    met = shared.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("shingle")
    left = written(shared.join(met, "shingle", "left_semi"), "near-shared")
    hot = hot_keys(left, "shingle")
    right = salted(left.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("id", "rest", "n", "component")]), "shingle", hot, "salt", "right")
    n, n2, rest = F.col("n"), F.col("n2"), F.least("rest", "rest2")
    likely = (F.col("component") < F.col("component2")) & _similar_sizes(n, n2) & (rest * (1 + SIMILAR) >= SIMILAR * (n + n2) - 1e-9)
    return salted(left, "shingle", hot, "salt", "left").join(right, ["shingle", "salt"]).where(likely).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the least id of each linked id's component, by alternating large-star and small-star steps until nothing changes."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """One step, as a table; those that it was made from go."""
        sides = edges.select("u", "v")
        if large:
            sides = sides.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        sides = written(sides, "near-sides")
        met = skew_join(sides, least, "u")
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        made = written(moved.where("u <> v").distinct(), "near-large" if large else "near-small")
        discard(sides, edges)
        return made

    state = None
    for _ in range(most_rounds):
        edges = star(star(edges, True), False)
        # the steps end when the edges do: stars, whose sums stay
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
    raise RuntimeError("components didn't settle")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, copy_of (least doc_id with the same shingles), class_id (least doc_id of its group), n_shingles."""
    signed = written(signatures(documents), "near-signatures")
    classes = written(signed.groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "near-classes")
    members = classes.select(F.explode("bands").alias("band"), "rep", "n")
    buckets = written(members.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "first"), "near-buckets")
    held = written(skew_join(members, buckets, "band"), "near-members")
    pairs = held.where((F.col("rep") != F.col("first.rep")) & _similar_sizes(F.col("n"), F.col("first.n"))).select(F.col("first.rep").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = written(pairs, "near-candidates")
    links = written(verify(pairs, documents), "near-links")
    found = components(links)
    # buckets that still hold several components
    grouped = held.select("band", "rep", "n").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    grouped = written(grouped, "near-grouped")
    mixed = written(grouped.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band"), "near-mixed")
    open_ = written(skew_join(grouped, mixed, "band").select("rep", "n", "component").distinct(), "near-open-classes")
    if not open_.isEmpty():
        more = written(across(open_, documents).join(pairs, ["a", "b"], "left_anti"), "near-across")
        new = written(verify(more, documents), "near-links")
        if not new.isEmpty():
            found = components(links.unionByName(new))
        discard(more, new)
    discard(buckets, held, pairs, links, grouped, mixed, open_)
    of_class = classes.select("key", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("group"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return skew_join(signed.select("key", "id", "n"), of_class, "key").select(back("id").alias("doc_id"), back("rep").alias("copy_of"), back("group").alias("class_id"), F.col("n").alias("n_shingles"))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """``documents`` with the least doc_id of each group alone; rows that share a doc_id stay or go together."""
    name = free_name(documents, "__stays")
    stay = near_duplicates(documents).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(stay, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")


def op9_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
