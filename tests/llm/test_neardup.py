import random
from collections import Counter

from gridloom.llm.neardup import SIMILAR, across, drop_near_duplicates, near_duplicates, op9_near_dup

SF = "/root/testdata/sf0.001"


def multiset(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def brute(texts):
    """doc -> least doc of its group, over all pairs."""
    sets = {k: multiset(t) for k, t in texts.items()}
    group = {k: k for k in texts}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids, by = sorted(texts), {}
    for k in ids:
        for s in sets[k] or [()]:
            by.setdefault(s, []).append(k)
    for a, b in {(a, b) for ks in by.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}:
        both = sum((sets[a] & sets[b]).values())
        if not sets[a] and not sets[b] or both >= SIMILAR * (sum(sets[a].values()) + sum(sets[b].values()) - both):
            x, y = sorted((find(a), find(b)))
            group[y] = x
    return {k: find(k) for k in ids}


def cases():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "  \n", "one two", "one\ttwo ", "one two three", "a b c d e", "a b c d e f"]
    for size in (30, 80, 300, 3000):
        base = [rng.choice(words) for _ in range(size)]
        texts += [" ".join(base), " ".join(base), "\n".join(base)]
        for changes in (0.005, 0.01, 0.02, 0.05):
            for _ in range(4):
                texts.append(" ".join(w if rng.random() > changes else rng.choice(words) for w in base))
    chain = [rng.choice(words) for _ in range(200)]
    for k in range(12):  # each like the next, the ends unlike
        texts.append(" ".join(chain))
        chain = chain[8:] + [rng.choice(words) for _ in range(8)]
    texts += ["spam " * 500, "spam " * 450, "spam " * 300]
    return texts


def test_groups_match_brute_force(spark):
    texts = dict(enumerate(cases()))
    docs = spark.createDataFrame([(k, t, "z") for k, t in texts.items()], "doc_id long, text string, key string")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == brute(texts)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.class_id for r in op9_near_dup(spark, SF).collect()} == brute(texts)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, None)], "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert len(got) == 4 and {r.doc_id: r.class_id for r in got} == {None: None, 3: None, 4: 4}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(12)
    texts = []
    for size in (5, 9, 40, 200):
        base = [rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(size)]
        texts += [" ".join(w if rng.random() > change else "new" + str(rng.random()) for w in base) for change in (0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1) for _ in range(4)]
    texts += ["spam " * n for n in (90, 100, 110, 125)]
    sets = {k: multiset(t) for k, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    open_ = spark.createDataFrame([(k, sum(s.values()), k) for k, s in sets.items()], "rep long, n long, component long")
    got = {(r.a, r.b) for r in across(open_, docs).collect()}
    alike = lambda a, b: sum((a & b).values()) >= SIMILAR * sum((a | b).values())
    want = {(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])}
    assert want and want <= got and len(got) < len(texts) ** 2 / 4
    # components that are known already aren't compared again
    assert across(open_.withColumn("component", open_.n * 0), docs).count() == 0


def test_many_documents_that_share_a_passage(spark):
    rng, passage = random.Random(13), " ".join(f"w{k}" for k in range(40))
    own = lambda k, n=15: " ".join(f"d{k}x{j}" for j in range(n))
    texts = {k: f"{passage} {own(k)}" for k in range(8000)}
    copies = {8000 + k: f"{passage} {own(k, 14)} other" for k in rng.sample(range(8000), 60)}
    docs = spark.createDataFrame([*texts.items(), *copies.items()], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == {k: k for k in texts} | {k: k - 8000 for k in copies}


def test_rows_that_repeat_a_doc_id_with_other_texts(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(1, "unlike " * 9), (1, " ".join(words)), (2, " ".join(words[:-1] + ["x"])), (7, " ".join(words[:-2] + ["y", "z"]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {r.class_id for r in got} == {1}
