import random
import re
import time
from collections import Counter

from gridloom.llm.pii import bootstrap, find_pii, op3_pii, pii_base_counts

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    for kind, (name, pattern) in enumerate(
        {
            "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        }.items()
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


TEXTS = [
    None,
    "",
    "a@b.c_d@e.f x@y z@@q.r %+-@a-b.c-d. é me.x@mail.example.com\n1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 0000255.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 5 5 12 4111111111111111 4111  1111",
    "+1 (499) 555-6503 ++49 30 1234567- +1( +12345678 +1234567890123456 +9 (",
    "1.2.3 .1.2.3.4. 1..2.3.4 99999999999999999999.1.1.1",
    "0" * 30000 + " " + "a" * 30000 + "@ " + "a." * 9000 + "@b " + "1-" * 9000,
    "😀 a@b.cc 😀 9.9.9.9",
]


def test_base_spans_match_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = find_pii(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [tuple(s) for s in r.base] == brute(TEXTS[r.doc_id]), r.doc_id
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op3_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute(texts[r.doc_id])
        names = ("email", "ip", "card", "phone")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        assert r.spans.startswith(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)) or r.n_context


def contexts(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 4] for r in find_pii(docs).collect()}


def test_bootstrap_finds_identifiers_in_seeded_contexts(spark):
    texts = [f"note account: 4111 1111 1111 1111{k} rest" if k % 2 else f"server host: 10.0.0.{k} up" for k in range(24)]
    texts += ["server host: node-77812x down", "the house 12345678 stands", "more host: gate991 too"]
    got = contexts(spark, texts)
    assert got[24] == [(13, 24)] and got[25] == [] and got[26] == [(11, 18)]


def test_planted_identifiers_are_found_and_others_left_alone(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"]
    some = lambda: " ".join(rng.choices(words, k=6))
    credential = lambda: "".join(rng.choice("abcdef") + rng.choice("0123456789") for _ in range(20))
    texts = [f'{some()} token = "{credential()}" {some()}' for _ in range(40)]
    unseen = ["hunter_two", "Tr0ub4d0r&3", "correctHorseBatteryStaple", "991-xx-204", "pass@word"]
    first = len(texts)
    texts += [f'{some()} token = "{u}"; {some()}' for u in unseen]
    other = len(texts)
    texts += [f"{w} {k} {thing}, {some()}" for k, (w, thing) in enumerate([("version", "1.2.345-rc_7"), ("invoice", "2024-0199"), ("total", "1,000,000"), ("built", "2024-01-01T00:00:00"), ("flight", "LH-4711/2")] * 3)]
    got = contexts(spark, texts)
    for k, u in enumerate(unseen, first):
        at = texts[k].index(u)
        assert got[k] == [(at, at + len(u))], u
    assert all(len(got[k]) == 1 for k in range(first)) and not any(got[k] for k in range(other, len(texts)))


def test_keys_of_a_common_beginning_are_found_in_any_context(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    keys = ["ZQKV" + "".join(rng.choice("ABCDEFGH") + rng.choice("234567") for _ in range(8)) for _ in range(20)]
    keys += ["ZQKVABCDEFGHABCDEFGH", "ZQKV2BCDEFGHABCDEFGH"]  # without digits, and with one
    texts = [f"{word()} {word()} {k} {word()} {word()}." for k in keys] + ["THE WORDINCAPITALSONLYHERE STANDS", "zqkvett 4 of them"]
    got = contexts(spark, texts)
    assert [got[k] for k in range(len(texts))] == [[(12, 32)]] * len(keys) + [[], []]


def test_a_text_of_many_matches_takes_seconds(spark):
    text = " ".join(f"id{k:06d} +1 ({k % 900 + 100}) 555-7713" if k % 5 == 0 else f"n{k:07d}" for k in range(100_000))
    begun = time.time()
    (row,) = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(row.base) == 20_000 and time.time() - begun < 60
    assert [(s.start, s.kind, s.end) for s in row.base] == brute(text)


def test_extra_columns_and_repeated_rows(spark):
    extra = ["of", "found", "kind", "nr", "start", "end", "pattern", "seed", "base", "spans", "hit", "__hot", "__salt"]
    rows = [(k, t, *extra) for k, t in [(1, "a@b.cc"), (1, "a@b.cc"), (1, "x 9.9.9.9"), (None, None), (None, "a@b.cc")]]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in extra)]))
    got = Counter((r.doc_id, tuple(map(tuple, r.base))) for r in find_pii(docs).collect())
    assert got == {(1, ((0, 0, 6),)): 2, (1, ((2, 1, 9),)): 1, (None, ()): 1, (None, ((0, 0, 6),)): 1}


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_travel_over_the_graph(spark):
    edges = [("p", f"s{k}", 1, True) for k in range(12)] + [("p", x, 1, False) for x in "xyzuv"[:3]] + [("q", i, 4, False) for i in "xyz"]
    edges += [("r", f"s{k}", 1, True) for k in range(2)] + [("t", f"s{k}", 1, True) for k in range(3)] + [("t", "w", 2, False)]
    rounds = bootstrap(spark.createDataFrame(edges, "pattern string, instance string, n long, seed boolean"), 2)
    first, later = ({r.pattern: r.confidence for r in a.collect()} for a in rounds)
    # p: 12 of 15 (and one more); q: its 12 occurrences count 0.75 each then, of 13; r: too few; t: 3 of 5
    assert first == {"p": 12 / 16} and "q" not in first
    assert set(later) == {"p"} and abs(later["p"] - (12 + 3 * 0.75) / 16) < 1e-9
    richer = [("p", f"s{k}", 1, True) for k in range(40)] + [("p", x, 1, False) for x in "xyz"] + [("q", i, 4, False) for i in "xyz"]
    rounds = bootstrap(spark.createDataFrame(richer, "pattern string, instance string, n long, seed boolean"), 2)
    assert [{r.pattern for r in a.collect()} for a in rounds] == [{"p"}, {"p", "q"}]


def test_seeds_of_every_shape_introduce_their_context(spark):
    names = [f"{a}{b}" for a in ("ann", "ben", "cid", "dan") for b in "xyz"]
    texts = [f"call: +1 (017) 555-77{k:02d} card:\t4111 1111 1111 1111 mail:  {name}@x.com at7 10.0.0.{k}" for k, name in enumerate(names)]
    texts += [f"card: {c} end" for c in ("4012 8888 8888 1881", "5555-5555-5555-4444")]
    found = {"call: ext-55712 now": (6, 15), "card: no.99123 now": (6, 14), "mail: user_70011 now": (6, 16), "at7 node-77812x now": (4, 15)}
    none = ["pair: a@b.co,c@d.co", "pair: e@f.co", "pair: one-1", "pair: key-55123", "pair: key-55124", "4 12345678"]
    got = contexts(spark, [*texts, *found, *none])
    assert [got[k] for k in range(len(got))] == [[]] * len(texts) + [[span] for span in found.values()] + [[]] * len(none)
