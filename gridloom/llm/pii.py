"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

Base spans (email, ip, card, phone) come from regular expressions that run in linear
time and are checked afterwards (ranges, Luhn, digit counts). The bootstrap works on mentions:

* seed mentions are the base spans, of any kind and shape, and identifier-like tokens that have
  the shape of a credential (many characters of letters and digits mixed, without a word in them);
* the other mentions are identifier-like tokens that touch no base span: several digits, an @, an underscore
  between letters, or many characters with a digit, of mixed case or in capitals;
* lexical patterns of a mention are the one to three words before it, or the one or two after it, with the
  punctuation between (digits in them count as 0, letters in lower case, and a pattern holds a letter), and the four letters
  that it begins with, as issuers of keys give their keys a common beginning;
* a pattern's confidence is the summed score of what it introduces, over all mentions that it
  introduces (and one more, so that few occurrences are no proof);
* an instance's score is 1 for seeds, else the chance that any of its accepted patterns is right.

Both are scored in turn over the pattern-instance graph. Patterns of high confidence and enough distinct
good instances mark whatever they introduce that the base patterns don't know: credentials by their
contexts alone (a credential's shape in no accepted context is not reported), and identifiers of any shape.

All of it is made of DataFrame functions. Matches become rows (text, kind, number in the text), their places are running
sums over windows, so that the work is in proportion to the matches, and equal texts are one from there on.

Cases: null texts are empty, and empty texts have no spans; rows that repeat a document or a text get the same spans, one
output row a row; no rows give no rows; ties are ordered by start, then kind, then end; extra columns
aren't read. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import SPACE, discard, skew_join, table, text_of, written

KINDS = ("email", "ip", "card", "phone", "context")
CONTEXT = KINDS.index("context")
ROUNDS = 3
#: A pattern is accepted from this confidence and so many distinct good instances on.
MIN_CONFIDENCE = 0.7
MIN_SUPPORT = 3
MIN_SCORE = 0.5
#: The least length of an identifier-like token, and of a credential.
MIN_CHARS, CREDENTIAL_CHARS = 6, 16
#: Characters of text on each side of a mention that its patterns are taken from.
BEFORE, AFTER = 64, 48

# Possessive, and tried only where a longest run begins (or where the last match ended): linear time, and the
# same leftmost matches, since whether a run is followed by the next part doesn't depend on where in it one starts.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Runs of fewer digits fail the test anyway; what is left of such a run has fewer still.
CARD = r"(?:\G|(?<![0-9]))(?=[0-9](?:[\x20-]?[0-9]){11})[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Whole tokens: three digits, an @, an underscore between letters or digits, or sixteen characters with a digit, with a capital after a small letter, or of capitals.
TOKEN = (
    rf"(?<![^{SPACE}])(?=[^{SPACE}]{{{MIN_CHARS}}})"
    rf"(?:(?=(?:[^{SPACE}0-9]*+[0-9]){{3}})|(?=[^{SPACE}@]*+@)|(?=[^{SPACE}]*?[A-Za-z0-9]_[A-Za-z0-9])|(?=[^{SPACE}]{{16}})(?:(?=[^{SPACE}0-9]*+[0-9])|(?=[^{SPACE}a-z]*+[^{SPACE}A-Z]*+[A-Z])|(?=[^{SPACE}]*?[A-Z]{{16}})))[^{SPACE}]++"
)
#: What of a token comes before its instance (up to the last = : quote or bracket, and further punctuation), and after it.
LEAD, TRAIL = r"^(?:[^/@]*[=:\"'<>(\[{,;|])?[^A-Za-z0-9+@]*", r"^[^A-Za-z0-9]*+"  # TRAIL of the reversed token
#: What an instance must still have.
LIKE = r"^(?:(?:[^0-9]*+[0-9]){3}|[^@]*+@|(?s:.*?)[A-Za-z0-9]_[A-Za-z0-9]|[^a-z]*+[^A-Z]*+[A-Z]|(?=.{16})(?:[^0-9]*+[0-9]|.*?[A-Z]{16}))"
FOUND = "array<struct<kind:int,nr:int,gap:int,hit:string,head:string,tail:string>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(k % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _between(value: Column, low: int, high: int) -> Column:
    return (value >= low) & (value <= high)


def _part(p: Column) -> Column:
    return (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")).cast("int"), F.lit(0)) <= 255)


#: Of each kind: the pattern, a quick test of the text, and the test that a match must pass.
FINDERS = (
    (EMAIL, lambda text: F.contains(text, F.lit("@")), None),
    (IP, lambda text: text.rlike(r"[0-9]\.[0-9]"), lambda hit: F.forall(F.split(hit, r"\."), _part)),
    (CARD, lambda text: text.rlike(r"[0-9][\x20-]?[0-9]"), lambda hit: F.when(_between(F.length(_digits(hit)), 12, 19), luhn(_digits(hit))).otherwise(False)),
    (PHONE, lambda text: F.contains(text, F.lit("+")), lambda hit: _between(F.length(_digits(hit)), 9, 15)),
    (TOKEN, lambda text: text.rlike("[0-9@_]|[a-z][A-Z]|[A-Z]{16}"), None),
)


def finds(text: Column) -> Column:
    """array<struct<kind, nr, gap, hit, head, tail>>: each match of each kind with the length, the beginning and the end of the text before it; the last of a kind is the empty one at the end of the text."""

    def of_kind(kind: int, pattern: str, when) -> Column:
        # \G first: a match is looked for only from where the last one ended, and the gap grows until one is found
        finder = F.lit(rf"\G(?s:(.*?))({pattern}|\z)")
        pairs = F.arrays_zip(F.regexp_extract_all(text, finder, F.lit(1)).alias("gap"), F.regexp_extract_all(text, finder, F.lit(2)).alias("hit"))
        shape = lambda p, nr: F.struct(
            F.lit(kind).alias("kind"),
            nr.alias("nr"),
            F.length(p["gap"]).alias("gap"),
            p["hit"].alias("hit"),
            F.substring(p["gap"], 1, AFTER).alias("head"),
            F.right(p["gap"], F.lit(BEFORE + 1)).alias("tail"),
        )
        return F.when(when(text), F.transform(pairs, shape)).otherwise(F.array().cast(FOUND))

    # the end of the text counts only after a match
    return F.filter(F.concat(*(of_kind(kind, pattern, when) for kind, (pattern, when, _) in enumerate(FINDERS))), lambda m: (m["hit"] != "") | ((m["nr"] > 0) & (m["gap"] > 0)))


def placed(found: DataFrame) -> DataFrame:
    """The matches of ``found`` (of: the text; kind, nr, gap, hit, head, tail) at their places: of, kind, hit, start, end, before, after."""
    order = Window.partitionBy("of", "kind").orderBy("nr")
    size = F.length("hit")
    rows = found.dropDuplicates(["of", "kind", "nr"])  # copies of a text
    ends = rows.select("of", "kind", "hit", F.sum(F.col("gap") + size).over(order).cast("int").alias("end"), F.col("tail").alias("before"), F.coalesce(F.lead("head").over(order), F.lit("")).alias("after"))
    return ends.where("hit <> ''").select("of", "kind", "hit", (F.col("end") - size).alias("start"), "end", "before", "after")


def base_of(places: DataFrame) -> DataFrame:
    """The matches that pass their kind's test."""
    passes = F.lit(False)
    for kind, (_, _, test) in enumerate(FINDERS[:CONTEXT]):
        passes = F.when(F.col("kind") == kind, test(F.col("hit")) if test else F.lit(True)).otherwise(passes)
    return places.where(passes)


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, rf"[{SPACE}]+", " ")), "[0-9]+", "0")


def patterns(before: Column, instance: Column, after: Column) -> Column:
    """The lexical patterns of a mention, as text."""
    whole = F.when(F.length(before) > BEFORE, F.regexp_replace(before, rf"^[^{SPACE}]*", "")).otherwise(before)  # no half words
    left, right = _plain(whole), _plain(after)
    words = [F.concat(F.lit(f"<{k} "), F.regexp_extract(left, rf"(?:^| )((?:[^ ]+ ){{{k - 1}}}[^ ]+ ?)$", 1)) for k in (1, 2, 3)]
    words += [F.concat(F.lit(f">{k} "), F.regexp_extract(right, rf"^ ?([^ ]+(?: [^ ]+){{{k - 1}}})", 1)) for k in (1, 2)]
    words.append(F.concat(F.lit("= "), F.regexp_extract(instance, r"^\p{L}{4}", 0)))
    return F.filter(F.array(*words), lambda w: w.rlike(r"\p{L}"))


def is_credential(instance: Column) -> Column:
    changes = F.regexp_count(instance, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"))
    return (F.length(instance) >= CREDENTIAL_CHARS) & instance.rlike("^[A-Za-z0-9+_=-]+$") & (changes >= 4)


def mentions(places: DataFrame) -> DataFrame:
    """(of, kind, start, end, instance, seed, pattern): base spans and the identifier-like tokens that touch none, a row a pattern."""
    base = base_of(places).select("of", "kind", "start", "end", F.col("hit").alias("instance"), "before", "after")
    hit = F.col("hit")
    trail = F.reverse(F.regexp_extract(F.reverse(hit), TRAIL, 0))
    lead = F.regexp_extract(F.left(hit, F.length(hit) - F.length(trail)), LEAD, 0)
    own = F.substring(hit, F.length(lead) + 1, F.length(hit) - F.length(lead) - F.length(trail))
    tokens = places.where(F.col("kind") == CONTEXT).select(
        "of",
        "kind",
        (F.col("start") + F.length(lead)).alias("start"),
        (F.col("end") - F.length(trail)).alias("end"),
        own.alias("instance"),
        F.concat("before", lead).alias("before"),
        F.concat(trail, "after").alias("after"),
    )
    tokens = tokens.where((F.length("instance") >= MIN_CHARS) & F.col("instance").rlike(LIKE))
    both = base.unionByName(tokens)
    is_base = F.col("kind") != CONTEXT
    # two running bounds instead of comparing each token with each span
    forth, back = Window.partitionBy("of").orderBy("start", "kind", "end"), Window.partitionBy("of").orderBy(F.desc("start"), F.desc("kind"), F.desc("end"))
    reached = F.max(F.when(is_base, F.col("end"))).over(forth)
    begins = F.min(F.when(is_base, F.col("start"))).over(back)
    apart = (F.coalesce(F.col("reached"), F.lit(0)) <= F.col("start")) & (F.col("begins").isNull() | (F.col("begins") >= F.col("end")))
    free = both.withColumn("reached", reached).withColumn("begins", begins).where(is_base | apart)
    seed = is_base | is_credential(F.col("instance"))
    return free.select("of", "kind", "start", "end", "instance", seed.alias("seed"), F.explode(patterns(F.col("before"), F.col("instance"), F.col("after"))).alias("pattern"))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> list[DataFrame]:
    """The accepted patterns (pattern, confidence) after each round, from edges (pattern, instance, n, seed)."""
    n, seed = F.col("n"), F.col("seed")
    totals = written(edges.groupBy("pattern").agg(F.sum("n").alias("total"), F.sum(F.when(seed, n).otherwise(0)).alias("good"), F.count(F.when(seed, 1)).alias("support")), "pii-totals")
    open_ = written(edges.where(~seed).select("pattern", "instance", "n"), "pii-open")
    judged, accepted = totals, []
    for step in range(rounds):
        rated = judged.where(F.col("support") >= MIN_SUPPORT).select("pattern", (F.col("good") / (F.col("total") + 1)).alias("confidence"))
        accepted.append(written(rated.where(F.col("confidence") >= MIN_CONFIDENCE), "pii-patterns"))
        if step < rounds - 1:
            scores = skew_join(open_, accepted[-1], "pattern").groupBy("instance").agg(F.max("confidence").alias("score"))
            gained = skew_join(open_, written(scores, "pii-scores"), "instance").groupBy("pattern").agg(F.sum(n * F.col("score")).alias("more"), F.count(F.when(F.col("score") >= MIN_SCORE, 1)).alias("supports"))
            zero = lambda c: F.coalesce(F.col(c), F.lit(0))
            judged = totals.join(gained, "pattern", "left").select("pattern", "total", (F.col("good") + zero("more")).alias("good"), (F.col("support") + zero("supports")).alias("support"))
    return accepted


def find_pii(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): ``base`` and ``spans``, arrays of (start, kind, end)."""
    text = text_of()
    # the text is read once; what is kept of it is small
    kept = written(documents.select("doc_id", F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("of"), finds(text).alias("found")), "pii-finds")
    places = written(placed(kept.select("of", F.explode("found").alias("m")).select("of", "m.*")), "pii-places")
    seen = written(mentions(places), "pii-mentions")
    edges = seen.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.bool_or("seed").alias("seed"))
    accepted = bootstrap(edges)[-1]
    new = skew_join(seen.where(F.col("kind") == CONTEXT), accepted, "pattern").select("of", "start", "kind", "end").distinct()
    all_ = base_of(places).select("of", "start", "kind", "end").unionByName(new)
    of_text = all_.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))  # bounded by a text's tokens
    of_text = written(of_text, "pii-texts")
    discard(places, seen)
    joined = skew_join(kept.select("doc_id", "of"), of_text, "of", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return joined.select("doc_id", F.filter(spans, lambda s: s["kind"] != CONTEXT).alias("base"), spans.alias("spans"))


def written_spans(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    sizes = ((F.size("spans") - F.size("base")).cast("long").alias("n_context"), F.size("spans").cast("long").alias("n_spans"))
    return found.select("doc_id", count("email"), count("ip"), count("card"), count("phone"), F.sha2(F.encode(written_spans(F.col("base")), "UTF-8"), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"), *sizes)


def pii_base_counts(spark, sf_dir: str) -> DataFrame:
    """The counts of base spans alone, which SQL can express."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")
