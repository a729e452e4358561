"""Personal data: pattern spans, and contextual extraction bootstrapped from them.

Base spans (email, ip, card, phone) are matches of fixed patterns.  They seed a
bootstrap with certainty; words that look like credentials (16 or more letters
and digits mixed) seed it with the weight ``CREDENTIAL``.  What stands before a
slot is a lexical pattern: the key in ``key=`` or ``key:`` if the slot's word
begins with one, else the two words before, with the punctuation that the
slot's word begins with.  The identifier-like words (with a digit or an @) that
fill its slots are its instances.  On the graph of patterns and instances,
scores go back and forth: a pattern's is the share of all its occurrences,
ordinary words included, that its instances fill, weighted by their scores; an
instance's is that its own weight or one of its patterns is right.  Patterns
with enough distinct trusted instances and a high score mark further spans, of
kind ``context``.

Main path: DataFrame expressions only.  Whole texts are read for spans and
slots, and then to count the occurrences of those patterns that have enough
trusted instances.  What is shuffled is one narrow row per slot.

Defined cases: a null text is empty; a match of a base pattern that fails its
check is dropped and not retried; rows that repeat count each and give equal
spans; spans hang on a row's text alone, so rows that share an id or have none
keep their own; an empty table gives an empty result; other columns are ignored
by ``find_spans`` and kept by ``redact``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_ROWS, materialise, within

KINDS = ("email", "ip", "card", "phone", "context")
WORD = r"[^\x20\x09-\x0D]+"
# The base patterns, with possessive runs: the same matches in linear time.  A
# run of name characters can start at its first or where a match has ended.
_NAME = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: At most 255; the zeros before a number may be all of it.
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]?)"
MIN_SCORE = 0.8
MIN_SUPPORT = 5
ROUNDS = 4
BUCKETS = 1 << 16
#: Patterns below this score have no say about their instances.
MIN_SAY = 0.5
#: What a word that looks like a credential weighs as a seed.
CREDENTIAL = 0.6
_CREDENTIAL = r"^(?=.*[0-9])(?=.*[a-zA-Z])[A-Za-z0-9+/_-]{16,}$"
#: What a word may have before an identifier: a key, or punctuation.
_LEAD = r"^(?:[\p{L}_][\p{L}_-]*+[=:][\"']?(?=[\p{L}0-9+@])|[^\p{L}0-9+@]*+)"
#: Texts in the first count, which only refutes: one of so many.
SHARE = 16

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def positions(text: Column, pattern: str, numbered: bool = False) -> Column:
    """array<struct<start, end, match>> of a pattern's matches, in code points.

    The text between matches and the matches themselves alternate, so running
    lengths are the positions.  With ``numbered``, for patterns that match whole
    words, ``number`` is added: how many words of the text precede the match.
    """
    fields = "start:int,end:int,match:string" + ",number:int" * numbered

    def placed(matches: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        words = lambda g: [F.regexp_count(g, F.lit(WORD)).alias("words")] * numbered
        pieces = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"), m.alias("m"), *words(g)))
        start = F.struct(F.lit(0).alias("at"), *[F.lit(0).alias("words")] * numbered, F.array().cast(f"array<struct<{fields}>>").alias("out"))

        def step(state: Column, piece: Column) -> Column:
            begin = state["at"] + piece["gap"]
            end = begin + F.coalesce(piece["n"], F.lit(0))
            number = [state["words"] + piece["words"]] if numbered else []
            found = F.struct(begin.alias("start"), end.alias("end"), piece["m"].alias("match"), *[n.alias("number") for n in number])
            return F.struct(
                end.alias("at"),
                *[(n + 1).alias("words") for n in number],
                F.when(piece["m"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(found))).alias("out"),
            )

        return F.aggregate(pieces, start, step, lambda s: s["out"])

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _spans_of(text: Column, number: int, kind: str) -> Column:
    good = F.filter(positions(text, PATTERNS[kind]), lambda m: _valid(kind, m["match"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of valid base matches, in order."""
    empty = F.array().cast(_SPANS)
    found = [
        F.when(text.rlike(NEEDS[kind]), _spans_of(text, number, kind)).otherwise(empty).cast(_SPANS) for number, kind in enumerate(KINDS[:4])
    ]
    return F.when(text.rlike("[0-9@]"), F.sort_array(F.concat(*found))).otherwise(empty)


def _normal(text: Column) -> Column:
    """Text as patterns see it: lower case, digits alike."""
    return F.regexp_replace(F.lower(text), "[0-9]", "0")


def _key_led(lead: Column) -> Column:
    return lead.rlike(r"^[\p{L}_]")


def _slots(text: Column, spans: Column) -> Column:
    """Seeds and identifier-like words, each with what stands before it.

    Only what begins its word, a key or punctuation apart, is a slot.  The two
    words come from the words that ``_occurrences`` counts.
    """
    marked = positions(text, r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*+", numbered=True)
    words = F.regexp_extract_all(_normal(text), F.lit(WORD), F.lit(0))
    return _let(marked, lambda m: _let(words, lambda w: _slots_among(text, spans, m, w)))


def _slots_among(text: Column, spans: Column, marked: Column, words: Column) -> Column:
    led = F.transform(marked, lambda w: F.struct(w.alias("w"), F.regexp_extract(w["match"], _LEAD, 0).alias("lead")))
    trimmed = F.transform(
        led,
        lambda x: F.struct(
            (x["w"]["start"] + F.length(x["lead"])).alias("start"),
            (x["w"]["end"] - F.length(F.regexp_extract(x["w"]["match"], r"[^\p{L}0-9]*$", 0))).alias("end"),
            x["w"]["number"].alias("number"),
            _normal(x["lead"]).alias("lead"),
        ),
    )

    def found(slots: Column) -> Column:
        apart = F.filter(
            slots, lambda w: (w["end"] - w["start"] >= 4) & ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))
        )
        seeds = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("seed")))
        others = F.transform(apart, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lit(False).alias("seed")))
        # The word in which a slot begins; null where none does.
        place = F.map_from_arrays(F.transform(slots, lambda w: w["start"]), F.transform(slots, lambda w: F.struct(w["number"], w["lead"])))

        def described(x: Column, places: Column) -> Column:
            n, lead = F.element_at(places, x["start"])["number"], F.element_at(places, x["start"])["lead"]
            before = F.concat_ws(" ", F.get(words, n - 2), F.get(words, n - 1), F.when(lead != "", lead))
            return F.struct(
                x["start"].alias("start"), x["end"].alias("end"), x["seed"].alias("seed"),
                F.when(_key_led(lead), lead).when(n >= 2, before).otherwise("").alias("pattern"),
                F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("instance"),
            )

        def weighed(x: Column) -> Column:
            prior = F.when(x["seed"], 1.0).when(x["instance"].rlike(_CREDENTIAL), CREDENTIAL).otherwise(0.0)
            return F.struct(x["start"], x["end"], x["seed"], x["pattern"], F.lower(x["instance"]).alias("instance"), prior.alias("prior"))

        every = _let(place, lambda k: F.transform(F.concat(seeds, others), lambda x: described(x, k)))
        return F.transform(F.filter(every, lambda x: x["pattern"] != ""), weighed)

    return _let(trimmed, found)


def _patterns_of(words: Column) -> Column:
    """What stands before each word of a text, ordinary words included.

    Two words count before any third; with punctuation, before a word that
    begins with it; a key counts wherever it begins a word.
    """

    def before(word: Column, i: Column) -> Column:
        pair = F.when(i >= 2, F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1)))
        return _let(
            F.regexp_extract(word, _LEAD, 0),
            lambda lead: F.when(lead == "", F.array(pair)).when(_key_led(lead), F.array(pair, lead)).otherwise(F.array(pair, F.concat_ws(" ", pair, lead))),
        )

    return F.filter(F.flatten(F.transform(words, before)), lambda x: x.isNotNull())


def _occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each of the patterns stands before a word.

    What stands before words is hashed to ``BUCKETS`` buckets; only what is in
    a bucket with a wanted pattern leaves its text.  It is counted, and the
    counts written, before the join that drops what shares a bucket by chance:
    a join in the same plan would be pushed below the count.  The driver gets
    the list of wanted buckets, at most ``BUCKETS`` small numbers, and sends
    one byte for each bucket with the plan.
    """
    bucket = lambda p: F.pmod(F.xxhash64(p), F.lit(BUCKETS)).cast("int")
    marks = bytearray(BUCKETS)
    for row in patterns.select(bucket(F.col("pattern")).alias("bucket")).distinct().collect():
        marks[row["bucket"]] = 1
    wanted = lambda p: F.substring(F.lit(marks), bucket(p) + 1, F.lit(1)) == F.lit(bytearray([1]))
    words = F.regexp_extract_all(_normal(F.col("text")), F.lit(WORD), F.lit(0))
    every = texts.select(F.explode(F.filter(_let(words, _patterns_of), wanted)).alias("pattern"))
    counts = materialise(every.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")), "pii-counts")
    return counts.join(patterns.select("pattern"), "pattern", "left_semi")


def _totals(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total) of those patterns (pattern, most) that may score ``MIN_SAY`` or more.

    ``most`` bounds what the pattern's instances can weigh.  Occurrences in
    some texts are no more than those in all, so what one of ``SHARE`` parts of
    the texts refutes is refuted; all others are counted in all texts.
    """
    part = F.pmod(F.xxhash64(F.lit(9), "text"), F.lit(SHARE)) == 0
    some = _occurrences(texts.filter(part), patterns).withColumnRenamed("pattern", "p")
    left = patterns.join(some, F.col("pattern") == F.col("p"), "left").filter(F.coalesce("total", F.lit(0)) * MIN_SAY <= F.col("most"))
    left = materialise(left.select("pattern"), "pii-patterns")
    return materialise(_occurrences(texts, left), "pii-totals")


def pattern_scores(slots: DataFrame, texts: DataFrame, min_support: int = MIN_SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score, support) after ``rounds`` on the graph.

    ``slots`` has pattern, instance and prior.  Edges are counts, so a frequent
    pattern or instance is one row per partner before any shuffle.  Patterns
    without enough trusted instances have no say, so totals are counted for
    the others only, when they first appear.
    """
    edges = slots.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("prior").alias("prior"))
    edges = materialise(edges, "pii-edges")
    known = edges.groupBy("instance").agg(F.max("prior").alias("known"))
    scores, totals, patterns = known.withColumn("value", F.col("known")), None, None
    for turn in range(rounds):
        weighed = edges.join(scores.select("instance", "value"), "instance").groupBy("pattern").agg(
            F.sum(F.col("n") * F.col("value")).alias("filled"), F.sum((F.col("value") >= 0.5).cast("long")).alias("support"), F.sum("n").alias("most")
        )
        weighed = materialise(weighed.filter(F.col("support") >= min_support), "pii-weighed")
        fresh = weighed if patterns is None else weighed.join(patterns, "pattern", "left_anti")
        if not fresh.isEmpty():
            more = _totals(texts, fresh.select("pattern", "most"))
            totals = more if totals is None else totals.unionByName(more)
        if totals is None:
            break
        patterns = weighed.select("pattern")
        scored = weighed.join(totals, "pattern").select("pattern", F.least(F.col("filled") / F.col("total"), F.lit(1.0)).alias("score"), "support")
        scored = materialise(scored.filter(F.col("score") >= MIN_SAY), "pii-scores")
        if turn + 1 < rounds:
            told = scored.select("pattern", F.least("score", F.lit(0.999)).alias("score"))
            doubt = edges.select("pattern", "instance").join(told, "pattern").groupBy("instance").agg(F.sum(F.log1p(-F.col("score"))).alias("doubt"))
            scores = known.join(doubt, "instance", "left").select(
                "instance", "known", (1 - (1 - F.col("known")) * F.exp(F.coalesce("doubt", F.lit(0.0)))).alias("value")
            )
            scores = materialise(scores, "pii-instances")
    if totals is None:
        return weighed.select("pattern", F.lit(0.0).alias("score"), "support").limit(0)
    return scored


_SLOTS = "array<struct<start:int,end:int,seed:boolean,pattern:string,instance:string,prior:double>>"


def find_spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_score: float = MIN_SCORE, min_support: int = MIN_SUPPORT) -> DataFrame:
    """(doc_id, base, spans, text_md5): base spans and all spans of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    slots = F.when(F.col("text").rlike("[0-9@]"), _let(F.col("base"), lambda s: _slots(F.col("text"), s))).otherwise(F.array().cast(_SLOTS))
    read = texts.withColumn("base", base_spans(F.col("text"))).select("doc_id", "base", slots.alias("slots"), F.md5("text").alias("text_md5"))
    found = materialise(read, "pii-slots")
    each = found.select(F.explode("slots").alias("s")).select("s.pattern", "s.instance", "s.prior")
    scored = pattern_scores(each, texts.select("text"), min_support)
    good = materialise(scored.filter((F.col("score") >= min_score) & (F.col("support") >= min_support)).select("pattern"), "pii-good")
    # Rows without a slot of a good pattern, nearly all, only pass through.
    numbered = found.withColumn("row", F.monotonically_increasing_id())
    hits = numbered.select("row", F.explode("slots").alias("s")).filter("not s.seed").select("row", "s.start", "s.end", F.col("s.pattern").alias("pattern"))
    hits = hits.join(good, "pattern", "left_semi").groupBy("row").agg(
        F.collect_list(F.struct("start", F.lit(KINDS.index("context")).alias("kind"), "end")).cast(_SPANS).alias("more")
    )
    joined = numbered.drop("slots").join(hits, "row", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more")))
    return joined.select("doc_id", "base", spans.alias("spans"), "text_md5")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets.

    Where spans overlap, the part that an earlier one covers is not repeated.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        out = F.when(fresh, F.concat(state["out"], gap, F.get(names, s["kind"]))).otherwise(state["out"])
        return F.struct(out.alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step)
    tail = lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, _let(done, tail)).otherwise(text)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with the spans in its texts masked, its columns as they were.

    Base spans are found beside the text; spans from context, which few rows
    have, are joined by the text's checksum.
    """
    tag = uuid.uuid4().hex[:8]
    extra = find_spans(df, text_col, id_col, **options).filter(F.size("spans") > F.size("base"))
    extra = extra.groupBy(F.col("text_md5").alias(f"d{tag}")).agg(F.first("spans").alias(f"m{tag}"))
    extra = materialise(extra, "pii-extra")
    more = F.filter(F.coalesce(F.col(f"m{tag}"), F.array().cast(_SPANS)), lambda s: s["kind"] == KINDS.index("context"))
    joined = df if extra.isEmpty() else df.join(within(extra, BROADCAST_ROWS // 4), F.md5(df[text_col]) == F.col(f"d{tag}"), "left")
    spans = base_spans(F.col(text_col))
    spans = spans if joined is df else F.sort_array(F.concat(spans, more))
    new = F.when(F.col(text_col).rlike("[0-9@]"), _let(spans, lambda s: masked(F.col(text_col), s))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, new).select(*df.columns)
