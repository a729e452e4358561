"""Quality rules with risk-controlled thresholds.

Statistics of each text feed rules of the form "statistic above a cutoff"; a
document goes if any rule rejects it.  The cutoffs of a stratum (language) are
learned as one, so that the guarantee holds for the verdict and not rule by
rule.  A quarter of the labelled good documents proposes: for each rule the
strictest cutoff of its grid that rejects next to none of them, and from there
ten joint settings, each with all rules one step looser.  The other three
quarters, the holdout, dispose: an exact binomial (Clopper-Pearson) bound says
whether a joint setting's rate of rejected good documents is surely at most
``max_rejected``.  Settings are tested in a fixed sequence from the loosest,
which needs no correction, up to the first that fails; over the strata the
error is divided (Bonferroni).  So with ``confidence`` no stratum loses more
than ``max_rejected`` of the good documents that pass the base rule.  A stratum
in which no setting passes has no learned cutoffs: at 0.02 and 0.95 and four
strata it takes 217 good documents in the holdout.

Main path: DataFrame expressions only.  Each text is one row; its windows are
hashed, sorted and compared within the row, so nothing is exploded.

Defined cases: a null text has no words and fails the base rule; a null
stratum is a stratum of its own; documents with several labels count once for
each; labels of null are ignored; rows that repeat are judged alike, rows that
share an id each on its own; an empty table gives an empty result, and no labels
give no learned cutoffs; other columns are ignored by ``judge`` and kept by
``keep_good``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import BROADCAST_ROWS, materialise, within

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Learned rules: statistic, and the cutoffs that are tried, strictest first.
RULES = {
    "symbols_per_word": [x / 100 for x in (2, 5, 10, 15, 20, 30, 40, 50, 75, 100)],
    "duplicate_lines": [x / 100 for x in (2, 5, 10, 15, 20, 25, 30, 40, 50, 60)],
    "repeated_words": [x / 100 for x in (1, 2, 5, 10, 15, 20, 25, 30, 35, 40)],
    "upper_share": [x / 100 for x in (5, 10, 15, 20, 25, 30, 40, 50, 60, 80)],
    "marks_per_word": [x / 100 for x in (30, 35, 40, 50, 60, 75, 100, 125, 150, 200)],
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more in the text.

    Windows are sorted by hash; equal neighbours are compared word by word, so
    that a collision of hashes can't count.  Their positions, sorted, cover
    min(3, gap to the next) words each.
    """

    def covered(w: Column) -> Column:
        count = F.size(w) - 2
        windows = F.transform(F.slice(w, 1, F.greatest(count, F.lit(0))), lambda _, i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return _let(F.sort_array(windows), lambda s: _covered_by(w, s))

    def _covered_by(w: Column, s: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            words_equal = F.lit(True)
            for k in range(3):
                words_equal = words_equal & (F.get(w, a["i"] + k) == F.get(w, b["i"] + k))
            return F.coalesce(a["h"] == b["h"], F.lit(False)) & words_equal

        repeated = F.filter(s, lambda x, i: F.when(x["h"] == F.get(s, i - 1)["h"], same(x, F.get(s, i - 1))).otherwise(False) | F.when(x["h"] == F.get(s, i + 1)["h"], same(x, F.get(s, i + 1))).otherwise(False))
        at = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        return _let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b))

    return F.when(F.size(words) >= 4, _let(words, covered)).otherwise(F.lit(0).cast("long"))


def text_statistics(text: Column) -> dict[str, Column]:
    """The base statistics of a text, each as a long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("__words")),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        "n_marks": F.regexp_count(text, F.lit(r"\p{Punct}")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", with_row: bool = False) -> DataFrame:
    """(doc_id, stratum, base statistics [, __row]) of each row.

    ``with_row`` adds the whole row as one struct, whose names can't clash.
    """
    text = F.col("__text")
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    whole = [F.struct(*df.columns).alias("__row")] * with_row
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("__text"), *whole)
    found = {k: v.alias(k) for k, v in text_statistics(text).items()}
    return rows.withColumn("__words", words).select("doc_id", "stratum", *found.values(), *["__row"] * with_row)


def rule_values() -> dict[str, Column]:
    """The statistic of each learned rule, from the base statistics."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "duplicate_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "marks_per_word": share("n_marks", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def surely_below(rejected: Column, good: Column, limit: float, doubt: Column) -> Column:
    """Whether the exact binomial upper bound of rejected / good is <= limit.

    That is P(X <= rejected) <= doubt for X ~ Binomial(good, limit).  The
    terms of the distribution are added in logarithms, from 0 upward.
    """
    import math

    odds = math.log(limit / (1 - limit))

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.ln((good - i + 1).cast("double") / i) + F.lit(odds)
        high, low = F.greatest(state["sum"], term), F.least(state["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    first = good * F.lit(math.log1p(-limit))
    start = F.struct(first.alias("term"), first.alias("sum"))
    terms = F.when(rejected > 0, F.sequence(F.lit(1).cast("long"), rejected)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(terms, start, step, lambda s: s["sum"])
    # Beyond the mean the distribution function is above one half or so.
    return (good > 0) & F.when(rejected >= good * F.lit(limit), F.lit(False)).otherwise(total <= F.ln(doubt))


def learn_cutoffs(stats: DataFrame, labels: DataFrame, max_rejected: float = 0.02, confidence: float = 0.95, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff): the strictest safe cutoffs; see the module.

    One row per stratum is aggregated, twice; partial counts are made before
    the shuffle, so a stratum with most rows is no hot key.
    """
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("label_id"))
    labelled = stats.filter(~base_failed()).join(good, F.col("doc_id") == F.col("label_id"))
    proposing = F.pmod(F.xxhash64(F.lit(21), "doc_id"), F.lit(4)) == 0
    values, steps = rule_values(), max(len(cuts) for cuts in RULES.values())
    grids = {rule: F.array(*[F.lit(float(c)) for c in cuts]) for rule, cuts in RULES.items()}
    # How many cutoffs of its grid, the strictest first, each value exceeds.
    exceeded = [sum(((values[rule] > c).cast("int") for c in cuts), F.lit(0)).alias(f"m_{rule}") for rule, cuts in RULES.items()]
    rows = materialise(labelled.select("stratum", proposing.alias("proposing"), *exceeded), "quality-labelled")
    over = [F.array(*[F.sum((F.col(f"m_{rule}") > i).cast("long")) for i in range(len(cuts))]).alias(f"r_{rule}") for rule, cuts in RULES.items()]
    tried = rows.filter("proposing").groupBy("stratum").agg(F.count(F.lit(1)).alias("seen"), *over)
    few = F.col("seen") * F.lit(max_rejected / 10)
    # The place of the strictest cutoff that rejects few enough; the grid's length if none does.
    first = [F.size(F.filter(f"r_{rule}", lambda n: n > few)).alias(f"b_{rule}") for rule in RULES]
    proposed = tried.select(F.col("stratum").alias("own"), *first)
    # One row per stratum is broadcast.
    joined = rows.filter("not proposing").join(within(proposed, BROADCAST_ROWS), F.col("stratum").eqNullSafe(F.col("own")))
    depth = F.greatest(*[F.col(f"m_{rule}") - 1 - F.col(f"b_{rule}") for rule in RULES])
    places = [F.max(f"b_{rule}").alias(f"b_{rule}") for rule in RULES]
    counts = joined.groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *[F.sum((depth >= j).cast("long")).alias(f"d{j}") for j in range(steps)], *places)
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))
    counts = counts.join(F.broadcast(strata))
    doubt = F.lit(1 - confidence) / F.col("strata")
    # Looser settings reject no more, so the first failure ends what passes.
    safe = [F.when(surely_below(F.col(f"d{j}"), F.col("good"), max_rejected, doubt), F.lit(j)) for j in range(steps)]
    chosen = counts.withColumn("looser", F.least(*safe)).filter("looser is not null")
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.get(grids[rule], F.col(f"b_{rule}") + F.col("looser")).alias("cutoff")) for rule in RULES])
    return chosen.select("stratum", F.explode(pairs).alias("t")).select("stratum", "t.rule", "t.cutoff").filter("cutoff is not null")


def judge(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``stats`` with base_failed and kept."""
    wide = cutoffs.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"cut_{rule}") for rule in RULES])
    wide = wide.withColumnRenamed("stratum", "cut_stratum")
    joined = stats.join(wide, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
    rejected = F.lit(False)
    for rule, value in rule_values().items():
        rejected = rejected | F.coalesce(value > F.col(f"cut_{rule}"), F.lit(False))
    failed = base_failed()
    return joined.select(*stats.columns, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def judge_documents(documents: DataFrame, labels: DataFrame, stratum_col: str = "lang", **options) -> DataFrame:
    """Statistics and verdict of every document; texts are read once."""
    stats = materialise(statistics(documents, stratum_col=stratum_col), "quality-statistics")
    return judge(stats, materialise(learn_cutoffs(stats, labels, **options), "quality-cutoffs"))


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """The rows of ``documents`` that are kept, with their columns.

    Rows are written once beside their statistics, of which the cutoffs read
    the narrow columns only; then each row is judged where it lies.  Texts are
    never shuffled, and rows that share an id are judged each on their own.
    """
    stats = materialise(statistics(documents, id_col, text_col, stratum_col, with_row=True), "quality-statistics")
    cutoffs = materialise(learn_cutoffs(stats.drop("__row"), labels, **options), "quality-cutoffs")
    return judge(stats, cutoffs).filter("kept").select("__row.*")
