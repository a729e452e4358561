"""Contexts of occurrences and scores of senses in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensespark.functions import mathx
from sensespark.sources import corpus
from sensespark.sources.store import few, materialise, small


#: Positions whose tokens are kept or left together before a band join.
STRETCH = 64


def occurrences(tokens: DataFrame, heads: DataFrame) -> DataFrame:
    """(head_id, hw, pos, doc_id, lang, source) of each occurrence of a head."""
    return tokens.join(heads.withColumnRenamed("hw", "word"), "word").select("head_id", F.col("word").alias("hw"), "pos", "doc_id", "lang", "source")


def band(occ: DataFrame, tokens: DataFrame, left: int, right: int, by_doc: bool = False) -> DataFrame:
    """Tokens from ``left`` before to ``right`` after each occurrence, with delta.

    A band join as an equi-join: an occurrence is listed under each position.
    ``occ`` is read twice, so it is best a written table.  Sizes of exploded
    rows are estimated as if they were not, so the joins are told not to
    broadcast them.
    """
    offsets = F.expr(f"filter(sequence({-left}, {right}), d -> d <> 0)")
    spread = occ.select("head_id", "hw", F.col("pos").alias("at"), F.col("doc_id").alias("at_doc"), F.explode(offsets).alias("delta"))
    spread = spread.withColumn("pos", F.col("at") + F.col("delta"))
    # Tokens of stretches without an occurrence leave before the shuffle.
    touched = spread.select(F.floor(F.col("pos") / STRETCH).alias("stretch")).distinct()
    near = tokens.select("pos", "word", "doc_id", F.floor(F.col("pos") / STRETCH).alias("stretch")).join(touched.hint("merge"), "stretch", "left_semi").drop("stretch")
    found = spread.hint("merge").join(near, "pos")
    return found.filter("doc_id = at_doc") if by_doc else found


def surrounded(docs: DataFrame, begins: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """``occurrences`` with left and right, up to ``n`` tokens on either side, and starts, the positions among them at which a document begins.

    ``docs`` has words; ``begins`` are their ``structures`` with an edge of
    ``n``.  Tokens of the same document are cut from its words as they are
    read, so that only occurrences are shuffled.  Contexts go on across
    document borders: what is missing there is among the documents' edges.
    """
    if not few(heads):
        toks = corpus.placed_tokens(docs.join(begins.select("doc_id", "beg"), "doc_id"))
        return _gathered(materialise(occurrences(toks, heads), "occurrences"), toks, n, begins.select(F.col("beg").alias("pos")))
    listed = F.broadcast(heads.select("head_id", F.col("hw").alias("word")))
    hits = docs.select("doc_id", "lang", "source", "words", F.posexplode("words").alias("i", "word")).join(listed, "word")
    left = F.slice("words", F.greatest(F.col("i") - n + 1, F.lit(1)), F.least(F.col("i"), F.lit(n)))
    cut = hits.select("head_id", F.col("word").alias("hw"), "i", "doc_id", "lang", "source", left.alias("left"), F.slice("words", F.col("i") + 2, F.lit(n)).alias("right"))
    pos = F.col("beg") + F.col("i")
    starts = F.when(F.col("i") <= n, F.array("beg")).otherwise(F.array().cast("array<bigint>"))
    rows = cut.join(begins.select("doc_id", "beg"), "doc_id").select("head_id", "hw", pos.alias("pos"), "doc_id", "lang", "source", "left", "right", starts.alias("starts"))
    rows = materialise(rows.withColumn("open", (F.size("left") < n) | (F.size("right") < n)), "cut-occurrences")
    lacking = F.expr(f"filter(sequence(pos - {n}, pos + {n}), x -> x < pos - size(left) or x > pos + size(right))")
    wanted = rows.filter("open").select(F.col("pos").alias("at"), "left", "right", "pos").distinct().select("at", F.explode(lacking).alias("pos"))
    # Both sides are exploded, which estimates of size leave out: never a broadcast.
    near = wanted.hint("merge").join(corpus.edge_tokens(begins), "pos")
    more = near.groupBy("at").agg(*_sides(F.col("pos") < F.col("at"), F.col("pos") > F.col("at"), "pos"), F.collect_list(F.when(F.col("starts"), F.col("pos"))).alias("__starts"))
    wide = rows.filter("open").join(more.withColumnRenamed("at", "pos"), "pos", "left")
    both = lambda a, b: F.concat(*[F.coalesce(F.col(c), F.array()) for c in (a, b)])
    wide = wide.select("head_id", "hw", "pos", "doc_id", "lang", "source", both("__left", "left").alias("left"), both("right", "__right").alias("right"), both("starts", "__starts").alias("starts"))
    return rows.filter("not open").drop("open").unionByName(materialise(wide, "border-occurrences"))


def _sides(before: Column, after: Column, order: str) -> list[Column]:
    """Aggregates __left and __right: a group's words on either side, by ``order``."""
    listed = [F.sort_array(F.collect_list(F.when(side, F.struct(order, "word")))) for side in (before, after)]
    return [F.transform(x, lambda y: y["word"]).alias(name) for x, name in zip(listed, ("__left", "__right"), strict=True)]


def _gathered(occ: DataFrame, tokens: DataFrame, n: int, glue: DataFrame | None) -> DataFrame:
    """What ``surrounded`` gives, from tokens with positions; starts are those of ``glue`` (pos)."""
    around = band(occ, tokens, n, n).groupBy("hw", F.col("at").alias("pos")).agg(*_sides(F.col("delta") < 0, F.col("delta") > 0, "delta"))
    # A corpus of one token has an occurrence without neighbours.
    found = occ.join(around, ["hw", "pos"], "left")
    blank = F.array().cast("array<string>")
    found = found.withColumn("left", F.coalesce("__left", blank)).withColumn("right", F.coalesce("__right", blank)).drop("__left", "__right")
    if glue is None:
        return found.withColumn("starts", F.array().cast("array<bigint>"))
    spread = occ.select(F.col("pos").alias("at")).distinct().select("at", F.explode(F.sequence(F.col("at") - n, F.col("at") + n)).alias("pos"))
    marks = spread.hint("merge").join(glue.select("pos").distinct(), "pos").groupBy(F.col("at").alias("pos")).agg(F.collect_list("pos").alias("starts"))
    return found.join(marks, "pos", "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<bigint>")))


def inference_window(occ: DataFrame, tokens: DataFrame | None, lexicon: DataFrame, window: int) -> DataFrame:
    """(head_id, hw, at, delta, ctx_id): the first ``window`` known words on each side.

    They are looked for among twice as many tokens, across document borders.
    Without ``tokens`` they are those of ``surrounded`` occurrences.
    """
    listed = lexicon.select("word", F.col("word_id").alias("ctx_id"))
    near = _spread(occ, 2 * window) if tokens is None else band(occ, tokens, 2 * window, 2 * window)
    known = near.join(small(listed), "word")
    side = Window.partitionBy("head_id", "at", F.col("delta") > 0).orderBy(F.abs("delta"))
    return known.withColumn("r", F.row_number().over(side)).filter(F.col("r") <= window).select("head_id", "hw", "at", "delta", "ctx_id")


def _spread(occ: DataFrame, n: int) -> DataFrame:
    """(head_id, hw, at, delta, word): up to ``n`` tokens on either side of ``surrounded`` occurrences."""
    left = F.transform("left", lambda w, i: F.struct((i - F.size("left")).alias("delta"), w.alias("word")))
    right = F.transform("right", lambda w, i: F.struct((i + 1).alias("delta"), w.alias("word")))
    rows = occ.select("head_id", "hw", F.col("pos").alias("at"), F.explode(F.concat(left, right)).alias("x"))
    return rows.select("head_id", "hw", "at", "x.delta", "x.word").filter(F.abs("delta") <= n)


def _ahead(tokens: DataFrame, lexicon: DataFrame, window: int) -> DataFrame:
    """(doc_id, i, word_id, x): known words of each document, numbered; x has (d, ctx_id) of the ``window`` next ones."""
    known = tokens.join(small(lexicon.select("word", "word_id")), "word").select("doc_id", "tok_ix", "word_id")
    order = Window.partitionBy("doc_id").orderBy("tok_ix")
    later = F.array(*[F.struct(F.lit(d).alias("d"), F.lead("word_id", d).over(order).alias("ctx_id")) for d in range(1, window + 1)])
    return known.select("doc_id", (F.row_number().over(order) - 1).alias("i"), "word_id", later.alias("x"))


def training_window(tokens: DataFrame, lexicon: DataFrame, window: int) -> DataFrame:
    """(doc_id, i, word_id, ctx_id, delta): known words only, ``window`` before and one less after, within documents."""
    pairs = _ahead(tokens, lexicon, window).select("doc_id", "i", "word_id", F.explode("x").alias("x")).filter("x.ctx_id is not null")
    # A pair is seen from both of its words.
    after = F.struct("i", "word_id", F.col("x.ctx_id").alias("ctx_id"), F.col("x.d").alias("delta"))
    before = F.struct((F.col("i") + F.col("x.d")).alias("i"), F.col("x.ctx_id").alias("word_id"), F.col("word_id").alias("ctx_id"), (-F.col("x.d")).alias("delta"))
    return pairs.select("doc_id", F.explode(F.array(after, before)).alias("y")).filter(F.col("y.delta") < window).select("doc_id", "y.*")


def training_counts(tokens: DataFrame, lexicon: DataFrame, window: int) -> DataFrame:
    """(word_id, ctx_id, delta, n): the pairs of ``training_window`` counted, each from one side and all distances in a row."""
    pairs = _ahead(tokens, lexicon, window).select("word_id", F.explode("x").alias("x")).filter("x.ctx_id is not null")
    sums = [F.sum(F.when(F.col("x.d") == d, F.lit(1)).otherwise(0)).alias(f"n{d}") for d in range(1, window + 1)]
    counted = pairs.groupBy(F.col("word_id").alias("a"), F.col("x.ctx_id").alias("b")).agg(*sums)
    side = lambda word, ctx, delta, n: F.struct(F.col(word).alias("word_id"), F.col(ctx).alias("ctx_id"), F.lit(delta).alias("delta"), F.col(n).alias("n"))
    both = [side("a", "b", d, f"n{d}") for d in range(1, window)] + [side("b", "a", -d, f"n{d}") for d in range(1, window + 1)]
    return counted.select(F.explode(F.array(*both)).alias("y")).select("y.*").filter("n > 0")


def kwic(occ: DataFrame, tokens: DataFrame | None, n: int, glue: DataFrame | None = None, glued: bool = False) -> DataFrame:
    """(hw, pos, lctx, kw, rctx): n tokens on either side of each occurrence.

    Tokens are parted by blanks.  With ``glue`` (pos: where a glue begins) no
    blank stands before such a token, and the blanks beside the keyword are
    written too, at the end of lctx and the start of rctx, so that the three
    parts together are the text.  Without ``tokens`` the lines are those of
    ``surrounded`` occurrences; with ``glued`` documents are the glue.
    """
    if tokens is not None:
        occ, glued = _gathered(occ, tokens, n, glue), glue is not None
    left = F.slice("left", F.greatest(F.size("left") - n + 1, F.lit(1)), F.lit(n))
    lines = occ.select("hw", "pos", left.alias("left"), F.slice("right", 1, n).alias("right"), "starts")
    lctx, rctx = F.array_join("left", " "), F.array_join("right", " ")
    if glued:
        gap = lambda at: F.when(F.array_contains("starts", at), "").otherwise(" ")
        text = lambda c, beg, least: F.array_join(F.transform(c, lambda w, i: F.concat(F.when(i < least, "").otherwise(gap(beg + i)), w)), "")
        # The line's first token has nothing before it.
        lctx = F.when(F.size("left") > 0, F.concat(text("left", F.col("pos") - F.size("left"), 1), gap(F.col("pos")))).otherwise("")
        rctx = text("right", F.col("pos") + 1, 0)
    return lines.select("hw", "pos", lctx.alias("lctx"), rctx.alias("rctx"), F.col("hw").alias("kw"))


def pair_scores(pairs: DataFrame, senses: DataFrame, nodes: DataFrame, paths: DataFrame, fast: bool = False) -> DataFrame:
    """(head_id, ctx_id, sense, score) of distinct pairs (head_id, ctx_id).

    A score is the log probability of a context word given a sense: the sum
    over its path in the tree.  It hangs on nothing but the pair, so each inner
    product is taken once per sense and node.
    """
    logistic = mathx.fast_log_sigmoid if fast else mathx.log_sigmoid
    # Paths may be exploded too.
    steps = materialise(pairs.join(paths.withColumnRenamed("word_id", "ctx_id").hint("merge"), "ctx_id").select("head_id", "ctx_id", "node_id", "code"), "path-steps")
    # Only nodes on the way to a context word of the head.
    wanted = steps.select("head_id", "node_id").distinct().join(nodes.select("node_id", F.col("vec").alias("out")), "node_id")
    dots = wanted.join(senses.select(F.col("word_id").alias("head_id"), "sense", "vec"), "head_id")
    steps = steps.join(dots.select("head_id", "sense", "node_id", mathx.dot(F.col("vec"), F.col("out")).alias("dot")), ["head_id", "node_id"])
    term = logistic((1 - 2 * F.col("code")) * F.col("dot"))
    return steps.groupBy("head_id", "ctx_id", "sense").agg(F.sum(term).alias("score"))


def posteriors(contexts: DataFrame, scores: DataFrame, priors: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, sense, p): priors plus the scores of the context, normalised.

    ``contexts`` has keys, head_id and ctx_id, null where there is no context;
    ``priors`` has head_id, sense, log_prior of active senses only.  Contexts
    are summed where they are if the scores of active senses are few.
    """
    priors = materialise(priors.select("head_id", "sense", "log_prior"), "priors")
    scores = materialise(scores.join(priors.select("head_id", "sense"), ["head_id", "sense"], "left_semi"), "scores")
    spread = contexts.select(*keys, "head_id", "ctx_id").join(small(priors), "head_id").join(small(scores), ["head_id", "ctx_id", "sense"], "left")
    logs = spread.groupBy(*keys, "head_id", "sense").agg((F.max("log_prior") + F.coalesce(F.sum("score"), F.lit(0.0))).alias("z"))
    whole = Window.partitionBy(*keys)
    weight = logs.withColumn("w", F.exp(F.col("z") - F.max("z").over(whole)))
    return weight.withColumn("p", F.col("w") / F.sum("w").over(whole)).select(*keys, "head_id", "sense", "p")


def best_sense(post: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, sense, p) of the likeliest sense, the last of equals."""
    best = F.max(F.struct(F.round("p", 9).alias("p"), "sense"))
    return post.groupBy(*keys, "head_id").agg(best.alias("x")).select(*keys, "head_id", "x.sense", "x.p")
