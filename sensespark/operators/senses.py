"""The tools: row disambiguation, sense frequencies, concordance, sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensespark.operators import context as ctx
from sensespark.operators import model as models
from sensespark.sources.store import materialise


def log_priors(senses: DataFrame, alpha: float, min_prob: float = 1e-3) -> DataFrame:
    """(head_id, sense, log_prior) of active senses."""
    return models.active(senses, alpha, min_prob).select(F.col("word_id").alias("head_id"), "sense", F.log("pi").alias("log_prior"))


def row_contexts(rows: DataFrame, lexicon: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Status and context words of rows (row_id, head_id, context).

    The context's anchor is the occurrence of the head nearest to its middle,
    the earlier of two, else the middle itself, which then belongs to the
    right.  Known words count towards the window; the head doesn't.  A window
    of 0 takes the whole context.
    """
    head = lexicon.select(F.col("word_id").alias("head_id"), F.col("word").alias("hw"))
    known_rows = rows.join(head, "head_id", "left")
    words = F.filter(F.split(F.trim("context"), r"\s+"), lambda x: x != "")
    split = known_rows.filter("hw is not null").select("row_id", "head_id", "hw", words.alias("toks"))
    middle = F.floor(F.size("toks") / 2).cast("int")
    at = F.filter(F.transform("toks", lambda x, i: F.when(x == F.col("hw"), F.struct(F.abs(i - F.col("mid")).alias("d"), i.alias("i")))), lambda x: x.isNotNull())
    placed = split.withColumn("mid", middle).withColumn("anchor", F.array_min(at)["i"])
    words_at = placed.select("row_id", "head_id", "hw", "mid", "anchor", F.posexplode("toks").alias("i", "word")).filter("word <> hw")
    seen = words_at.join(lexicon.select("word", F.col("word_id").alias("ctx_id")), "word", "left")
    centre = F.coalesce("anchor", "mid")
    right = F.when(F.col("anchor").isNull(), F.col("i") >= centre).otherwise(F.col("i") > centre)
    sided = seen.withColumn("right", right).withColumn("dist", F.abs(F.col("i") - centre))
    order = Window.partitionBy("row_id", "right").orderBy("dist")
    before = F.coalesce(F.sum(F.col("ctx_id").isNotNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = sided.withColumn("before", before).filter(F.col("before") < window) if window else sided
    counts = used.groupBy("row_id").agg(F.count("ctx_id").alias("valid"), F.count(F.lit(1)).alias("seen"))
    suffix = F.lit("full") if not window else F.when(F.col("anchor").isNotNull(), "hw").otherwise("mw")
    marks = placed.select("row_id", suffix.alias("suffix"))
    base = F.when(F.coalesce("seen", F.lit(0)) == 0, "noctx").when(F.col("valid") == 0, "unctx").otherwise("allok")
    found = rows.select("row_id", "head_id").join(marks, "row_id", "left").join(counts, "row_id", "left")
    status = F.when(F.col("suffix").isNull(), "nhead").otherwise(F.concat_ws("_", base, "suffix"))
    contexts = placed.select("row_id", "head_id").join(used.filter("ctx_id is not null").select("row_id", "ctx_id"), "row_id", "left")
    return found.select("row_id", "head_id", status.alias("status")), contexts


def disambiguated(rows: DataFrame, status: DataFrame, post: DataFrame, senses: int) -> DataFrame:
    """``rows`` with all their columns, plus status, cluster, p, cluster_probs and nsenses.

    ``post`` has row_id, sense, p of active senses.  cluster_probs lists all
    ``senses`` as ``k:p`` with two digits, inactive ones as 0.00; nsenses counts
    the active ones.  Rows without a known head have a status and nulls.
    """
    best = ctx.best_sense(post, ["row_id"]).select("row_id", F.concat(F.lit("c"), F.col("sense").cast("string")).alias("cluster"), "p")
    shares = [F.round(F.coalesce(F.max(F.when(F.col("sense") == k, F.col("p"))), F.lit(0.0)), 9) for k in range(senses)]
    listed = F.concat_ws(" ", *[F.format_string(f"{k}:%.2f", share) for k, share in enumerate(shares)])
    each = post.groupBy("row_id").agg(listed.alias("cluster_probs"), F.count(F.lit(1)).alias("nsenses"))
    found = status.select("row_id", "status").join(best, "row_id", "left").join(each, "row_id", "left")
    return rows.join(found, "row_id", "left")


def occurrence_posteriors(occ: DataFrame, tokens: DataFrame | None, model, window: int, fast: bool = False) -> DataFrame:
    """(head_id, at, sense, p) of each occurrence (head_id, hw, pos); without ``tokens`` of ``surrounded`` ones."""
    # Read for the pairs to score and for the occurrences themselves.
    found = materialise(ctx.inference_window(occ, tokens, model.lexicon, window).select("head_id", "at", "ctx_id"), "windows")
    scores = ctx.pair_scores(found.select("head_id", "ctx_id").distinct(), model.senses, model.nodes, model.paths, fast)
    # Each occurrence once without a context word, for those that have none.
    every = found.unionByName(occ.select("head_id", F.col("pos").alias("at"), F.lit(None).cast("long").alias("ctx_id")))
    return ctx.posteriors(every, scores, log_priors(model.senses, model.alpha), ["at"])


def sense_frequencies(post: DataFrame, occ: DataFrame, epoch_table: DataFrame, attribute: str, senses: int, soft: bool = False) -> DataFrame:
    """(head_id, epoch_no, s0.., norm): senses by epoch, all epochs.

    Hard counts take each occurrence's likeliest sense, soft ones sum p.
    """
    where = occ.select("head_id", F.col("pos").alias("at"), F.col(attribute).alias("value")).join(epoch_table.select("value", "epoch_no"), "value")
    rows = post if soft else ctx.best_sense(post, ["at"]).withColumn("p", F.lit(1.0))
    placed = where.join(rows, ["head_id", "at"])
    sums = [F.coalesce(F.sum(F.when(F.col("sense") == k, F.col("p"))), F.lit(0.0)).alias(f"s{k}") for k in range(senses)]
    counted = placed.groupBy("head_id", "epoch_no").agg(*sums)
    every = occ.select("head_id").distinct().crossJoin(epoch_table.select("epoch_no", "norm"))
    filled = [F.coalesce(f"s{k}", F.lit(0.0)).alias(f"s{k}") for k in range(senses)]
    return every.join(counted, ["head_id", "epoch_no"], "left").select("head_id", "epoch_no", *filled, "norm")


def concordance(post: DataFrame, occ: DataFrame, tokens: DataFrame | None, low: float, high: float, rows: int, n: int) -> DataFrame:
    """(hw, sn, prob, pos, lctx, kw, rctx): best lines of each sense within a band of probability.

    Of lines alike in sense and probability the first stays.
    """
    best = ctx.best_sense(post, ["at"]).withColumn("p", F.round("p", 6))
    single = best.groupBy("head_id", "sense", "p").agg(F.min("at").alias("at")).filter(F.col("p").between(low, high))
    order = Window.partitionBy("head_id", "sense").orderBy(F.desc("p"), "at")
    kept = single.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= rows)
    chosen = materialise(occ.join(kept.select("head_id", F.col("at").alias("pos"), F.col("sense").alias("sn"), F.col("p").alias("prob")), ["head_id", "pos"]), "chosen")
    lines = ctx.kwic(chosen, tokens, n)
    return chosen.select("hw", "pos", "sn", "prob").join(lines, ["hw", "pos"]).select("hw", "sn", "prob", "pos", "lctx", "kw", "rctx")


def sketch_statistics(sketches: DataFrame, post: DataFrame, senses: int, min_prob: float = 0.6, min_count: int = 5) -> DataFrame:
    """(head_id, coll, cnt, rnk, cluster, mean, sd, dist) of each collocate.

    ``sketches`` has head_id, coll, cnt, rnk, pos.  The cluster is the sense
    with the greatest mean, ``-`` if that or the count is too small.
    """
    grid = sketches.select("head_id", "coll", "cnt", "rnk", F.col("pos").alias("at")).join(post, ["head_id", "at"])
    n = grid.groupBy("head_id", "coll").agg(F.countDistinct("at").alias("n"))
    per = grid.groupBy("head_id", "coll", "cnt", "rnk", "sense").agg(F.avg("p").alias("mean"), F.coalesce(F.stddev_samp("p"), F.lit(0.0)).alias("sd"))
    all_ = F.sort_array(F.collect_list(F.struct("sense", "mean", "sd")))
    best = F.max(F.struct(F.round("mean", 9).alias("m"), "sense", "mean", "sd")).alias("best")
    rows = per.groupBy("head_id", "coll", "cnt", "rnk").agg(best, all_.alias("all")).join(n, ["head_id", "coll"])
    weak = (F.col("best.mean") < min_prob) | (F.col("n") < min_count)
    dist = F.array_join(F.transform("all", lambda x: F.format_string("%d:%.2f/%.2f", x["sense"], x["mean"], x["sd"])), " ")
    cluster = F.when(weak, "-").otherwise(F.col("best.sense").cast("string"))
    return rows.select("head_id", "coll", "cnt", "rnk", cluster.alias("cluster"), F.col("best.mean").alias("mean"), F.col("best.sd").alias("sd"), "n", dist.alias("dist"))


def label(words: Column) -> Column:
    """The words of a longest match without its last one, parted by blanks; empty for fewer than two."""
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")).otherwise("")


def sketch_evaluation(sketches: DataFrame, post: DataFrame) -> DataFrame:
    """(mean, sd, head_id, coll, cnt, rnk, label): how sure the likeliest sense of each collocate is.

    ``sketches`` has lcm, an array of words alike for a collocate, besides the
    columns of ``sketch_statistics``.  No sense is masked; a collocate without
    scored positions has -1 and -1.
    """
    names = sketches.groupBy("head_id", "coll", "cnt", "rnk").agg(F.max("lcm").alias("lcm"))
    stats = sketch_statistics(sketches, post, 0, 0.0, 0).select("head_id", "coll", "mean", "sd")
    rows = names.join(stats, ["head_id", "coll"], "left")
    sure = [F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("mean", "sd")]
    return rows.select(*sure, "head_id", "coll", "cnt", "rnk", label(F.col("lcm")).alias("label"))
