"""Sense priors, vectors, neighbours and export of a multi-sense model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensespark.functions import mathx
from sensespark.operators.lexicon import with_rank


def expected_pi(senses: DataFrame, alpha: float) -> DataFrame:
    """``senses`` with pi, the posterior mean of the stick-breaking prior.

    m = (1 + n) / (1 + n + alpha + later counts), 1 for the last sense, and
    pi is m times what the senses before left over.  Windows see one word.
    """
    order = Window.partitionBy("word_id").orderBy("sense")
    later = F.coalesce(F.sum("cnt").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    last = F.col("sense") == F.max("sense").over(Window.partitionBy("word_id"))
    m = F.when(last, 1.0).otherwise((1 + F.col("cnt")) / (1 + F.col("cnt") + alpha + later))
    left = F.exp(F.coalesce(F.sum(F.when(~F.col("__last"), F.log1p(-F.col("__m")))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return senses.withColumn("__last", last).withColumn("__m", m).withColumn("pi", F.col("__m") * left).drop("__m", "__last")


def active(senses: DataFrame, alpha: float, min_prob: float = 1e-3) -> DataFrame:
    """Senses with a prior of at least ``min_prob``."""
    return expected_pi(senses, alpha).filter(F.col("pi") >= min_prob)


def uniform_prior(senses: DataFrame, alpha: float, min_prob: float = 1e-3, compat: bool = False) -> DataFrame:
    """Adds log_prior = -ln of the number of active senses; inactive ones go.

    ``compat`` keeps all senses: 1/n, not its logarithm, for the active ones and 0 for the others.
    """
    rows = expected_pi(senses, alpha).withColumn("__on", F.col("pi") >= min_prob)
    n = F.sum(F.col("__on").cast("int")).over(Window.partitionBy("word_id"))
    if compat:
        return rows.withColumn("log_prior", F.when(F.col("__on"), F.try_divide(F.lit(1.0), n)).otherwise(0.0)).drop("__on")
    return rows.withColumn("log_prior", -F.log(n)).filter("__on").drop("__on")


def nearest(queries: DataFrame, pool: DataFrame, k: int = 10, exclude_first: bool = False) -> DataFrame:
    """(hw, sn, sim, nn, nn_sn, rank): nearest senses by cosine.

    Of the k + 1 best the head's own senses are taken out and k kept; with
    ``exclude_first`` they are taken out before.  Queries are a list of
    requests: they are replicated, and the pool stays where it is.
    """
    q = queries.select(F.col("word_id").alias("q_id"), F.col("word").alias("hw"), F.col("sense").alias("sn"), mathx.normalised(F.col("vec")).alias("q"))
    p = pool.select("word_id", F.col("word").alias("nn"), F.col("sense").alias("nn_sn"), mathx.normalised(F.col("vec")).alias("p"))
    pairs = p.crossJoin(q)
    if exclude_first:
        pairs = pairs.filter("q_id <> word_id")
    pairs = pairs.select("q_id", "hw", "sn", "word_id", "nn", "nn_sn", F.round(mathx.dot(F.col("q"), F.col("p")), 9).alias("sim")).filter(F.col("sim").isNotNull())
    order = [F.desc("sim"), F.asc("word_id"), F.asc("nn_sn")]
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("q_id", "sn").orderBy(*order))).filter(F.col("r") <= k + 1)
    others = best.filter("q_id <> word_id").withColumn("rank", F.row_number().over(Window.partitionBy("q_id", "sn").orderBy("r")).cast("long"))
    return others.filter(F.col("rank") <= k).select("hw", "sn", "sim", "nn", "nn_sn", "rank")


def compact(near: DataFrame) -> DataFrame:
    """(hw, sn, nn, minsim, maxsim): a line per sense."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "nn", "nn_sn", "sim")))
    lines = near.groupBy("hw", "sn").agg(ordered.alias("x"))
    names = F.array_join(F.transform("x", lambda y: F.concat(y["nn"], F.lit("##"), y["nn_sn"].cast("string"))), " ")
    return lines.select("hw", "sn", names.alias("nn"), F.coalesce(F.array_min(F.transform("x", lambda y: y["sim"])), F.lit(0.0)).alias("minsim"), F.coalesce(F.array_max(F.transform("x", lambda y: y["sim"])), F.lit(0.0)).alias("maxsim"))


def sense_similarities(senses: DataFrame, min_count: float = 5) -> DataFrame:
    """(word, a, b, sim): cosines between a word's senses."""
    rows = senses.filter(F.col("cnt") >= min_count)
    a = rows.select("word_id", "word", F.col("sense").alias("a"), F.col("vec").alias("va"))
    b = rows.select("word_id", F.col("sense").alias("b"), F.col("vec").alias("vb"))
    return a.join(b, "word_id").filter("a <> b").select("word", "a", "b", mathx.cosine(F.col("va"), F.col("vb")).alias("sim"))


def hierarchy(similarities: DataFrame) -> DataFrame:
    """(word, step, left, right, sim, least): merges by single linkage.

    ``sim`` is the largest similarity across the two sides, ``least`` the
    smallest of all pairs in the node that they make.  A word has at most as many senses as the model allows, so a group is small.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sim = {(a, b): s for a, b, s in zip(rows["a"], rows["b"], rows["sim"], strict=True)}
        nodes, out = [(i,) for i in sorted(set(rows["a"]))], []
        while len(nodes) > 1:
            pairs = [(i, j, [sim[x, y] for x in nodes[i] for y in nodes[j]]) for i in range(len(nodes)) for j in range(i)]
            i, j, found = max(pairs, key=lambda p: (max(p[2]), -p[0], -p[1]))
            both = nodes[i] + nodes[j]
            least = min(sim[x, y] for x in both for y in both if x != y)
            out.append((rows["word"].iloc[0], len(out), " ".join(map(str, nodes[i])), " ".join(map(str, nodes[j])), max(found), least))
            nodes = [n for k, n in enumerate(nodes) if k not in (i, j)] + [both]
        return pd.DataFrame(out, columns=["word", "step", "left", "right", "sim", "least"])

    return similarities.groupBy("word").applyInPandas(run, "word string, step int, left string, right string, sim double, least double")


def render_hierarchy(merges: list[tuple[str, str, float]], leaves: dict[str, str]) -> str:
    """The merges (left, right, least) of one word as a tree, each level four blanks further in; ``leaves`` have what follows a sense."""
    trees = {sense: [f"#{sense} {text}"] for sense, text in leaves.items()}
    for left, right, least in merges:
        below = trees.pop(left) + trees.pop(right)
        trees[f"{left} {right}"] = [f"{least:.3f}d", *("    " + line for line in below)]
    return "\n".join(line for tree in trees.values() for line in tree)


def trees(senses: DataFrame, near: DataFrame, min_count: float = 5) -> DataFrame:
    """(word, tree): the senses' hierarchy in print, each sense with its neighbours of ``near``.

    A word with one sense has a tree of that leaf, one without any has no row.
    """
    lines = near.groupBy("hw", "sn").agg(F.sort_array(F.collect_list(F.struct("rank", "nn", "nn_sn", "sim"))).alias("x"))
    text = F.array_join(F.transform("x", lambda y: F.format_string(" %s##%d/%.3f", y["nn"], y["nn_sn"], y["sim"])), "")
    kept = senses.filter(F.col("cnt") >= min_count).select("word", "sense")
    leaves = kept.join(lines.select(F.col("hw").alias("word"), F.col("sn").alias("sense"), text.alias("text")), ["word", "sense"], "left")
    merges = hierarchy(sense_similarities(senses, min_count))

    def run(mine: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
        steps = steps.sort_values("step")
        texts = {str(k): t or "" for k, t in sorted(zip(mine["sense"], mine["text"], strict=True))}
        drawn = render_hierarchy(list(zip(steps["left"], steps["right"], steps["least"], strict=True)), texts)
        return pd.DataFrame({"word": [mine["word"].iloc[0]], "tree": [drawn]})

    return leaves.groupBy("word").cogroup(merges.groupBy("word")).applyInPandas(run, "word string, tree string")


def export(senses: DataFrame, alpha: float, min_prob: float = 1e-3) -> DataFrame:
    """(row, key, prob, frq, vec): senses by whole count, largest first; ties in reverse order."""
    rows = expected_pi(senses, alpha).filter(F.col("pi") >= min_prob).withColumn("frq", F.floor("cnt").cast("long"))
    ranked = with_rank(rows, "frq", [F.desc("word_id"), F.desc("sense")], "row")
    return ranked.select("row", F.concat("word", F.lit("##"), F.col("sense").cast("string")).alias("key"), F.col("pi").alias("prob"), "frq", "vec")
