"""Word lists: counts, pruning, ranks, subsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensespark.sources.store import materialise


def frequencies(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def with_rank(rows: DataFrame, value: str, ties: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 by descending ``value``, ties by ``ties``.

    Rows are dealt by ranges of the whole order, so that a frequent value, such
    as that of the words seen once, spreads over partitions.  They are written
    with their partition's number, since ranges come from a sample; only the
    partitions' sizes are summed as a whole.
    """
    order = [F.desc(value), *ties]
    dealt = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    firsts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    ranked = dealt.withColumn("__within", within).join(F.broadcast(firsts), "__part")
    return ranked.withColumn(name, (F.col("__first") + F.col("__within")).cast("long")).drop("__part", "__first", "__within")


def ranked_lexicon(tokens: DataFrame, min_freq: int = 1, drop_top: int = 0) -> DataFrame:
    """(word_id, word, freq): frequent words, the ``drop_top`` most frequent left out, ids by rank."""
    return ranked(frequencies(tokens).filter(F.col("freq") >= min_freq), drop_top)


def ranked(counted: DataFrame, drop_top: int = 0) -> DataFrame:
    """``ranked_lexicon`` of words that were counted (word, freq)."""
    rows = with_rank(counted, "freq", [F.col("word").asc()], "word_id").filter(F.col("word_id") >= drop_top)
    return rows.select((F.col("word_id") - drop_top).alias("word_id"), "word", "freq")


def drop_probability(freq: Column, total: Column, t: float) -> Column:
    """Subsampling: the chance that an occurrence of a word is left out."""
    return F.greatest(1 - F.sqrt(F.lit(t) * total / freq), F.lit(0.0))


def with_drop_probability(lexicon: DataFrame, t: float) -> DataFrame:
    total = lexicon.agg(F.sum("freq").alias("total"))
    # One row.
    return lexicon.join(F.broadcast(total)).withColumn("p_drop", drop_probability(F.col("freq"), F.col("total"), t))


def subsample(tokens: DataFrame, lexicon: DataFrame, t: float, seed: int = 666, at: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Tokens that stay; the draw hangs on ``at``, the columns of a position, so a rerun repeats it."""
    rated = with_drop_probability(lexicon, t).select("word", "p_drop")
    draw = F.pmod(F.xxhash64(F.lit(seed), *at), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return tokens.join(rated, "word").filter(draw >= F.col("p_drop")).drop("p_drop")


def sample_positions(occurrences: DataFrame, n: int, keys: list[str], seed: int = 666) -> DataFrame:
    """At most n rows of each key, those with the smallest hash of position and key."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "pos", *keys), "pos")
    return occurrences.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).drop("__r")
