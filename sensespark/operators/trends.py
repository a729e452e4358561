"""Epochs in natural order, relative frequencies and their trends."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensespark.functions import mathx

#: Epoch names that stand for no epoch.
BAD = ["===NONE===", "===NONE==", "===NONE=", "===NONE", "===NON", "===NO", "===N", "9999", ""]


def epochs(tokens: DataFrame, attribute: str, limit: float = 0.15) -> DataFrame:
    """(value, epoch_no, norm): epochs with enough tokens, in natural order.

    A limit of 1 or more is a number of tokens, below it a share of the mean.
    """
    return numbered(tokens.groupBy(F.col(attribute).alias("value")).agg(F.count(F.lit(1)).cast("double").alias("norm")), limit)


def numbered(norms: DataFrame, limit: float = 0.15) -> DataFrame:
    """``epochs`` of values whose tokens were counted (value, norm)."""
    good = norms.filter(F.col("value").isNotNull() & ~F.col("value").isin(BAD))
    least = F.lit(float(limit)) if limit >= 1 else F.floor(F.avg("norm").over(Window.partitionBy()) * limit)
    order = Window.orderBy(mathx.natural_key(F.col("value")), "value")
    kept = good.withColumn("least", least).filter("norm >= least")
    return kept.select("value", (F.row_number().over(order) - 1).cast("long").alias("epoch_no"), "norm")


def word_epoch_counts(tokens: DataFrame, words: DataFrame, epoch_table: DataFrame, attribute: str) -> DataFrame:
    """(word, epoch_no, norm, n) for every word and epoch, zeros too."""
    counted = tokens.join(words.select("word"), "word").groupBy("word", F.col(attribute).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    every = words.select("word").crossJoin(epoch_table)
    return every.join(counted, ["word", "value"], "left").select("word", "epoch_no", "norm", F.coalesce("n", F.lit(0)).alias("n"))


def relative(counts: DataFrame) -> DataFrame:
    """Adds normed = n / norm and rel = epochs * normed / sum; words without hits go."""
    by_word = Window.partitionBy("word")
    normed = F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("norm")), F.lit(0.0))
    rows = counts.withColumn("normed", normed).withColumn("epochs", F.count(F.lit(1)).over(by_word))
    rel = F.col("epochs") * F.col("normed") / F.col("total")
    return rows.withColumn("total", F.sum("normed").over(by_word)).filter("total > 0").withColumn("rel", rel).drop("total")


def linear(series: DataFrame) -> DataFrame:
    """(word, epochs, slope): least squares of rel on the epoch's number."""
    return series.groupBy("word").agg(F.max("epochs").alias("epochs"), F.regr_slope("rel", "epoch_no").alias("slope"))


def _pairs(series: DataFrame) -> DataFrame:
    """Pairs of epochs of a word; a word has as many rows as there are epochs."""
    a = series.select("word", F.col("epoch_no").alias("i"), F.col("normed").alias("ni"), F.col("rel").alias("ri"))
    b = series.select("word", F.col("epoch_no").alias("j"), F.col("normed").alias("nj"), F.col("rel").alias("rj"), "epochs")
    return a.join(b, "word").filter("i < j")


def mann_kendall(series: DataFrame) -> DataFrame:
    """(word, s): concordant less discordant pairs of epochs (Mann 1945)."""
    return _pairs(series).groupBy("word").agg(F.sum(F.signum(F.col("nj") - F.col("ni"))).cast("long").alias("s"))


def theil_sen(series: DataFrame) -> DataFrame:
    """(word, epochs, slope): the median slope of pairs of epochs (Sen 1968)."""
    slope = (F.col("rj") - F.col("ri")) / (F.col("j") - F.col("i"))
    return _pairs(series).groupBy("word").agg(F.max("epochs").alias("epochs"), F.percentile(slope, F.lit(0.5)).alias("slope"))


def graphs(series: DataFrame) -> DataFrame:
    """(word, graph): each word's series as eight nibbles."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("epoch_no", "rel"))), lambda x: x["rel"])
    return series.groupBy("word").agg(ordered.alias("series")).select("word", mathx.minigraph(F.col("series")).alias("graph"))


def significance(series: DataFrame) -> DataFrame:
    """(word, p_linear, p_mk): p-values of both trends, a word's series at a time.

    The linear one tests the slope by Student's t; Mann-Kendall's has the
    variance corrected for ties and a continuity correction.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("epoch_no")
        x, y, n = rows["epoch_no"].to_numpy(float), rows["rel"].to_numpy(float), len(rows)
        sxx, syy = ((x - x.mean()) ** 2).sum(), ((y - y.mean()) ** 2).sum()
        sxy = ((x - x.mean()) * (y - y.mean())).sum()
        rest = syy - sxy**2 / sxx if sxx else 0.0
        p = mathx.student_p(sxy / sxx / math.sqrt(rest / (n - 2) / sxx), n - 2) if n > 2 and rest > 1e-18 else float("nan")
        v = rows["normed"].to_numpy()
        s = sum(int(v[j] > v[i]) - int(v[j] < v[i]) for j in range(n) for i in range(j))
        ties = rows["normed"].value_counts().to_numpy()
        var = (n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18
        z = (s - (s > 0) + (s < 0)) / math.sqrt(var) if var > 0 else 0.0
        return pd.DataFrame({"word": [rows["word"].iloc[0]], "p_linear": [p], "p_mk": [mathx.normal_p(z)]})

    return series.select("word", "epoch_no", "rel", "normed").groupBy("word").applyInPandas(run, "word string, p_linear double, p_mk double")
