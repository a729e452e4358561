"""Distributions of words and attributes over text types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attribute_counts(tokens: DataFrame, *attributes: str) -> DataFrame:
    """Joint counts of attribute values."""
    return tokens.groupBy(*attributes).agg(F.count(F.lit(1)).alias("n"))


def type_norms(tokens: DataFrame, attribute: str) -> DataFrame:
    """(tt, norm): tokens of each text type."""
    return tokens.groupBy(F.col(attribute).alias("tt")).agg(F.count(F.lit(1)).alias("norm"))


def hits_by_type(tokens: DataFrame, heads: DataFrame, attribute: str) -> DataFrame:
    """(hw, tt, norm, total): hits of each head in every text type, zeros too.

    Heads are a list of requests, types a list of attribute values.
    """
    hits = tokens.join(heads.select(F.col("hw").alias("word")), "word").groupBy(F.col("word").alias("hw"), F.col(attribute).alias("tt")).agg(F.count(F.lit(1)).alias("total"))
    every = heads.select("hw").crossJoin(type_norms(tokens, attribute))
    return every.join(hits, ["hw", "tt"], "left").select("hw", "tt", "norm", F.coalesce("total", F.lit(0)).alias("total"))


def hit_marginals(tokens: DataFrame, heads: DataFrame, kind: str, epoch: str) -> DataFrame:
    """(hw, kind, epoch, total): both marginals in one pass, by grouping sets."""
    hits = tokens.join(heads.select(F.col("hw").alias("word")), "word").select(F.col("word").alias("hw"), F.col(kind).alias("tt"), F.col(epoch).alias("epoch"))
    return hits.groupingSets([[F.col("hw"), F.col("tt")], [F.col("hw"), F.col("epoch")]], "hw", "tt", "epoch").agg(F.count(F.lit(1)).alias("total"))


def without(rows: DataFrame, skip: str) -> DataFrame:
    """Rows whose attribute is none of ``attribute:value,value``; null stays."""
    attribute, _, values = skip.partition(":")
    if not attribute or not values:
        raise ValueError(f"a skip rule reads attribute:value,value and not {skip!r}")
    return rows.filter(~F.coalesce(F.col(attribute).isin(*values.split(",")), F.lit(False)))
