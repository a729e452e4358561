"""Mixing sources to target weights by repetition rates.

Words are summed per source, the sources' targets follow from weights and a
cap, and each document is emitted floor(rate) times plus once more if its
hash-seeded Bernoulli draw, with the rate's fraction as its probability, says
so.  The draw depends on the document's id and the seed only, so that a rerun,
another partitioning or a lost executor gives the same mix.

Defined cases: a null text has size 0; a null source is a source of its own,
after all others; a source of size 0 has target 0 and rate 0; rows with equal
ids draw alike; an empty table gives an empty mix; other columns pass through
``mix`` unchanged, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Words are runs of other characters than these: space, and 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that is fixed by key and seed."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources by code point, null last, weigh ``weights`` in turn.  They share
    ``share`` times all words by weight; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight until none is
    above.  That fixed point is min(cap * size, level * weight) with one level
    for all, found by sorting the sources by the level at which they fill up.

    The windows run over one row per source, after the aggregation, never over
    documents.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(cap))
    full_at = Window.orderBy(F.col("full_level"), F.col("source").asc_nulls_last())
    before = full_at.rowsBetween(Window.unboundedPreceding, -1)
    onward = full_at.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        per_source.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("full_level", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    )
    level = F.max(F.when(F.col("level") <= F.col("full_level"), F.col("level"))).over(everything)
    reached = filled.withColumn("common", level)
    target = F.least(F.col("limit"), F.coalesce(F.col("common") * F.col("weight"), F.col("limit")))
    return reached.select("source", "source_size", target.alias("target"))


def mix_plan(df: DataFrame, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **weights) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of each document.

    The texts are read once; only the narrow rows are written, aggregated and
    joined with the sources.  No hint forces the sources to be broadcast: a
    short list is, a long one joins by a shuffle whose hot keys Spark splits.
    """
    sizes = materialise(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes"
    )
    targets = source_targets(sizes.select("source", "size"), **weights).withColumnRenamed("source", "target_source")
    joined = sizes.join(targets, sizes["source"].eqNullSafe(targets["target_source"]))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    extra = uniform_draw(F.col("doc_id"), seed) < (F.col("rate") - F.floor("rate"))
    return joined.withColumn("rate", rate).select(
        "doc_id", "source", "size", "source_size", "target", (F.floor("rate") + extra.cast("long")).cast("long").alias("copies")
    )


def mix(df: DataFrame, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **weights) -> DataFrame:
    """The mix itself: each row of ``df`` as many times as the plan says."""
    tag = uuid.uuid4().hex[:8]
    sizes = df.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    targets = source_targets(sizes, **weights).select(
        F.col("source").alias(f"s{tag}"), F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)).alias(f"r{tag}")
    )
    rate = F.col(f"r{tag}")
    copies = F.floor(rate) + (uniform_draw(F.col(id_col), seed) < rate - F.floor(rate)).cast("long")
    joined = df.join(materialise(targets, "mix-rates"), df[source_col].eqNullSafe(F.col(f"s{tag}")))
    repeated = joined.filter(copies > 0).withColumn(f"c{tag}", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return repeated.select(*df.columns)
