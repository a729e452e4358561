"""Text tables as a positional corpus: documents, tokens, structures, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensespark.sources.store import materialise

#: Documents whose lengths are summed together before positions are numbered.
BLOCK = 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Lower-cased words of a text, split at white space."""
    return F.split(F.lower(F.trim(text)), r"\s+")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, words): the texts, split."""
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", words_of(F.col("text")).alias("words"))


def plain_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, tok_ix, word) without global positions: one pass, no shuffle."""
    return docs.select("doc_id", "lang", "source", F.posexplode("words").alias("tok_ix", "word"))


def structures(docs: DataFrame, block: int = BLOCK, edge: int = 0) -> DataFrame:
    """(doc_id, lang, source, beg, end): documents as intervals of positions; with ``edge`` also first and last, so many words of either end.

    A document begins after all with a smaller id.  Lengths are written, since
    they are read twice and texts need not be.  They are summed per
    block of ids first, so the window without partitions has one row per block
    and the others see one block each.
    """
    ends = [F.slice("words", 1, edge).alias("first"), F.reverse(F.slice(F.reverse("words"), 1, edge)).alias("last")] if edge else []
    rows = docs.select("doc_id", "lang", "source", F.size("words").cast("long").alias("len"), F.floor(F.col("doc_id") / block).alias("block"), *ends)
    rows = materialise(rows, "lengths")
    totals = rows.groupBy("block").agg(F.sum("len").alias("block_len"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("block", F.coalesce(F.sum("block_len").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    beg = F.col("start") + F.coalesce(F.sum("len").over(inside), F.lit(0))
    return rows.join(starts, "block").withColumn("beg", beg).select("doc_id", "lang", "source", "beg", (F.col("beg") + F.col("len")).alias("end"), *(["first", "last"] if edge else []))


def edge_tokens(begins: DataFrame) -> DataFrame:
    """(pos, word, starts) of the words in first and last of ``structures``, each position once; starts: a document begins there."""
    first = begins.select("beg", F.posexplode("first").alias("i", "word")).select((F.col("beg") + F.col("i")).alias("pos"), "word", (F.col("i") == 0).alias("starts"))
    rest = begins.select((F.col("end") - F.size("last")).alias("from"), (F.col("beg") + F.size("first")).alias("least"), F.posexplode("last").alias("i", "word"))
    last = rest.filter(F.col("from") + F.col("i") >= F.col("least")).select((F.col("from") + F.col("i")).alias("pos"), "word", F.lit(False).alias("starts"))
    return first.unionByName(last)


def placed(docs: DataFrame, edge: int = 0) -> tuple[DataFrame, DataFrame]:
    """(docs with beg, structures): where each document begins, written once.

    ``beg`` joins whole documents; they are exploded behind that join, so no
    token is shuffled for its position.
    """
    begins = materialise(structures(docs, edge=edge), "structures")
    return docs.join(begins.select("doc_id", "beg"), "doc_id"), begins


def tokens(docs: DataFrame) -> DataFrame:
    """(pos, doc_id, lang, source, tok_ix, word) with global positions."""
    return placed_tokens(placed(docs)[0])


def placed_tokens(docs: DataFrame) -> DataFrame:
    """``tokens`` of documents that have ``beg``."""
    rows = docs.select("doc_id", "lang", "source", "beg", F.posexplode("words").alias("tok_ix", "word"))
    return rows.select((F.col("beg") + F.col("tok_ix")).alias("pos"), "doc_id", "lang", "source", "tok_ix", "word")


def scan(docs: DataFrame, beg: int, end: int) -> DataFrame:
    """``tokens`` with beg <= pos < end of documents that have ``beg``; documents outside are not exploded."""
    touched = docs.filter((F.col("beg") < end) & (F.col("beg") + F.size("words") > beg))
    return placed_tokens(touched).filter((F.col("pos") >= beg) & (F.col("pos") < end))


def within_ranges(positions: DataFrame, ranges: DataFrame, block: int = 8192, semi: bool = False) -> DataFrame:
    """Rows of ``positions`` whose pos is in a range [beg, end), with the range's columns.

    A range join as an equi-join: ranges are listed under each block of
    positions that they touch.  With ``semi`` a row stays once, however many
    ranges have it, and gets no column.
    """
    touched = ranges.filter("beg < end").withColumn("block", F.explode(F.sequence(F.floor(F.col("beg") / block), F.floor((F.col("end") - 1) / block))))
    keyed = positions.withColumn("block", F.floor(F.col("pos") / block))
    if semi:
        touched = touched.select(F.col("block").alias("__block"), "beg", "end")
        inside = (F.col("block") == F.col("__block")) & (F.col("pos") >= F.col("beg")) & (F.col("pos") < F.col("end"))
        return keyed.join(touched, inside, "left_semi").drop("block")
    return keyed.join(touched, "block").filter((F.col("pos") >= F.col("beg")) & (F.col("pos") < F.col("end"))).drop("block")
