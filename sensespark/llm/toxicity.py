"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes.

Features are hashed n-grams of code points, present or absent.  Each is scaled
by the log ratio of its smoothed frequencies in toxic and other training texts,
and a logistic regression with L2 penalty is fitted on the scaled features.

The fit uses a bounded sample of the labelled rows: the ``max_per_class`` rows
of each class with the smallest hash of their id, few enough to broadcast.
Class counts per bucket come from aggregation; the ``FEATURES`` buckets whose
presence tells the classes apart best take part in the fit.  The one task that
fits gets their numbers, never a text: at most ``FEATURES`` numbers for each of
2 * ``max_per_class`` rows, however long the texts are.  Scoring reads every
whole text in batches.

Defined cases: a null or empty text has no n-grams and scores by the intercept
alone; labels of null count as none; rows that repeat score alike; if the
training rows lack one class, every score is the smoothed share of label 1;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
MAX_PER_CLASS = 4000
#: Buckets that take part in the fit.
FEATURES = 4096


def held_out(key: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, mod 5 is 0."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def gram_ids(text: str | None, sizes: tuple = SIZES, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of the n-grams of the lower-cased text.

    n-grams are of code points, and white space of any length is one space, as
    it is before and after the text.
    """
    plain = " ".join((text or "").lower().split())
    if not plain:
        return np.zeros(0, np.int64)
    data = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    found, rolling = [], data * np.uint32(0x9E3779B1)
    for n in range(2, max(sizes) + 1):
        if len(data) < n:
            break
        rolling = (rolling[:-1] ^ (rolling[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + data[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in sizes:
            found.append((rolling ^ (rolling >> np.uint32(13))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - (buckets.bit_length() - 1)))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _once(ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """``ids`` without repetitions; ``seen`` is scratch space, one per bucket."""
    order = np.arange(len(ids), dtype=seen.dtype)
    seen[ids] = order
    return ids[seen[ids] == order]


def chosen_features(toxic: np.ndarray, other: np.ndarray, n1: float, n0: float, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that tell the classes apart best, by the likelihood-ratio statistic, and their log-count ratios."""
    kept = np.sort(np.argsort(-_evidence(toxic, other, n1, n0), kind="stable")[:features])
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((other + 1) / (n0 + 2))
    return kept, ratio[kept]


def fit(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, penalty: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """(weight of each feature, intercept) of the logistic regression.

    A row lists the features that a text has, and each has the value ``scale``.
    """
    labels = np.asarray(labels, np.float64)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    if not n1 or not n0:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return np.zeros(len(scale)), float(np.log(share / (1 - share)))
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    weight, bias = np.zeros(len(scale)), 0.0
    value, sample = scale[flat], np.where(labels > 0, 0.5 / n1, 0.5 / n0)
    moment, second = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(owner, value * weight[flat], len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * sample
        slope = np.append(np.bincount(flat, value * error[owner], len(scale)) + penalty * weight, error.sum())
        moment, second = 0.9 * moment + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        change = 0.02 * (moment / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weight, bias = weight - change[:-1], bias - change[-1]
    return weight * scale, float(bias)


def _evidence(toxic: np.ndarray, other: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Likelihood-ratio statistic of presence against class, per bucket."""
    with np.errstate(divide="ignore", invalid="ignore"):
        both = (toxic + other) / (n1 + n0)
        cells = ((toxic, n1 * both), (other, n0 * both), (n1 - toxic, n1 * (1 - both)), (n0 - other, n0 * (1 - both)))
        return sum(np.where(x > 0, x * np.log(x / e), 0) for x, e in cells)


def score(text: str | None, model: tuple, seen: np.ndarray, sizes: tuple = SIZES) -> float:
    """Probability of label 1 for one text."""
    weight, bias = model
    z = bias + weight[_once(gram_ids(text, sizes, len(weight)), seen)].sum()
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(documents: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", features: int = FEATURES):
    """(weight of each bucket, intercept) from labelled rows that aren't held out.

    At most 2 * ``max_per_class`` ids are taken, so they may be broadcast.
    """
    usable = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out(F.col("label_id"))
    )
    hashed = usable.withColumn("draw", F.xxhash64(F.lit(11), "label_id"))
    sample = hashed.filter("label = 0").orderBy("draw", "label_id").limit(max_per_class)
    sample = sample.unionByName(hashed.filter("label = 1").orderBy("draw", "label_id").limit(max_per_class))
    sample = materialise(sample.select("label_id", "label"), "toxicity-sample")
    texts = documents.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "label_id")
    texts = materialise(texts.select("label_id", "label", "text"), "toxicity-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums = np.zeros(BUCKETS, np.int32), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums[label][_once(gram_ids(text), seen)] += 1
        at = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[1][at]), pa.array(sums[0][at])], ["bucket", "toxic", "other"])

    sums = texts.mapInArrow(count, "bucket int, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    # At most one row per bucket.
    counted = sums.toPandas()
    toxic, other = np.zeros(BUCKETS), np.zeros(BUCKETS)
    toxic[counted["bucket"]], other[counted["bucket"]] = counted["toxic"], counted["other"]
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept, scale = chosen_features(toxic, other, sizes.get(1, 0), sizes.get(0, 0), features)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    shared = documents.sparkSession.sparkContext.broadcast(place)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, places = np.zeros(BUCKETS, np.int32), shared.value
        for batch in batches:
            found = [places[_once(gram_ids(t), seen)] for t in batch.column(2).to_pylist()]
            found = pa.array([np.sort(x[x >= 0]) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["label_id", "label", "features"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(key=rows["features"].map(lambda x: x.tobytes())).sort_values(["label_id", "label", "key"], kind="stable")
        weight, bias = fit([np.asarray(x, np.int64) for x in rows["features"]], rows["label"].to_numpy(), scale)
        return pd.DataFrame({"place": np.arange(-1, len(weight), dtype=np.int32), "weight": np.append(bias, weight)})

    reduced = texts.mapInArrow(reduce, "label_id long, label int, features array<int>")
    fitted = reduced.groupBy().applyInPandas(learn, "place int, weight double").toPandas().sort_values("place")
    weight = np.zeros(BUCKETS)
    weight[kept] = fitted["weight"].to_numpy()[1:] if len(fitted) else 0.0
    return weight, float(fitted["weight"].iloc[0]) if len(fitted) else 0.0


_SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score_documents(documents: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        seen = np.zeros(BUCKETS, np.int32)
        for batch in batches:
            found = np.array([score(t, fitted, seen) for t in batch.column(2).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    key = F.col(id_col).cast("long")
    return documents.select(key.alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, _SCORED)
