"""The training's inner loop, in Java.

Spark brings the Janino compiler along, so nothing has to be built or
installed: the driver compiles ``Rounds.java`` once per application, and
executors fetch the classes as a jar.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = Path(__file__).with_name("Rounds.java")
COLUMNS = "part string, id long, at int, weight double, value binary"
#: The class loader of each application's classes.
_LOADERS: dict = {}


def _loader(spark: SparkSession):
    """The loader of the classes, which the driver knows and the executors are sent."""
    sc = spark.sparkContext
    if sc.applicationId not in _LOADERS:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(SOURCE.read_text())
        # Executors fetch the jar from where it lies, whenever they start.
        folder = tempfile.mkdtemp(prefix="sensespark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        jar = f"{folder}/{os.path.basename(folder)}.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in compiler.getBytecodes().items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(jar)
        _LOADERS[sc.applicationId] = compiler.getClassLoader()
    return _LOADERS[sc.applicationId]


def _new(spark: SparkSession, name: str):
    """An object of a class, which py4j doesn't find by its name."""
    sc = spark.sparkContext
    of = lambda kind: sc._gateway.new_array(kind, 0)
    return _loader(spark).loadClass(f"sensespark.{name}").getConstructor(of(sc._jvm.Class)).newInstance(of(sc._jvm.Object))


def _mapped(rows: DataFrame, task, columns: str) -> DataFrame:
    jvm = rows.sparkSession.sparkContext._jvm
    encoder = jvm.org.apache.spark.sql.Encoders.row(jvm.org.apache.spark.sql.types.StructType.fromDDL(columns))
    return DataFrame(rows._jdf.mapPartitions(task, encoder), rows.sparkSession)


def word_ids(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, words) with the ids of the lexicon's words instead of the words; others go, and documents without any."""
    spark = docs.sparkSession
    task = _new(spark, "Rounds$Ids")
    shared = spark.sparkContext._jsc.broadcast(task.table(lexicon.select("word", "word_id")._jdf.collectAsList()))
    return _mapped(docs.select(F.col("doc_id").cast("long"), "words"), getattr(task, "with")(shared), "doc_id long, words array<int>")


def share(spark: SparkSession, inner: np.ndarray, outer: np.ndarray, counts: np.ndarray, freqs: np.ndarray, starts: np.ndarray, steps: np.ndarray):
    """The parameters as a broadcast of Java arrays; they pass through a file, since py4j would make text of them."""
    folder = tempfile.mkdtemp(prefix="sensespark-")
    try:
        with open(f"{folder}/parameters", "wb") as f:
            for part, kind in ((inner, "<f4"), (outer, "<f4"), (counts, "<f8"), (freqs, "<f8"), (starts, "<i4"), (steps, "<i4")):
                f.write(np.ascontiguousarray(part, kind).data)
        return spark.sparkContext._jsc.broadcast(_new(spark, "Rounds").load(f"{folder}/parameters", *inner.shape, len(steps)))
    finally:
        shutil.rmtree(folder)


def changed(docs: DataFrame, shared, options, done: int, total: int) -> DataFrame:
    """``COLUMNS`` that each partition of ``docs`` (doc_id, words as ids) returns after its steps; ``shared`` is from ``share``."""
    o = options
    task = getattr(_new(docs.sparkSession, "Rounds"), "with")(shared, o.senses, o.dim, o.window, o.partitions, float(o.alpha), float(o.rate), float(o.skip), done, total)
    return _mapped(docs, task, COLUMNS)


def means(rows: DataFrame, senses: int) -> DataFrame:
    """(part, id, value): the weighted means of ``changed``'s rows over the partitions, always summed in the same order."""
    dealt = rows.repartition("part", "id").sortWithinPartitions("part", "id", "at")
    return _mapped(dealt, getattr(_new(rows.sparkSession, "Rounds$Means"), "with")(senses), "part string, id long, value binary")
