"""Files: the binary model format, vector export, trend and minigraph files.

Spark's own persistence of a model is its tables as Parquet; these formats
exchange data with other tools.  They hold a whole model, whose size its
vocabulary bounds, and are written by the driver.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Headers of the two sinks.
TRENDS, MINIGRAPHS = b"manatee trends v1.1", b"manatee minigraphs v1.1"
HEADER = 32
END_OF_CODE = 255


def write_model(path: str, words: list[str], freqs: np.ndarray, paths: list[list[tuple[int, int]]], counts: np.ndarray, inner: np.ndarray, outer: np.ndarray, alpha: float, pi: np.ndarray, min_prob: float = 1e-3, extra: str = "") -> None:
    """Write a model; senses below ``min_prob`` are left out.  The file appears whole or not at all."""
    size, senses, dim = inner.shape
    length = max([1, *(len(p) for p in paths)])
    codes = np.full((size, length), END_OF_CODE, np.uint8)
    nodes = np.zeros((size, length), "<u4")
    for w, steps in enumerate(paths):
        for d, (node, code) in enumerate(steps):
            codes[w, d], nodes[w, d] = code, node
    with open(f"{path}.tmp", "wb") as out:
        out.write(f"{size} {dim} {senses}\n{alpha} 0\n{length}\n".encode())
        for array, kind in ((freqs, "<u8"), (codes, "u1"), (nodes, "<u4"), (counts, "<f4"), (outer, "<f4")):
            out.write(np.ascontiguousarray(array).astype(kind).tobytes())
        for w, word in enumerate(words):
            stored = np.flatnonzero(pi[w] >= min_prob)
            out.write(f"{word}\n{len(stored)}\n".encode())
            for k in stored:
                out.write(f"{k + 1}\n".encode() + inner[w, k].astype("<f4").tobytes() + b"\n")
        out.write(f"extrainfo:{extra}\n".encode())
    os.replace(f"{path}.tmp", path)


def read_model(path: str, malformed: bool = False) -> dict:
    """The arrays of a model file; senses that it lacks have no entry in ``inner``.

    With ``malformed`` the number of senses that a word states is not believed,
    since some writers stated another than they stored: what follows decides
    (``_sense_follows``), and a word of any number of senses is read whole.
    """
    with open(path, "rb") as data:
        size, dim, senses = map(int, data.readline().split())
        alpha = float(data.readline().split()[0])
        length = int(data.readline())

        def array(kind: str, *shape: int) -> np.ndarray:
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            return np.frombuffer(data.read(n), kind).reshape(shape)

        freqs, codes, nodes = array("<u8", size), array("u1", size, length), array("<u4", size, length)
        counts, outer, words, inner = array("<f4", size, senses), array("<f4", size, dim), [], {}
        for w in range(size):
            words.append(data.readline().rstrip(b"\n").decode())
            stated, stored, k = int(data.readline()), 0, -1
            while _sense_follows(data, k, senses, dim) if malformed else stored < stated:
                k = int(data.readline()) - 1
                if not 0 <= k < senses:
                    raise ValueError(f"sense {k + 1} of {words[-1]!r} is out of range")
                inner[w, k] = np.frombuffer(data.read(4 * dim), "<f4")
                data.read(1)
                stored += 1
        extra = data.readline().decode().strip().removeprefix("extrainfo:")
    paths = [[(int(n), int(c)) for n, c in zip(nodes[w], codes[w], strict=True) if c != END_OF_CODE] for w in range(size)]
    return {"words": words, "freqs": freqs, "paths": paths, "counts": counts, "outer": outer, "inner": inner, "alpha": alpha, "dim": dim, "senses": senses, "extra": extra}


def _sense_follows(data: BinaryIO, last: int, senses: int, dim: int) -> bool:
    """Whether a sense after number ``last`` comes next, and no word; the position stays.

    A sense is a number in range and above the last, a vector, and a line end.
    A word may be a number too: then two short numbers follow, its count and
    its first sense, where a vector would stand.
    """
    at = data.tell()
    number, body = data.readline().strip(), data.read(4 * dim + 1)
    data.seek(at)
    if not number.isdigit() or not last < int(number) - 1 < senses:
        return False
    return body[4 * dim :] == b"\n" and not re.match(rb"[1-9][0-9]?\n[1-9][0-9]?\n", body)


def model_tables(spark: SparkSession, model: dict) -> dict[str, DataFrame]:
    """The tables lexicon, senses, nodes and hs_path of a model that was read."""
    words, counts = model["words"], model["counts"]
    flat = [(w, d, n, c) for w, steps in enumerate(model["paths"]) for d, (n, c) in enumerate(steps)]
    senses = [(w, words[w], k, float(counts[w, k]), v.astype(float).tolist()) for (w, k), v in model["inner"].items()]
    return {
        "lexicon": spark.createDataFrame([(i, w, int(f)) for i, (w, f) in enumerate(zip(words, model["freqs"], strict=True))], "word_id long, word string, freq long"),
        "senses": spark.createDataFrame(senses, "word_id long, word string, sense int, cnt double, vec array<double>"),
        "nodes": spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(model["outer"])], "node_id long, vec array<double>"),
        "hs_path": spark.createDataFrame(flat, "word_id long, depth int, node_id long, code int"),
    }


def write_vectors(rows: DataFrame, folder: str, padded: int | None = None, normalise: bool = True) -> None:
    """``vectors.bvec32``, ``.dic`` and ``.cnt`` of an export (row, key, prob, frq, vec).

    Rows stream to the driver in order, a partition at a time.
    """
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/vectors.bvec32", "wb") as vectors, open(f"{folder}/vectors.cnt", "w") as counts, open(f"{folder}/vectors.keys", "w") as keys:
        n = width = 0
        for r in rows.orderBy("row").toLocalIterator():
            v = np.array(r["vec"], "<f4")
            width = padded or -(-len(v) // 8) * 8
            v = v / np.linalg.norm(v) if normalise else v
            vectors.write(np.pad(v, (0, width - len(v))).astype("<f4").tobytes())
            counts.write(f"{r['key']}\t{r['prob']}\t{r['frq']}\n")
            keys.write(r["key"] + "\n")
            n += 1
    with open(f"{folder}/vectors.dic", "w") as out, open(f"{folder}/vectors.keys") as keys:
        out.write(f"{n} {width}\n")
        out.writelines(keys)
    os.remove(f"{folder}/vectors.keys")


def _sink(path: str, header: bytes, records: Iterable[bytes]) -> None:
    with open(path, "wb") as out:
        out.write(header.ljust(HEADER, b"\0"))
        out.writelines(records)


def write_trends(rows: DataFrame, path: str) -> None:
    """Rows (word_id, angle, p) as u32, i8, f32."""
    _sink(path, TRENDS, (struct.pack("<Ibf", r[0], r[1], r[2]) for r in rows.orderBy("word_id").toLocalIterator()))


def write_minigraphs(rows: DataFrame, path: str) -> None:
    """Rows (word_id, graph) as u32, u32."""
    _sink(path, MINIGRAPHS, (struct.pack("<II", r[0], r[1]) for r in rows.orderBy("word_id").toLocalIterator()))


def read_lines(spark: SparkSession, path: str, columns: list[str], header: bool = False) -> DataFrame:
    """Tab-separated rows with the named columns, nothing quoted; a header is left out whatever it names."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", header).option("enforceSchema", True).csv(path)


def write_lines(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("quote", "").option("header", header).csv(path)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(beg, end) of a subcorpus file of sorted pairs of little-endian u64."""
    with open(path, "rb") as data:
        pairs = np.frombuffer(data.read(), "<u8").reshape(-1, 2)
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "beg long, end long")


def write_ranges(ranges: DataFrame, path: str) -> None:
    with open(path, "wb") as out:
        for r in ranges.orderBy("beg").select(F.col("beg"), F.col("end")).toLocalIterator():
            out.write(struct.pack("<QQ", r[0], r[1]))
