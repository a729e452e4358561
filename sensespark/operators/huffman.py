"""Huffman codes of a vocabulary.

The tree is built on the driver from one number per word; ties go by id, so
codes are the same on every run.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tree(freqs: list[int]) -> list[tuple[int, int]]:
    """(parent, code) of each node; leaves are 0..V-1, the root's parent is -1.

    Of the two lightest nodes the first gets code 1.
    """
    size = len(freqs)
    heap = [(f, i) for i, f in enumerate(freqs)]
    heapq.heapify(heap)
    links = [(-1, 0)] * max(1, 2 * size - 1)
    for node in range(size, 2 * size - 1):
        (fa, a), (fb, b) = heapq.heappop(heap), heapq.heappop(heap)
        links[a], links[b] = (node, 1), (node, 0)
        heapq.heappush(heap, (fa + fb, node))
    return links


def paths(freqs: list[int]) -> list[list[tuple[int, int]]]:
    """For each word (node_id, code) from the root to its leaf; inner nodes count from 0."""
    links, size, out = tree(freqs), len(freqs), []
    for word in range(size):
        steps, node = [], word
        while links[node][0] >= 0:
            parent, code = links[node]
            steps.append((parent - size, code))
            node = parent
        out.append(steps[::-1])
    return out


def flat_paths(freqs: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``paths`` as two arrays: where each word's path starts, with the end of all, and node_id * 2 + code."""
    parents, codes = np.array(tree(freqs), np.int32).reshape(-1, 2).T
    size, node = len(freqs), np.arange(len(freqs))
    depth = np.zeros(size, np.int64)
    while (inside := parents[node] >= 0).any():
        depth += inside
        node = np.where(inside, parents[node], node)
    starts = np.concatenate([[0], depth.cumsum()])
    steps = np.empty(starts[-1], np.int32)
    # From the leaves up, a level at a time.
    word, node, at = np.arange(size), np.arange(size), starts[1:] - 1
    while (inside := parents[node] >= 0).any():
        word, node = word[inside], node[inside]
        steps[at[word]] = (parents[node] - size) * 2 + codes[node]
        at[word] -= 1
        node = parents[node]
    return starts, steps


def path_table(spark: SparkSession, lexicon: DataFrame) -> DataFrame:
    """(word_id, depth, node_id, code) for a lexicon (word_id from 0, freq)."""
    rows = lexicon.select("word_id", "freq").orderBy("word_id").collect()
    found = paths([r["freq"] for r in rows])
    flat = [(rows[w]["word_id"], d, n, c) for w, steps in enumerate(found) for d, (n, c) in enumerate(steps)]
    return spark.createDataFrame(flat, "word_id long, depth int, node_id long, code int")


def dump(steps: DataFrame) -> DataFrame:
    """(word_id, path): every word's path as ``node:code`` from the root on."""
    ordered = F.sort_array(F.collect_list(F.struct("depth", "node_id", "code")))
    path = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["node_id"].cast("string"), x["code"].cast("string"))), " ")
    return steps.groupBy("word_id").agg(path.alias("path"))
