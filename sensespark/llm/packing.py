"""Packing token sequences: first-fit decreasing with a tournament tree.

Texts become token ids, each document ending in an end id, and are cut at the
capacity; the pieces go to randomised groups, and each group is packed on its
own: pieces in descending length, each into the first bin with room, which a
tournament tree over the bins' free places finds in logarithmic time.  Grouping
by hash keeps each task's share bounded at any size of the input.

Defined cases: a null text is empty; an empty text is its end id alone; equal
rows are packed each on their own; an empty table gives no pieces; other
columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import handing_back, materialise, short_batches

CAPACITY = 2048
GROUP_PIECES = 8192
#: Pre-tokens whose ids a worker remembers.
CACHE = 400_000


class _Pieces(dict):
    """Pre-token to its ids as little-endian 32-bit bytes, filled on demand."""

    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.encode(word), "<u4").tobytes()
        if len(self) < CACHE and len(word) < 64:
            self[word] = found
        return found


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    """A function from a text without added tokens to its ids as little-endian 32-bit bytes.

    The vocabulary file ``byte_bpe_50k.json`` and the ranks of
    ``byte_bpe_50k.tiktoken`` are the same vocabulary; ids agree with those
    that the tokenizers library gives for the first (see the tests), but for
    its added tokens, which are plain text here.
    """
    import public_tokenizers
    import regex
    import tiktoken

    name = vocabulary.removesuffix(".json") + ".tiktoken"
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = regex.compile(public_tokenizers.PATTERN).findall
    known = _Pieces(encoding).__getitem__
    return lambda text: b"".join(map(known, split(text)))


@lru_cache(maxsize=2)
def _document_tokenizer(vocabulary: str):
    """As ``_tokenizer``, but added tokens of the vocabulary have their own ids.

    As in the tokenizers library, they are found in the raw text from left to
    right, the longest first, and what lies between is encoded on its own.
    """
    import public_tokenizers
    import regex

    ordinary = _tokenizer(vocabulary)
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{vocabulary} has added tokens that are not matched literally")
    known = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
    split = regex.compile("(" + "|".join(map(regex.escape, sorted(known, key=len, reverse=True))) + ")").split

    def encode(text: str) -> bytes:
        if not any(token in text for token in known):
            return ordinary(text)
        return b"".join(known[x] if i % 2 else ordinary(x) for i, x in enumerate(split(text)))

    return encode


def _forget() -> None:
    """Vocabularies and remembered pre-tokens go; the next text loads them again."""
    _document_tokenizer.cache_clear()
    _tokenizer.cache_clear()


_PIECES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long"


def token_pieces(
    df: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids_crc32 [, ids].

    Pieces but a document's last are ``capacity`` long.  ``ids`` (bytes, little
    endian, 32 bits each) come with ``with_ids``.
    """
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _document_tokenizer(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((doc, at // 4, len(part) // 4, len(ids) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _PIECES.split(", ")] + ["ids"] * with_ids)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(handing_back(cut, _forget), _PIECES + ", ids binary" * with_ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, by first-fit decreasing.

    A leaf of the tournament tree is a bin's free room and an inner node the
    larger of its two; the first bin with room is found by going left wherever
    the left winner suffices.
    """
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


_PLACED = _PIECES + ", sequence_id long, offset long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with their ``sequence_id`` and ``offset``.

    The groups number as many as their mean size of ``group_pieces`` asks for,
    so a task's memory doesn't grow with the input.  A sequence's id is its
    group in the high and its bin in the low 32 bits.
    """
    groups = max(1, round(pieces.count() / group_pieces))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="packing_group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    group = F.pmod(F.xxhash64(F.lit(7), "doc_id", "start", "ids_crc32"), F.lit(groups))
    narrow = pieces.select(*[x.split()[0] for x in _PIECES.split(", ")])
    return narrow.withColumn("packing_group", group).groupBy("packing_group").applyInPandas(place, _PLACED)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, **options) -> DataFrame:
    """Cut and pack the documents; texts are tokenised once."""
    with short_batches(df.sparkSession):
        pieces = materialise(token_pieces(df, capacity, **options), "pieces")
    return pack(pieces, capacity, group_pieces)


def build_sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of each packed sequence, from pieces ``with_ids``.

    A sequence holds at most ``capacity`` ids, so its group is bounded.
    """
    keys = ["doc_id", "start", "ids_crc32"]
    where = placed.select(*keys, "sequence_id", "offset").dropDuplicates([*keys, "sequence_id", "offset"])
    parts = pieces.select(*keys, "ids").dropDuplicates(keys).join(where, keys)
    joined = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return joined.select("sequence_id", F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("hex")).select(
        "sequence_id", F.unhex("hex").alias("ids")
    )
