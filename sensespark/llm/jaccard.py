"""N-gram Jaccard join with signature trees.

Texts become sets of hashed 5-word shingles; sets with a Jaccard similarity of
at least the threshold are linked.  The join runs in levels:

1. Equal sets are one class, with its smallest id as representative.
2. A set has ``BANDS`` keys, each made of ``ROWS`` minhash values.
   Representatives that share a key form a block.  A pair at the threshold
   shares none with a chance of (1 - 0.75^4)^48 = 1e-8, and of 1e-11 at 0.8.
3. Blocks whose members all have one label (their component so far) are dropped
   after a count per key, before any bitmap moves.
4. The members of other blocks bring their size, label and token bitmap, never
   their set, into units of at most about ``TILE`` members a side.
5. A unit builds signature trees: nodes hold the OR of their sets' token
   bitmaps, the range of their sizes and the most shingles on one bit.  A dual
   traversal drops node pairs whose largest possible overlap is too small or
   whose members have one label; what is left at the leaves are candidates,
   compared exactly on whole texts.
6. Links that are confirmed become components, which are the next run's labels.

The first run sees ``FIRST`` keys of a set, the second all of them; in both a
candidate that looks linked connects at once within its unit, so that a group
of n near copies gives about n candidates, and not n * n.  If the exact
comparison refutes any such candidate, pairs may have been passed over wrongly:
then a third run sees what still shares a key across labels, and there nothing
connects but confirmed links.

No unit grows with the data.  In the first run a block above ``TILE`` is dealt
into chunks, in each band anew, since connecting is all it is for.  Later such
a block is divided by the other bands' keys, and what is still too large is met
tile by tile.  Components above ``CROWD`` members bring each of them once, to
meet the sets that share any key with the component, rather than once for each
key.

Defined cases: words are lower-cased (A-Z) and split at space and 09 to 0D; a
text with fewer than five words is one shingle; a null or wordless text has no
shingles and links with nothing; equal rows are one class; texts that share an
id are one vertex; rows without id get the component of their class, null if
none of it has an id; an empty table gives an empty result; other columns are
ignored by ``link_documents`` and kept by ``keep_first``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import BROADCAST_ROWS, handing_back, materialise, short_batches, within

WORDS = 5
#: 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS = 48
ROWS = 4
#: Keys of a set that the first run sees.
FIRST = 3
TILE = 2048
#: Components above so many members meet others as a whole.
CROWD = 256
LEAF = 16
#: Texts that one task compares with a text at a time.
TEXTS = 32
#: Bitmaps have at least so many bits, and twice their set's size.
LEAST_BITS = 1024
#: Estimated similarity from which the first two runs take two sets as linked.
LIKELY = 0.8

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLE = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    """The first n powers of the base (0) or of its inverse (1), mod 2^64."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, 1 << 16), (_BASE, _INVERSE)[which], np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles.

    A shingle's hash is a polynomial over its bytes, taken from running sums,
    so a text costs a few passes of numpy whatever its words.
    """
    raw = b" ".join((text or "").encode().lower().split())
    if not raw:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(raw, np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(0, len(data)), out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    if len(starts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    found = np.sort(_mixed((sums[ends] - sums[starts]) * _power(1, len(data))[starts]))
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


_FACTORS = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` keys: minhash values under fixed permutations, ``ROWS`` at a time."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        spread = hashes[at : at + 512, None] * _FACTORS
        spread ^= spread >> np.uint64(32)
        np.minimum(least, (spread * np.uint64(0x9E3779B97F4A7C15)).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        keys = _mixed(keys * np.uint64(0x100000001B3) + row)
    return keys


def bitmap(hashes: np.ndarray) -> bytes:
    """The set's tokens on a power of two of bits, by their lowest bits."""
    bits = max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def _crowd(hashes: np.ndarray) -> int:
    """The most tokens on one bit of the half-size bitmap, so of the whole one too."""
    bits = max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length()) // 2
    return int(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64)).max())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_SIGNS = "doc_id long, n_shingles long, print binary, keys array<long>, bits binary, crowd int"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, prints, keys, bits, crowds = [], [], [], [], []
        for text in batch.column(1):
            found = shingles(text.as_py())
            sizes.append(len(found))
            prints.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            keys.append(_signed(band_keys(found)))
            bits.append(bitmap(found) if len(found) else None)
            crowds.append(_crowd(found) if len(found) else 0)
        ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(bits, pa.binary()), pa.array(crowds, pa.int32())],
            ["doc_id", "n_shingles", "print", "keys", "bits", "crowd"],
        )


class Tree:
    """A signature tree over members whose bitmaps are equally long.

    Members are sorted by size.  Level 0 are leaves of ``LEAF`` members; each
    further level joins two nodes.  A node has the OR of its members' bitmaps,
    their least and largest size, and the most shingles that one has on a bit.
    """

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, crowds: np.ndarray, at: np.ndarray):
        self.maps, self.sizes, self.crowds, self.at = maps, sizes, crowds, at
        self.weights = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels, step = [], LEAF
        level = (maps, sizes, sizes, crowds)
        while not self.levels or len(self.levels[-1][1]) > 1:
            cut = np.arange(0, len(level[1]), step)
            level = tuple(f.reduceat(x, cut, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level, strict=True))
            self.levels.append(level)
            step = 2

    def halved(self) -> Tree:
        """The same members with bitmaps of half the length."""
        half = self.maps.shape[1] // 2
        return Tree(self.maps[:, :half] | self.maps[:, half:], self.sizes, self.crowds, self.at)

    def members(self, level: int, node: int) -> range:
        return range(node * (LEAF << level), min(len(self.sizes), (node + 1) * (LEAF << level)))


def _needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b that links them."""
    return -(-(percent * (a + b)) // (100 + percent))


def _possible(left: tuple, right: tuple, percent: int) -> bool:
    """Whether a set below one node can overlap enough with one below the other.

    Shared shingles fall on bits that both ORs have, and on each of them at
    most as many as any set of the node has there (its crowd).  So the overlap
    is at most the common bits times the smaller crowd, and at most either
    node's largest size; the smallest sizes say what is needed at least.
    """
    (bits_a, least_a, most_a, crowd_a), (bits_b, least_b, most_b, crowd_b) = left, right
    if most_a * 100 < percent * least_b or most_b * 100 < percent * least_a:
        return False
    common = int(np.bitwise_count(bits_a & bits_b).sum())
    return min(most_a, most_b, common * min(crowd_a, crowd_b)) >= _needed(least_a, least_b, percent)


def _leaf_pairs(a: Tree, b: Tree, rows: range, cols: range, percent: int) -> Iterator[tuple[int, int, bool]]:
    """Member pairs that size and bitmaps leave, and whether they look linked.

    A set's shingles on bits that the other lacks are not shared, so overlap is
    at most its size less their number.
    """
    ra, rb = slice(rows.start, rows.stop), slice(cols.start, cols.stop)
    na, nb = a.sizes[ra][:, None], b.sizes[rb][None, :]
    both = np.bitwise_count(a.maps[ra][:, None, :] & b.maps[rb][None, :, :]).sum(axis=2, dtype=np.int64)
    alone_a, alone_b = a.weights[ra][:, None] - both, b.weights[rb][None, :] - both
    fits = np.minimum(na - alone_a, nb - alone_b) >= _needed(na, nb, percent)
    bits = a.maps.shape[1] * 64
    missing = alone_a / (1 - b.weights[rb][None, :] / bits).clip(0.05) + alone_b / (1 - a.weights[ra][:, None] / bits).clip(0.05)
    likely = (na + nb - missing) >= LIKELY * (na + nb + missing)
    for i, j in zip(*np.nonzero(fits), strict=True):
        yield rows.start + int(i), cols.start + int(j), bool(likely[i, j])


class _Groups:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)
        return i != j


def _traverse(a: Tree, b: Tree, groups: _Groups, out: list, percent: int, trust: bool) -> None:
    """Dual traversal of two trees, or of one with itself."""
    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        la, na, lb, nb = todo.pop()
        if a is b and (nb + 1) << lb <= na << la:
            continue
        if not _possible(tuple(x[na] for x in a.levels[la]), tuple(x[nb] for x in b.levels[lb]), percent):
            continue
        rows, cols = a.members(la, na), b.members(lb, nb)
        root = groups.find(a.at[rows[0]])
        if all(groups.find(a.at[i]) == root for i in rows) and all(groups.find(b.at[j]) == root for j in cols):
            continue
        if not la and not lb:
            for i, j, likely in _leaf_pairs(a, b, rows, cols, percent):
                x, y = a.at[i], b.at[j]
                if (a is not b or i < j) and groups.find(x) != groups.find(y):
                    out.append((x, y, trust and likely))
                    if trust and likely:
                        groups.join(x, y)
            continue
        for x in (2 * na, 2 * na + 1) if la >= lb else (na,):
            for y in (2 * nb, 2 * nb + 1) if lb >= la else (nb,):
                down_a, down_b = la - (la >= lb), lb - (lb >= la)
                if x < len(a.levels[down_a][1]) and y < len(b.levels[down_b][1]):
                    todo.append((down_a, x, down_b, y))


def _forest(at: np.ndarray, sizes: np.ndarray, bits: list[bytes], crowds: np.ndarray) -> dict[int, Tree]:
    """A tree for each length of bitmaps, over the members ``at``, sorted by size."""
    lengths, trees = np.array([len(bits[i]) for i in at]), {}
    for n in np.unique(lengths).tolist():
        own = at[lengths == n]
        maps = np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(len(own), n // 8)
        trees[n] = Tree(maps, sizes[own], crowds[own], own)
    return trees


def tree_join(
    sizes: np.ndarray, bits: list[bytes], crowds: np.ndarray, percent: int = PERCENT, labels: np.ndarray | None = None, trust: bool = True, sides: np.ndarray | None = None
) -> list[tuple[int, int, bool]]:
    """Candidate pairs of positions among members with sizes and bitmaps, and whether they connected.

    Members of equal label are connected from the start; with ``trust``
    candidates that look linked connect as well.  With ``sides`` (0 and 1) only
    members of different sides meet.

    Sets that link are at most a factor of two apart in the length of their
    bitmaps, so a tree meets itself and the next longer one, folded to its
    length.
    """
    order = np.argsort(sizes, kind="stable")
    groups, out, first = _Groups(len(sizes)), [], {}
    for i, label in enumerate([] if labels is None else labels.tolist()):
        groups.join(i, first.setdefault(label, i))
    if sides is None:
        pairs = [(forest := _forest(order, sizes, bits, crowds), forest)]
    else:
        left, right = (_forest(order[sides[order] == k], sizes, bits, crowds) for k in (0, 1))
        pairs = [(left, right), (right, left)]
    for left, right in pairs:
        for n, tree in left.items():
            if n in right and (left is right or left is pairs[0][0]):
                _traverse(tree, right[n], groups, out, percent, trust)
            if 2 * n in right:
                _traverse(tree, right[2 * n].halved(), groups, out, percent, trust)
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pd.DataFrame]:
    """Rows with equal values in the first ``keys`` columns, which are sorted."""
    held: list[pd.DataFrame] = []
    names: list[str] = []
    for batch in batches:
        rows = batch.to_pandas()
        names = list(rows.columns[:keys])
        values = rows[names].to_numpy()
        if not len(rows):
            continue
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(rows)]
        if held and (held[-1][names].iloc[-1].to_numpy() != values[0]).any():
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            held.append(rows.iloc[a:b])
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        held.append(rows.iloc[cuts[-2] :])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _candidates(percent: int, trust: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], bool] = {}

        def flush() -> pa.RecordBatch:
            pairs = np.array(list(found), np.int64).reshape(-1, 2)
            trusted = pa.array(list(found.values()), pa.bool_())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), trusted], ["a", "b", "trusted"])

        for unit in _runs(batches, 3):
            ids, labels, sides = unit["rep"].tolist(), unit["label"].to_numpy(), unit["side"].to_numpy()
            if (labels == labels[0]).all():
                continue
            both = sides if sides.any() else None
            for i, j, trusted in tree_join(unit["n_shingles"].to_numpy(), unit["bits"].tolist(), unit["crowd"].to_numpy().astype(np.int64), percent, labels, trust, both):
                pair = (min(ids[i], ids[j]), max(ids[i], ids[j]))
                found[pair] = trusted or found.get(pair, False)
            if len(found) > 100_000:
                yield flush()
        yield flush()

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _runs(batches, 2):
            own = unit["b"].isna().to_numpy()
            first = [shingles(t) for t in unit["text"][own]]
            links = []
            for b, text in zip(unit["b"][~own], unit["text"][~own], strict=True):
                other = shingles(text)
                for mine in first:
                    shared = len(np.intersect1d(mine, other, assume_unique=True))
                    if len(other) and shared * 100 >= percent * (len(mine) + len(other) - shared):
                        links.append(int(b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([int(unit["a"].iloc[0])] * len(links), pa.int64()), pa.array(links, pa.int64())], ["a", "b"])

    return run


def _across(keyed: DataFrame) -> DataFrame:
    """The rows (key, rep, label, crowd) of keys that have more than one label.

    Partial aggregation: a key sends one row per task, however many sets have it.
    """
    labels = keyed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return keyed.join(labels.select("key"), "key")


def _spread(salt: int, parts: Column, *columns: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *columns), parts.cast("long")).cast("int")


def _tiled(blocks: DataFrame, tile: int) -> DataFrame:
    """(key, i, j, rep): blocks (key, rep, n) as pairs of tiles of about ``tile`` members."""
    tiled = blocks.withColumn("tiles", F.ceil(F.col("n") / F.lit(tile)).cast("int"))
    tiled = tiled.withColumn("own", _spread(3, F.col("tiles"), "rep"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    return tiled.select("key", "rep", F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "rep")


def _block_units(rows: DataFrame, owners: DataFrame, tile: int, chunks: bool) -> DataFrame:
    """(key, i, j, rep) for members of small components, from rows (key, rep, label)."""
    stats = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.min("rep").alias("a"), F.max("rep").alias("b"))
    stats = materialise(stats.filter("low < high"), "near-blocks")
    # Two sets may share many keys; they are one unit.
    twos = stats.filter("n = 2").select("a", "b").distinct()
    units = twos.select(F.xxhash64("a", "b").alias("key"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.explode(F.array("a", "b")).alias("rep"))
    blocks = rows.join(stats.filter("n > 2").select("key", "n"), "key")
    if chunks:
        parts = F.ceil(F.col("n") / F.lit(tile))
        return units.unionByName(blocks.select("key", _spread(4, parts, "key", "rep").alias("i"), F.lit(0).alias("j"), "rep"))
    units = units.unionByName(blocks.filter(F.col("n") <= tile).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep"))
    if stats.filter(F.col("n") > tile).isEmpty():
        return units
    # A pair that shares one key shares another one too, up to a chance of 2e-8 at the threshold.
    parts = blocks.filter(F.col("n") > tile).join(owners.select("rep", "keys"), "rep").select("rep", "label", F.col("key").alias("k"), F.explode("keys").alias("other"))
    parts = materialise(_across(parts.filter("k <> other").select(F.xxhash64("k", "other").alias("key"), "rep", "label")), "near-parts")
    counted = parts.join(parts.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    return units.unionByName(_tiled(counted, tile))


def _crowd_units(rows: DataFrame, tile: int) -> DataFrame:
    """(key, i, j, rep, side): large components against the sets that share a key with them.

    ``rows`` has key, rep, label, size and crowd.  Each member of a component
    comes once to each tile of those sets.
    """
    crowds = rows.filter("crowd").select("key", F.col("label").alias("big"), "size").distinct()
    others = rows.drop("size").join(crowds, "key").filter("label <> big and (not crowd or big < label)").select("big", "size", "rep").distinct()
    others = materialise(others, "near-others")
    tiles = others.groupBy("big").agg(F.ceil(F.max("size") / tile).cast("int").alias("is"), F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("js"))
    members = rows.filter("crowd").select(F.col("label").alias("big"), "rep").distinct().join(tiles, "big")
    members = members.select("big", _spread(5, F.col("is"), "rep").alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), "rep", F.lit(0).alias("side"))
    others = others.join(tiles, "big")
    others = others.select("big", F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), _spread(6, F.col("js"), "rep").alias("j"), "rep", F.lit(1).alias("side"))
    return members.unionByName(others).select(F.xxhash64(F.lit(7), "big").alias("key"), "i", "j", "rep", "side")


def confirmed_links(documents: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets link, compared exactly.

    A text that is in many pairs is sent to several tasks, each of which
    compares it with about ``TEXTS`` others.
    """
    parts = found.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TEXTS).cast("int").alias("parts"))
    sides = found.join(parts, "a").select("a", _spread(8, F.col("parts"), "b").alias("part"), "b", F.col("b").alias("doc_id"))
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
    sides = sides.unionByName(own)
    # At most one row of its own for each pair.
    sides = F.broadcast(sides) if 2 * found.count() <= BROADCAST_ROWS else sides
    pairs = documents.join(sides, "doc_id").select("a", "part", "b", "text")
    with short_batches(documents.sparkSession):
        return materialise(pairs.repartition("a", "part").sortWithinPartitions("a", "part", "b").mapInArrow(handing_back(_verify(percent)), "a long, b long"), "near-links")


def _components(links: DataFrame) -> DataFrame:
    """(id, component, size), written."""
    found = connected_components(links)
    sizes = found.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("size"))
    return materialise(found.join(sizes, F.col("component") == F.col("c")).select("id", "component", "size"), "near-components")


def _run(documents: DataFrame, owners: DataFrame, rows: DataFrame, known: DataFrame | None, percent: int, tile: int, crowd: int, trust: bool) -> tuple[DataFrame, DataFrame, bool]:
    """One run over rows (key, rep) or (rep, keys).

    Returns the components so far, the rows across labels, and whether a
    candidate that had connected was refuted.
    """
    labels = None
    if known is None:
        labelled = rows.withColumns({"label": F.col("rep"), "size": F.lit(1).cast("long")})
    else:
        labels = within(known.select(F.col("id").alias("rep"), F.col("component").alias("label"), "size"), BROADCAST_ROWS)
        labelled = rows.join(labels, "rep", "left").withColumns({"label": F.coalesce("label", "rep"), "size": F.coalesce("size", F.lit(1).cast("long"))})
    if "keys" in rows.columns:
        labelled = labelled.select("rep", "label", "size", F.explode("keys").alias("key"))
    rows = materialise(_across(labelled.select("key", "rep", "label", "size")).withColumn("crowd", F.col("size") > crowd), "near-rows")
    units = _block_units(rows.filter("not crowd"), owners, tile, known is None).withColumn("side", F.lit(0))
    if not rows.filter("crowd").isEmpty():
        units = units.unionByName(_crowd_units(rows, tile))
    # Texts that share an id are one vertex, so a unit may have an id twice.
    units = units.join(owners.select("rep", "n_shingles", "bits", "crowd"), "rep")
    units = units.withColumn("label", F.col("rep")) if labels is None else units.join(labels.drop("size"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    units = units.select("key", "i", "j", "rep", "label", "side", "n_shingles", "bits", "crowd")
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    tried = units.mapInArrow(handing_back(_candidates(percent, trust)), "a long, b long, trusted boolean").groupBy("a", "b").agg(F.max("trusted").alias("trusted"))
    with short_batches(documents.sparkSession):
        tried = materialise(tried, "near-candidates")
    links = confirmed_links(documents, tried.select("a", "b"), percent)
    refuted = trust and tried.filter("trusted").count() > tried.filter("trusted").join(links, ["a", "b"], "left_semi").count()
    if known is not None:
        if links.isEmpty():
            return known, rows, refuted
        links = links.unionByName(known.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return _components(links), rows, refuted


def class_components(documents: DataFrame, owners: DataFrame, percent: int = PERCENT, tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """(id, component, size) of the representatives that have links.

    ``owners`` has rep, n_shingles, keys, bits and crowd.  Links of later runs
    extend the stars that those of earlier ones have made.
    """
    first = owners.select("rep", F.slice("keys", 1, FIRST).alias("keys"))
    known, _, _ = _run(documents, owners, first, None, percent, tile, crowd, True)
    known, rows, refuted = _run(documents, owners, owners.select("rep", "keys"), known, percent, tile, crowd, True)
    if refuted:
        known, _, _ = _run(documents, owners, rows.select("key", "rep"), known, percent, tile, crowd, False)
    return known


def link_documents(df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    documents = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with short_batches(df.sparkSession):
        signed = materialise(documents.mapInArrow(handing_back(_sign), _SIGNS), "shingle-signs")
    grouped = signed.filter("print is not null").groupBy(F.col("print").alias("p"))
    repeated = grouped.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = within(materialise(repeated.select("p", "rep", F.lit(True).alias("again")), "shingle-classes"), BROADCAST_ROWS)
    # A set that no other row has is its own representative.
    owners = signed.filter("print is not null and doc_id is not null").join(repeated, F.col("print") == F.col("p"), "left")
    owners = owners.filter("again is null or doc_id = rep").select(F.col("doc_id").alias("rep"), "n_shingles", "keys", "bits", "crowd")
    found = class_components(documents, owners, percent, tile, crowd).select(F.col("id").alias("linked"), "component")
    rows = signed.select("doc_id", "n_shingles", "print").join(repeated.select("p", "rep", "again"), F.col("print") == F.col("p"), "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("again"), F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    return rows.join(found, F.col("rep") == F.col("linked"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def keep_first(df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component.

    Rows without id, and rows that share the smallest id, all stay.
    """
    tag = uuid.uuid4().hex[:8]
    linked = link_documents(df, percent, id_col, text_col)
    later = materialise(linked.filter("component_id < doc_id").select(F.col("doc_id").alias(f"d{tag}")).distinct(), "near-later")
    return df.join(within(later, 4 * BROADCAST_ROWS), df[id_col] == F.col(f"d{tag}"), "left_anti")
