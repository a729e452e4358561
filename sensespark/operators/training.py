"""Training of a multi-sense model in rounds of distributed SGD.

Shared memory does not span executors.  In each round every partition of the
documents starts from the same parameters, runs sequential SGD over its
documents, and returns the rows that it changed; rows are averaged over the
partitions that touched them, weighted by their updates.  Results differ from
lock-free shared memory, and no bit parity is claimed.

The parameters are what every task needs, so they are broadcast, and the size
they may have is a parameter that is checked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensespark.operators import huffman, kernel
from sensespark.operators.lexicon import subsample
from sensespark.sources.store import small

#: Largest parameters that are broadcast.
MAX_BYTES = 1 << 30


@dataclass
class Options:
    dim: int = 100
    senses: int = 5
    alpha: float = 0.1
    window: int = 4
    epochs: int = 1
    rate: float = 0.025
    min_prob: float = 1e-3
    skip: float = 1e-10
    init_count: float = 0.0
    #: Threshold above whose share words are dropped at random; none keeps all.
    subsample: float | None = None
    partitions: int = 8
    seed: int = 666


@dataclass
class State:
    inner: np.ndarray
    outer: np.ndarray
    counts: np.ndarray

    @property
    def meanings(self) -> int:
        """Senses that each word has room for."""
        return self.inner.shape[1]

    def blank(self) -> np.ndarray:
        """A score of 0 for each sense."""
        return np.zeros(self.meanings)


_SIX = np.arange(6.0)


def digamma(x: np.ndarray) -> np.ndarray:
    """For x > 0: recurrence up to 6, then the asymptotic series."""
    y = x + 6
    p = 1 / (y * y)
    series = np.log(y) - 0.5 / y - p * (1 / 12 - p * (1 / 120 - p * (1 / 252 - p * (1 / 240 - p * 5 / 660))))
    return series - (1 / (x[..., None] + _SIX)).sum(axis=-1)


def training_prior(counts: np.ndarray, alpha: float) -> np.ndarray:
    """E[log pi] of the stick-breaking posterior, by digamma."""
    both = np.empty((3, len(counts)))
    both[1] = 1 + counts
    both[2] = alpha
    both[2, :-1] += counts[:0:-1].cumsum()[::-1]
    both[0] = both[1] + both[2]
    whole, taken, left = digamma(both)
    taken -= whole
    taken[-1] = 0.0
    taken[1:] += (left - whole)[:-1].cumsum()
    return taken


def learning_rate(rate: float, read: int, total: int) -> float:
    return max(rate * (1 - read / (total + 1)), rate * 1e-4)


def initial(freqs: np.ndarray, options: Options) -> State:
    """Vectors near 0 and all mass on the first sense."""
    rng = np.random.default_rng(options.seed)
    size = (len(freqs), options.senses, options.dim)
    if 4 * int(np.prod(size)) > MAX_BYTES:
        raise ValueError(f"parameters of shape {size} are above {MAX_BYTES} bytes; prune the lexicon or lower dim")
    half = 0.5 / options.dim

    def drawn(shape: tuple[int, ...]) -> np.ndarray:
        out = np.empty(shape, np.float32)
        # In pieces, so that the numbers in double precision are few at a time.
        for i in range(0, len(out), 4096):
            out[i : i + 4096] = rng.uniform(-half, half, out[i : i + 4096].shape)
        return out

    counts = np.zeros(size[:2])
    counts[:, 0] = options.init_count or freqs
    return State(drawn(size), drawn((len(freqs), options.dim)), counts)


def step(state: State, word: int, context: list[int], codes: list[tuple[np.ndarray, np.ndarray]], freq: float, rate: float, options: Options) -> float:
    """One token: responsibilities of senses, then gradients; returns the log-likelihood."""
    score = state.blank()
    own = state.inner[word]
    if context:
        # Nothing changes before the responsibilities are known, so all paths are read at once.
        nodes = np.concatenate([codes[y][0] for y in context])
        code = np.concatenate([codes[y][1] for y in context])
        score -= np.logaddexp(0, (2 * code - 1) * (own @ state.outer.take(nodes, axis=0).T)).sum(axis=1)
    z = training_prior(state.counts[word], options.alpha) + score
    top = z.max()
    weight = np.exp(z - top)
    whole = weight.sum()
    likelihood = float(top + np.log(whole))
    weight /= whole
    active = np.where(weight < options.skip, 0, weight * rate)[:, None]
    for y in context:
        nodes, code = codes[y]
        outer = state.outer.take(nodes, axis=0)
        slope = active * ((1 - code) - 1 / (1 + np.exp(-(own @ outer.T))))
        # A path has a node once.
        state.outer[nodes] = outer + slope.T @ own
        own += slope @ outer
    state.counts[word] += rate * (weight * freq - state.counts[word])
    return likelihood


def met(n: int, window: int) -> np.ndarray:
    """How often each of n tokens is context of another."""
    at = np.arange(n)
    return np.minimum(n - 1, at + window) - np.maximum(0, at - window + 1)


def train(tokens: DataFrame, lexicon: DataFrame, options: Options) -> tuple[State, list[float]]:
    """Parameters for the lexicon's words and each round's mean log-likelihood; tokens are (doc_id, tok_ix, word)."""
    kept = tokens if options.subsample is None else subsample(tokens, lexicon, options.subsample, options.seed, ("doc_id", "tok_ix"))
    known = kept.join(small(lexicon.select("word", "word_id")), "word")
    words = F.transform(F.sort_array(F.collect_list(F.struct("tok_ix", "word_id"))), lambda x: x["word_id"].cast("int"))
    return _rounds(known.groupBy("doc_id").agg(words.alias("words")), lexicon, options)


def train_documents(docs: DataFrame, lexicon: DataFrame, options: Options) -> tuple[State, list[float]]:
    """``train`` on whole documents (doc_id, words), whose tokens are not exploded unless they are subsampled."""
    if options.subsample is not None:
        return train(docs.select("doc_id", F.posexplode("words").alias("tok_ix", "word")), lexicon, options)
    return _rounds(kernel.word_ids(docs, lexicon), lexicon, options)


def _rounds(docs: DataFrame, lexicon: DataFrame, options: Options) -> tuple[State, list[float]]:
    """Training on documents (doc_id, words as ids)."""
    spark = docs.sparkSession
    freqs = lexicon.select("word_id", "freq").orderBy("word_id").toArrow()["freq"].to_numpy().astype(np.float64)
    starts, steps = huffman.flat_paths(freqs.astype(int).tolist())
    state, means = initial(freqs, options), []
    docs = docs.repartition(options.partitions, "doc_id").sortWithinPartitions("doc_id")
    total = int(freqs.sum()) * options.epochs
    split = 4 * options.senses * options.dim
    for epoch in range(options.epochs):
        shared = kernel.share(spark, state.inner, state.outer, state.counts, freqs, starts, steps)
        changed = kernel.changed(docs, shared, options, int(freqs.sum()) * epoch, total)
        for part, at, value in kernel.means(changed, options.senses).toLocalIterator():
            if part == "in":
                state.inner[at] = np.frombuffer(value[:split], "<f4").reshape(options.senses, options.dim)
                state.counts[at] = np.frombuffer(value[split:], "<f8")
            elif part == "out":
                state.outer[at] = np.frombuffer(value, "<f4")
            else:
                means.append(float(np.frombuffer(value, "<f8")[0]))
        shared.destroy()
    return state, means


def sense_table(tokens: DataFrame, state: State, lexicon: DataFrame) -> DataFrame:
    """(word_id, sense, cnt, vec) of a trained state."""
    size, meanings, dim = state.inner.shape
    vectors = pa.FixedSizeListArray.from_arrays(state.inner.ravel(), dim).cast(pa.list_(pa.float32()))
    columns = {"word_id": np.repeat(np.arange(size), meanings), "sense": np.tile(np.arange(meanings, dtype=np.int32), size), "cnt": state.counts.ravel(), "vec": vectors}
    senses = tokens.sparkSession.createDataFrame(pa.table(columns)).withColumn("vec", F.col("vec").cast("array<double>"))
    return senses.join(lexicon.select("word_id", "word"), "word_id")
