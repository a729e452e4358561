"""Registered queries against their SQL, and operators against brute force."""

import math
import os
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensespark.functions import mathx
from sensespark.operators import context, huffman, lexicon, model, senses, training, trends
from sensespark.plans import catalogue
from sensespark.sources import corpus, fixtures, model_files, store
from sensespark.streaming import requests

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def rows(df):
    plain = lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) + 0.0 if isinstance(x, (int, float, np.number)) else str(x)
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ["lexicon_topk", "hit_type_marginals", "epoch_natural_order", "trend_theil_sen", "trend_minigraph", "nearest_long", "model_export", "context_window_infer", "pair_score", "pair_score_fast", "kwic_glue", "desamb_rows", "desamb_table", "sketch_eval", "sketch_overlap", "huffman_dump", "range_scan"])
def test_query_agrees_with_sql(spark, con, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    assert rows(got) == rows(con.execute(catalogue.oracle_sql()[name]).df())


def test_kwic_has_every_occurrence_of_every_head(spark, con):
    m, _, toks, _ = catalogue._occ(spark, DATA)
    words = [r["word"] for r in toks.select("pos", "word").orderBy("pos").collect()]
    heads = {r["hw"] for r in fixtures.heads(m).collect()}
    want = [(w, p, " ".join(words[max(0, p - 3) : p]), w, " ".join(words[p + 1 : p + 4])) for p, w in enumerate(words) if w in heads]
    found = catalogue.queries()["kwic"](spark, DATA).select("hw", "pos", "lctx", "kw", "rctx").toPandas()
    assert sorted(found.itertuples(index=False, name=None)) == sorted(want) and set(found["hw"]) == heads
    assert rows(found) == rows(con.execute(catalogue.oracle_sql()["kwic"]).df())


def _planned(spark, monkeypatch, name):
    """Joined nodes of all plans that a query runs, those of written tables included."""
    found, write = [], store.materialise

    def walk(node):
        found.append(node)
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    def seen(df):
        walk(df._jdf.queryExecution().sparkPlan())
        return df

    for module in (catalogue, context, corpus, fixtures, lexicon, senses):
        monkeypatch.setattr(module, "materialise", lambda df, name: write(seen(df), name))
    seen(catalogue.queries()[name](spark, DATA))
    return found


@pytest.mark.parametrize("name", ["kwic", "kwic_glue", "posterior", "sense_freqs_hard", "sketch_stats", "sketch_eval", "sketch_sample", "sense_concordance", "sense_freqs_soft"])
def test_no_exploded_rows_are_broadcast(spark, monkeypatch, name):
    """Each position beside an occurrence was sent to the driver, since Spark takes an explode for no growth."""
    nodes = _planned(spark, monkeypatch, name)
    built = [n.buildPlan().toString() for n in nodes if n.nodeName() == "BroadcastHashJoin"]
    assert built and not [b for b in built if "Generate" in b]


def test_training_pairs_are_counted_without_joining_tokens(spark, monkeypatch, con):
    """Each token met its neighbours in a join of all tokens with themselves; now the largest join has the lexicon."""
    rng = np.random.default_rng(8)
    texts = [[str(w) for w in rng.choice(list("abcdefg"), rng.integers(1, 12))] for _ in range(40)]
    toks = spark.createDataFrame([(d, i, w) for d, t in enumerate(texts) for i, w in enumerate(t)], "doc_id long, tok_ix int, word string")
    lex = spark.createDataFrame([(k, w) for k, w in enumerate("abcde")], "word_id long, word string")
    known = [["abcde".index(w) for w in t if w in "abcde"] for t in texts]
    want = [(d, i, t[i], t[i + k], k) for d, t in enumerate(known) for i in range(len(t)) for k in (-3, -2, -1, 1, 2) if 0 <= i + k < len(t)]
    assert sorted(tuple(r) for r in context.training_window(toks, lex, 3).collect()) == sorted(want)
    counts = pd.Series([x[2:] for x in want]).value_counts().to_dict()
    assert {tuple(r)[:3]: r["n"] for r in context.training_counts(toks, lex, 3).collect()} == counts
    found = catalogue.queries()["context_window_train"](spark, DATA)
    assert rows(found.toPandas()) == rows(con.execute(catalogue.oracle_sql()["context_window_train"]).df())
    names = [n.nodeName() for n in _planned(spark, monkeypatch, "context_window_train")]
    assert not [x for x in names if x in ("SortMergeJoin", "ShuffledHashJoin")]


def test_contexts_cross_short_documents(spark):
    """Documents of one to four words: contexts of up to five tokens reach over several of them."""
    rng = np.random.default_rng(5)
    texts = [[str(w) for w in rng.choice(["x", "y", "a", "b"], rng.integers(1, 5))] for _ in range(60)]
    docs = spark.createDataFrame([(3 * i, "de", "s", t) for i, t in enumerate(texts)], "doc_id long, lang string, source string, words array<string>")
    heads = spark.createDataFrame([(1, "x"), (2, "y")], "head_id long, hw string")
    words, starts = sum(texts, []), set(np.cumsum([0] + [len(t) for t in texts])[:-1].tolist())
    occ = context.surrounded(docs, corpus.placed(docs, 5)[1], heads, 5)
    got = {r["pos"]: (r["hw"], r["left"], r["right"], set(r["starts"]) | {r["pos"]} & starts) for r in occ.collect()}
    assert got == {p: (w, words[max(0, p - 5) : p], words[p + 1 : p + 6], {q for q in starts if abs(q - p) <= 5}) for p, w in enumerate(words) if w in ("x", "y")}
    placed, begins = corpus.placed(docs)
    toks = corpus.placed_tokens(placed)
    plain = context.occurrences(toks, heads)
    sort = lambda df: sorted(df.select("hw", "pos", "lctx", "kw", "rctx").collect())
    assert sort(context.kwic(occ, None, 3)) == sort(context.kwic(plain, toks, 3))
    assert sort(context.kwic(occ, None, 3, glued=True)) == sort(context.kwic(plain, toks, 3, begins.select(F.col("beg").alias("pos"))))


def test_glue_takes_blanks_away(spark):
    words = ["a", "b", "x", "c", "d", "x"]
    toks = spark.createDataFrame([(i, w, 0) for i, w in enumerate(words)], "pos long, word string, doc_id long")
    occ = spark.createDataFrame([(1, "x", 2, 0), (1, "x", 5, 0), (1, "a", 0, 0)], "head_id long, hw string, pos long, doc_id long")
    glue = spark.createDataFrame([(1,), (3,), (5,), (5,)], "pos long")
    got = {r["pos"]: (r["lctx"], r["kw"], r["rctx"]) for r in context.kwic(occ, toks, 2, glue).collect()}
    assert got == {0: ("", "a", "b x"), 2: ("ab ", "x", "c d"), 5: ("c d", "x", "")}
    none = {r["pos"]: (r["lctx"], r["rctx"]) for r in context.kwic(occ, toks, 2, glue.limit(0)).collect()}
    assert none == {0: ("", " b x"), 2: ("a b ", " c d"), 5: ("c d ", "")}


def test_fast_math_interpolates_the_grid(spark):
    xs = [-30.0, -8.0, -7.9999, -3.3, -1e-9, 0.0, 0.7, 5.123, 7.9999, 8.0, 30.0]
    grid = np.linspace(-8, 8, 4096)
    s, ls = 1 / (1 + np.exp(-grid)), -np.log1p(np.exp(-grid))
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", mathx.fast_sigmoid(F.col("x")).alias("s"), mathx.fast_log_sigmoid(F.col("x")).alias("l"))
    for r in df.collect():
        x = r["x"]
        assert r["s"] == pytest.approx(0.0 if x <= -8 else 1.0 if x >= 8 else np.interp(x, grid, s), abs=1e-12)
        assert r["l"] == pytest.approx(x if x <= -8 else 0.0 if x >= 8 else np.interp(x, grid, ls), abs=1e-12)


def test_disambiguated_rows_keep_their_columns(spark):
    given = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "row_id long, context string, more long")
    status = spark.createDataFrame([(1, "allok_hw"), (2, "nhead")], "row_id long, status string")
    post = spark.createDataFrame([(1, 7, 0, 0.25), (1, 7, 2, 0.75)], "row_id long, head_id long, sense int, p double")
    got = senses.disambiguated(given, status, post, 3).orderBy("row_id").collect()
    assert got[0].asDict() == {"row_id": 1, "context": "a", "more": 5, "status": "allok_hw", "cluster": "c2", "p": 0.75, "cluster_probs": "0:0.25 1:0.00 2:0.75", "nsenses": 2}
    assert got[1].asDict() == {"row_id": 2, "context": "b", "more": None, "status": "nhead", "cluster": None, "p": None, "cluster_probs": None, "nsenses": None}


def test_labels_and_unscored_collocates(spark):
    words = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],), (None,)], "lcm array<string>")
    assert [r[0] for r in words.select(senses.label(F.col("lcm"))).collect()] == ["a b", "", "", ""]
    rows = spark.createDataFrame([(1, "c", 2, 1.0, 9, ["h", "c"])], "head_id long, coll string, cnt long, rnk double, pos long, lcm array<string>")
    none = spark.createDataFrame([], "head_id long, at long, sense int, p double")
    assert senses.sketch_evaluation(rows, none).collect()[0].asDict() == {"mean": -1.0, "sd": -1.0, "head_id": 1, "coll": "c", "cnt": 2, "rnk": 1.0, "label": "h"}


def test_sampled_sketches_are_statistics_of_ten_positions(spark):
    m, docs, _, _, post = catalogue._posterior(spark, DATA)
    sketches = catalogue._head_sketches(docs, m)
    picked = lexicon.sample_positions(sketches, 10, ["head_id", "coll"]).toPandas()
    every, by_pos = sketches.toPandas(), post.toPandas().groupby(["head_id", "at"])
    shares = {key: g.set_index("sense")["p"] for key, g in by_pos}
    got = {(r["head_id"], r["coll"]): r for r in catalogue.queries()["sketch_sample"](spark, DATA).collect()}
    assert set(got) == set(zip(every["head_id"], every["coll"])) and every.groupby(["head_id", "coll"]).size().max() > 10
    assert set(picked["pos"]) <= set(every["pos"])
    for key, g in picked.groupby(["head_id", "coll"]):
        means = pd.concat([shares[(key[0], p)] for p in g["pos"]], axis=1).mean(axis=1)
        assert len(g) == min(10, (every["coll"][every["head_id"] == key[0]] == key[1]).sum()) == got[key]["n"]
        assert got[key]["mean"] == pytest.approx(means.max(), abs=1e-4)


def test_subsampling_drops_frequent_words_by_their_share(spark):
    toks = spark.createDataFrame([(d, i, "often" if i < 90 else "rare") for d in range(100) for i in range(100)], "doc_id long, tok_ix int, word string")
    words = spark.createDataFrame([(0, "often", 9000), (1, "rare", 1000)], "word_id long, word string, freq long")
    at = ("doc_id", "tok_ix")
    kept = lambda seed: lexicon.subsample(toks, words, 0.1, seed, at)
    n = {r["word"]: r["count"] for r in kept(1).groupBy("word").count().collect()}
    assert n["rare"] == 1000 and abs(n["often"] / 9000 - math.sqrt(0.1 / 0.9)) < 0.02
    assert kept(1).exceptAll(kept(1)).count() == 0 and kept(1).exceptAll(kept(2)).count() > 0
    options = dict(dim=4, senses=2, window=2, partitions=2)
    whole, part = (training.train(toks, words, training.Options(**options, subsample=t))[1] for t in (None, 0.1))
    assert whole != part


def test_every_statement_has_its_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_expected_pi_sums_to_one(spark):
    df = spark.createDataFrame([(0, k, c) for k, c in enumerate([5.0, 3.0, 0.0])], "word_id long, sense int, cnt double")
    got = [r["pi"] for r in model.expected_pi(df, 0.1).orderBy("sense").collect()]
    left, expected = 1.0, []
    for k, n in enumerate([5.0, 3.0, 0.0]):
        m = 1.0 if k == 2 else (1 + n) / (1 + n + 0.1 + sum([5.0, 3.0, 0.0][k + 1 :]))
        expected.append(m * left)
        left *= 1 - m
    assert np.allclose(got, expected) and math.isclose(sum(got), 1)


def test_huffman_is_optimal():
    freqs = [50, 20, 10, 9, 6, 3, 1, 1]
    paths = huffman.paths(freqs)
    assert math.isclose(sum(2.0 ** -len(p) for p in paths), 1)
    heap, cost = sorted(freqs), 0
    while len(heap) > 1:
        both = heap[0] + heap[1]
        cost, heap = cost + both, sorted([both, *heap[2:]])
    assert sum(f * len(p) for f, p in zip(freqs, paths, strict=True)) == cost


def test_digamma_and_p_values(spark):
    x = [0.5, 1.0, 7.25]
    want = [-1.9635100260214235, -0.5772156649015329, 1.9104535268845354]
    assert np.allclose(training.digamma(np.array(x)), want, atol=1e-8)
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(mathx.digamma(F.col("x"))).collect()]
    assert np.allclose(got, want, atol=1e-8)
    assert math.isclose(mathx.student_p(2.0, 10), 0.07338803, rel_tol=1e-5)
    assert math.isclose(mathx.normal_p(1.96), 0.05, rel_tol=1e-2)


def test_training_separates_planted_senses(spark):
    """A word between two circles of words gets a sense in each, told apart by their words alone."""
    rng = np.random.default_rng(1)
    docs = []
    for i in range(240):
        side = [f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 4, 10)]
        docs += [(i, t, w) for t, w in enumerate([x for y in side for x in (y, "amb")])]
    toks = spark.createDataFrame(docs, "doc_id long, tok_ix int, word string")
    words = lexicon.ranked_lexicon(toks)
    options = training.Options(dim=8, senses=3, window=2, epochs=6, rate=0.1, alpha=1.0, partitions=2)
    state, means = training.train(toks, words, options)
    assert len(means) == 6 and means[-1] > means[0]
    listed = words.orderBy("word_id").collect()
    ids = {r["word"]: r["word_id"] for r in listed}
    codes = huffman.paths([r["freq"] for r in listed])

    def best(context_words):
        z = training.training_prior(state.counts[ids["amb"]], options.alpha)
        for word in context_words:
            for node, code in codes[ids[word]]:
                z = z - np.logaddexp(0, -(1 - 2 * code) * (state.inner[ids["amb"]] @ state.outer[node]))
        return int(z.argmax())

    found = {side: [best([f"{side}{i}", f"{side}{j}"]) for i in range(4) for j in range(4)] for side in "ab"}
    modes = {side: max(set(x), key=x.count) for side, x in found.items()}
    assert modes["a"] != modes["b"]
    assert all(found[side].count(modes[side]) >= 14 for side in "ab")


def test_a_step_is_that_of_plain_loops():
    rng = np.random.default_rng(5)
    codes = [(np.array([n for n, _ in p]), np.array([c for _, c in p], float)) for p in huffman.paths([9, 5, 4, 2])]
    options = training.Options(dim=3, senses=2, alpha=0.5, skip=0.05)
    inner, outer, counts = rng.normal(size=(4, 2, 3)), rng.normal(size=(4, 3)), np.array([[6.0, 3.0]] * 4)
    state = training.State(inner.copy(), outer.copy(), counts.copy())
    training.step(state, 1, [0, 2, 0], codes, 5.0, 0.1, options)
    sigma = lambda x: 1 / (1 + math.exp(-x))
    psi = lambda x: float(training.digamma(np.array([float(x)]))[0])
    # Two senses: E[ln v] and E[ln (1 - v)] of v ~ Beta(1 + 6, 0.5 + 3).
    z = [psi(7) - psi(10.5), psi(3.5) - psi(10.5)]
    for y in (0, 2, 0):
        for node, code in zip(*codes[y], strict=True):
            for k in range(2):
                z[k] += math.log(sigma((1 - 2 * code) * sum(inner[1, k] * outer[node])))
    w = [math.exp(x) / sum(map(math.exp, z)) for x in z]
    for y in (0, 2, 0):
        grad = np.zeros((2, 3))
        for node, code in zip(*codes[y], strict=True):
            out = np.zeros(3)
            for k in range(2):
                if w[k] >= options.skip:
                    g = w[k] * 0.1 * (1 - code - sigma(inner[1, k] @ outer[node]))
                    grad[k] += g * outer[node]
                    out += g * inner[1, k]
            outer[node] += out
        inner[1] += grad
    counts[1] += [0.1 * (w[k] * 5 - counts[1, k]) for k in range(2)]
    assert np.allclose(state.inner, inner) and np.allclose(state.outer, outer) and np.allclose(state.counts, counts)
    assert state.meanings == 2 and state.blank().tolist() == [0.0, 0.0]


def test_a_step_reads_all_paths_at_once(monkeypatch):
    """A step took the prior by three digammas and each context word's path on its own; updates were counted token by token."""
    codes = [(np.array([n for n, _ in p], np.int64), np.array([c for _, c in p], float)) for p in huffman.paths([9, 5, 4, 2])]
    options = training.Options(dim=3, senses=3)
    state, calls = training.initial(np.array([9.0, 5, 4, 2]), options), []
    for name in ("digamma", "np.logaddexp"):
        owner = training.np if "." in name else training
        real = getattr(owner, name.split(".")[-1])
        monkeypatch.setattr(owner, name.split(".")[-1], lambda *a, real=real, name=name: (calls.append(name), real(*a))[1])
    training.step(state, 0, [1, 2, 3], codes, 9.0, 0.1, options)
    assert sorted(calls) == ["digamma", "np.logaddexp"]
    training.step(state, 0, [], codes, 9.0, 0.1, options)
    for n, window in ((0, 2), (1, 2), (3, 1), (9, 2), (5, 4)):
        near = [j for i in range(n) for j in range(max(0, i - window), min(n, i + window)) if j != i]
        assert training.met(n, window).tolist() == [near.count(j) for j in range(n)]


@pytest.mark.parametrize("dim, senses, skip, size, many", [(5, 3, 1e-10, 0.1, 50), (19, 2, 1e-2, 0.5, 50), (16, 4, 0.2, 3.0, 6)])
def test_rounds_are_steps_and_run_no_python(spark, monkeypatch, dim, senses, skip, size, many):
    """Rounds were Python steps token by token; few tokens where products are large, since there a change of 3e-7 grows to 1 in 50 documents."""
    rng = np.random.default_rng(dim)
    docs = {d: [f"w{min(rng.zipf(1.4), 60)}" for _ in range(rng.integers(0, 40))] for d in range(many)}
    whole = spark.createDataFrame([*docs.items(), (99, None), (100, ["unknown"])], "doc_id long, words array<string>")
    tokens = whole.select("doc_id", F.posexplode("words").alias("tok_ix", "word"))
    words = lexicon.ranked_lexicon(tokens.filter("word <> 'unknown'"), 2)
    options = training.Options(dim=dim, senses=senses, window=2, epochs=2, rate=0.1, alpha=1.0, skip=skip, partitions=3)
    freqs = np.array([r["freq"] for r in words.orderBy("word_id").collect()], float)
    ids = {r["word"]: r["word_id"] for r in words.collect()}
    codes = [(np.array([n for n, _ in p], int), np.array([c for _, c in p], float)) for p in huffman.paths(freqs.astype(int).tolist())]
    start = training.State(*(rng.normal(0, size, x).astype(np.float32) for x in ((len(ids), senses, dim), (len(ids), dim))), rng.uniform(0, 9, (len(ids), senses)))
    monkeypatch.setattr(training, "initial", lambda f, o: training.State(start.inner.copy(), start.outer.copy(), start.counts.copy()))
    dealt = [[r["doc_id"] for r in part] for part in whole.select("doc_id").repartition(3, "doc_id").sortWithinPartitions("doc_id").rdd.glom().collect()]
    want, gains, n, total = training.initial(freqs, options), [], 0, int(freqs.sum())
    for epoch in range(2):
        sums = [np.zeros(x.shape) for x in (want.inner, want.outer, want.counts)]
        taken, read, gain = [np.zeros(len(ids)) for _ in range(2)], 0, 0.0
        for part in dealt:
            mine, n = training.State(want.inner.copy(), want.outer.copy(), want.counts.copy()), 0
            used = [np.zeros(len(ids)) for _ in range(2)]
            for listed in ([ids[w] for w in docs.get(d, []) if w in ids] for d in part):
                for i, w in enumerate(listed):
                    near = [listed[j] for j in range(max(0, i - 2), min(len(listed), i + 2)) if j != i]
                    gain += training.step(mine, w, near, codes, freqs[w], training.learning_rate(0.1, total * epoch + n * 3, total * 2), options)
                    n += 1
                    used[0][w] += 1
                    for y in near:
                        used[1][codes[y][0]] += 1
            for k, (of, by) in enumerate(((mine.inner, used[0]), (mine.outer, used[1]), (mine.counts, used[0]))):
                sums[k] += of * by.reshape(-1, *[1] * (of.ndim - 1))
            taken, read = [a + b for a, b in zip(taken, used, strict=True)], read + n
        gains.append(gain / read)
        for of, s, by in zip((want.inner, want.outer, want.counts), sums, (taken[0], taken[1], taken[0]), strict=True):
            of[by > 0] = s[by > 0] / by[by > 0].reshape(-1, *[1] * (of.ndim - 1))
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(type(whole), name, lambda *a: pytest.fail("Python on the executors"))
    for state, means in (training.train(tokens, words, options), training.train_documents(whole, words, options)):
        assert np.allclose(means, gains, rtol=1e-4)
        for got, plain in ((state.inner, want.inner), (state.outer, want.outer), (state.counts, want.counts)):
            assert np.allclose(got, plain, rtol=1e-3, atol=1e-3)


def test_flat_paths_are_paths():
    """The driver held a tuple for each node of each word's path, and all first vectors in double precision."""
    for freqs in ([4, 2, 1], [7], [5, 5], list(range(1, 60)), [2**i for i in range(20)]):
        starts, steps = huffman.flat_paths(freqs)
        got = [[(int(x) >> 1, int(x) & 1) for x in steps[a:b]] for a, b in zip(starts, starts[1:])]
        assert got == huffman.paths(freqs)
    rng = np.random.default_rng(666)
    want = rng.uniform(-0.25, 0.25, (9000, 3, 2)).astype(np.float32), rng.uniform(-0.25, 0.25, (9000, 2)).astype(np.float32)
    got = training.initial(np.ones(9000), training.Options(dim=2, senses=3))
    assert np.array_equal(got.inner, want[0]) and np.array_equal(got.outer, want[1])


def test_documents_are_subsampled_as_their_tokens(spark):
    whole = spark.createDataFrame([(d, ["often"] * 9 + ["rare"]) for d in range(50)], "doc_id long, words array<string>")
    tokens = whole.select("doc_id", F.posexplode("words").alias("tok_ix", "word"))
    words, options = lexicon.ranked_lexicon(tokens), training.Options(dim=4, senses=2, window=2, partitions=2, subsample=0.1)
    (a, x), (b, y) = training.train_documents(whole, words, options), training.train(tokens, words, options)
    assert x == y and np.array_equal(a.inner, b.inner) and x != training.train_documents(whole, words, training.Options(dim=4, senses=2, window=2, partitions=2))[1]


def test_learning_rate_falls_to_a_floor():
    assert training.learning_rate(0.5, 0, 99) == 0.5 and training.learning_rate(0.5, 50, 99) == 0.25
    assert training.learning_rate(0.5, 100, 99) == training.learning_rate(0.5, 500, 99) == 0.5e-4


def test_first_counts_are_on_the_first_sense():
    for given, want in ((0.0, [4.0, 2.0]), (7.0, [7.0, 7.0])):
        got = training.initial(np.array([4.0, 2.0]), training.Options(dim=2, senses=3, init_count=given)).counts
        assert got.tolist() == [[x, 0.0, 0.0] for x in want]


def test_beta_expectations(spark):
    a, b = F.lit(3.0), F.lit(5.0)
    got = spark.range(1).select(mathx.beta_mean(a, b), mathx.expected_log_beta(a, b), mathx.expected_log_beta(b, a)).collect()[0]
    x = (np.arange(200000) + 0.5) / 200000
    density = 105 * x**2 * (1 - x) ** 4
    assert np.allclose(list(got), [(density * x).mean(), (density * np.log(x)).mean(), (density * np.log(1 - x)).mean()], atol=1e-6)


def test_widths_in_names():
    assert mathx.parse_window(7, "m.w5", 4) == 7
    assert [mathx.parse_window(None, p, 4) for p in ("m.w5.bin", "m.w0.w12", "m.w100", "w3", "a/w3", "m.wx.w6", "dir.w8/m")] == [5, 12, 4, 3, 4, 6, 4]


def test_compatible_prior_and_early_exclusion(spark):
    df = spark.createDataFrame([(0, "x", k, c, v) for k, (c, v) in enumerate([(500.0, [1.0, 0.0]), (300.0, [0.9, 0.1]), (0.0, [0.0, 1.0]), (0.0, [0.0, 1.0])])], "word_id long, word string, sense int, cnt double, vec array<double>")
    pis = {r["sense"]: r["pi"] for r in model.expected_pi(df, 0.1).collect()}
    on = [k for k in range(4) if pis[k] >= 1e-3]
    got = {r["sense"]: r["log_prior"] for r in model.uniform_prior(df, 0.1, compat=True).collect()}
    assert 0 < len(on) < 4 and got == {k: 1 / len(on) if k in on else 0.0 for k in range(4)}
    pool = df.unionByName(spark.createDataFrame([(1, "y", 0, 9.0, [0.5, 0.5]), (2, "z", 0, 9.0, [0.1, 0.9])], df.schema))
    names = lambda early: [r["nn"] for r in model.nearest(df.filter("sense = 0"), pool, 2, early).orderBy("rank").collect()]
    # Of the three best, two are the head's own.
    assert names(False) == ["y"] and names(True) == ["y", "z"]


def _chain(spark):
    """Four senses: 0-1-2 chain by their neighbours' likeness, 3 joins last."""
    sim = {(0, 1): 0.9, (1, 2): 0.8, (0, 2): -0.5, (0, 3): 0.7, (1, 3): 0.75, (2, 3): 0.7}
    return spark.createDataFrame([("w", a, b, s) for (i, j), s in sim.items() for a, b in ((i, j), (j, i))], "word string, a int, b int, sim double")


def test_hierarchy_has_the_least_of_whole_nodes(spark):
    got = [(r["left"], r["right"], r["sim"], r["least"]) for r in model.hierarchy(_chain(spark)).orderBy("step").collect()]
    assert got == [("1", "0", 0.9, 0.9), ("1 0", "2", 0.8, -0.5), ("1 0 2", "3", 0.75, -0.5)]


def test_trees_in_print(spark):
    at = lambda d: [math.cos(d), math.sin(d)]
    rows = [(0, "w", 0, 9.0, at(0.0)), (0, "w", 1, 9.0, at(0.1)), (0, "w", 2, 9.0, at(1.0)), (0, "w", 3, 1.0, at(2.0)), (1, "v", 0, 9.0, at(1.1)), (2, "u", 0, 1.0, at(3.0))]
    df = spark.createDataFrame(rows, "word_id long, word string, sense int, cnt double, vec array<double>")
    near = spark.createDataFrame([("w", 2, 0.995, "v", 0, 1), ("w", 2, 0.5, "u", 0, 2)], "hw string, sn int, sim double, nn string, nn_sn int, rank long")
    got = {r["word"]: r["tree"].split("\n") for r in model.trees(df, near).collect()}
    assert got["v"] == ["#0 "] and set(got) == {"v", "w"}
    c = lambda d: f"{math.cos(d):.3f}d"
    assert got["w"] == [c(1.0), "    " + c(0.1), "        #1 ", "        #0 ", "    #2  v##0/0.995 u##0/0.500"]


def test_paths_in_print(spark):
    listed = spark.createDataFrame([(i, f) for i, f in enumerate([4, 2, 1])], "word_id long, freq long")
    got = {r["word_id"]: r["path"] for r in huffman.dump(huffman.path_table(spark, listed)).collect()}
    assert got == {w: " ".join(f"{n}:{c}" for n, c in p) for w, p in enumerate(huffman.paths([4, 2, 1]))}


def test_malformed_models_are_read_by_what_follows(tmp_path):
    """Counts that writers state wrongly, and words that are numbers."""
    words, dim = ["x", "7", "2", "2", "end"], 2
    paths = huffman.paths([5, 4, 3, 2, 1])
    pi = np.array([[1, 1, 0], [1, 0, 0], [0, 1, 1], [1, 1, 1], [1, 0, 1]], float)
    inner = np.arange(5 * 3 * dim, dtype=np.float32).reshape(5, 3, dim)
    path = str(tmp_path / "m")
    model_files.write_model(path, words, np.array([5, 4, 3, 2, 1]), paths, np.ones((5, 3)), inner, np.ones((5, dim)), 0.1, pi)
    right = model_files.read_model(path)
    data = open(path, "rb").read()
    assert data.count(b"x\n2\n1\n") == 1 and data.count(b"end\n2\n1\n") == 1
    for stated in (b"1", b"3"):
        open(path, "wb").write(data.replace(b"x\n2\n1\n", b"x\n" + stated + b"\n1\n").replace(b"end\n2\n1\n", b"end\n" + stated + b"\n1\n"))
        got = model_files.read_model(path, malformed=True)
        assert got["words"] == words and got["inner"].keys() == right["inner"].keys()
        assert all(np.array_equal(got["inner"][k], v) for k, v in right["inner"].items())
        with pytest.raises(ValueError):
            model_files.read_model(path)


def test_a_scan_explodes_the_documents_it_touches(spark):
    docs = spark.createDataFrame([(0, "de", "s", ["a", "b"]), (1, "de", "s", ["c"] * 5), (2, "en", "t", ["d", "e"])], "doc_id long, lang string, source string, words array<string>")
    placed = corpus.placed(docs)[0]
    for beg, end in ((0, 9), (1, 3), (7, 8), (2, 7), (4, 4), (9, 20)):
        got = sorted(r["pos"] for r in corpus.scan(placed, beg, end).collect())
        assert got == list(range(beg, min(end, 9)))


def test_p_values_are_areas(spark):
    """Student's t by its density's area, Mann-Kendall's by pairs and ties."""
    rng = np.random.default_rng(3)
    series = {w: np.round(rng.normal(size=n) + np.arange(n) * k, 1) for w, n, k in (("a", 6, 0.2), ("b", 9, 0.0), ("c", 12, -0.1))}
    df = spark.createDataFrame([(w, i, float(y), float(y)) for w, ys in series.items() for i, y in enumerate(ys)], "word string, epoch_no long, rel double, normed double")
    got = {r["word"]: r for r in trends.significance(df).collect()}
    for w, y in series.items():
        n = len(y)
        x = np.arange(n)
        slope, cut = np.polyfit(x, y, 1)
        t = slope / math.sqrt(((y - slope * x - cut) ** 2).sum() / (n - 2) / ((x - x.mean()) ** 2).sum())
        v = n - 2
        grid = np.linspace(-abs(t), abs(t), 200001)
        density = math.gamma((v + 1) / 2) / math.sqrt(v * math.pi) / math.gamma(v / 2) * (1 + grid**2 / v) ** (-(v + 1) / 2)
        assert got[w]["p_linear"] == pytest.approx(1 - np.trapezoid(density, grid), abs=1e-6)
        s = sum(np.sign(y[j] - y[i]) for i in range(n) for j in range(i + 1, n))
        tied = [list(y).count(u) for u in set(y)]
        var = (n * (n - 1) * (2 * n + 5) - sum(g * (g - 1) * (2 * g + 5) for g in tied)) / 18
        assert got[w]["p_mk"] == pytest.approx(math.erfc(max(abs(s) - 1, 0) / math.sqrt(2 * var)), abs=1e-9)


def test_training_query_has_the_whole_lexicon(spark):
    found = catalogue.queries()["train_smoke"](spark, DATA).toPandas()
    words = {r["word"] for r in lexicon.ranked_lexicon(catalogue._tokens(spark, DATA), 20).collect()}
    assert set(found["word"]) == words and len(found) == 3 * len(words)


def test_sampler_is_even(spark):
    """Five of fifty positions, 20,000 times: each is taken at a rate of 0.1."""
    occ = spark.range(20000).select(F.col("id").alias("hw"), F.explode(F.sequence(F.lit(0), F.lit(49))).alias("pos"))
    picked = lexicon.sample_positions(occ, 5, ["hw"]).groupBy("pos").count().toPandas()
    n = picked["count"].to_numpy()
    assert len(n) == 50 and n.sum() == 100000
    # The 0.9999 quantile of chi-squared with 49 degrees of freedom is 93.
    assert ((n - 2000) ** 2 / (2000 * 0.9)).sum() < 93


def test_model_file_round_trip(tmp_path):
    paths = huffman.paths([5, 3, 2])
    inner = np.arange(3 * 2 * 4, dtype=np.float32).reshape(3, 2, 4)
    pi = np.array([[0.9, 0.1], [1.0, 0.0], [0.5, 0.5]])
    model_files.write_model(str(tmp_path / "m"), ["x", "y", "z"], np.array([5, 3, 2]), paths, np.ones((3, 2)), inner, np.ones((3, 4)), 0.1, pi)
    got = model_files.read_model(str(tmp_path / "m"))
    assert got["words"] == ["x", "y", "z"] and got["paths"] == paths and set(got["inner"]) == {(0, 0), (0, 1), (1, 0), (2, 0), (2, 1)}
    assert np.array_equal(got["inner"][2, 1], inner[2, 1])


def test_significance_of_a_rising_series(spark):
    df = spark.createDataFrame([("w", i, float(i), float(i)) for i in range(10)] + [("v", i, float(i % 2), float(i % 2)) for i in range(10)], "word string, epoch_no long, rel double, normed double")
    got = {r["word"]: r for r in trends.significance(df).collect()}
    assert got["w"]["p_mk"] < 0.001 < got["v"]["p_mk"]


def test_stream_of_requests(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.txt").write_text("x\n")
    senses = spark.createDataFrame([(0, "x", 0, 9.0, [1.0, 0.0]), (1, "y", 0, 9.0, [0.9, 0.1]), (2, "z", 0, 9.0, [0.0, 1.0])], "word_id long, word string, sense int, cnt double, vec array<double>")
    stream = spark.readStream.schema("hw string").csv(str(tmp_path / "in"))
    requests.answer(stream, requests.nearest_reply(senses, senses, 1), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert [r["nn"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["y"]


def test_sinks_hold_what_was_written(spark, tmp_path):
    trend = spark.createDataFrame([(2, -45, 0.5), (1, 30, 0.01)], "word_id long, angle int, p double")
    model_files.write_trends(trend, str(tmp_path / "t"))
    data = (tmp_path / "t").read_bytes()
    assert data[:32].rstrip(b"\0") == model_files.TRENDS and len(data) == 32 + 2 * 9
    assert [struct.unpack_from("<Ibf", data, 32 + 9 * i)[:2] for i in range(2)] == [(1, 30), (2, -45)]
    graphs = spark.createDataFrame([(7, 0xFEDCBA98), (3, 1)], "word_id long, graph long")
    model_files.write_minigraphs(graphs, str(tmp_path / "g"))
    data = (tmp_path / "g").read_bytes()
    assert data[:32].rstrip(b"\0") == model_files.MINIGRAPHS and struct.unpack("<IIII", data[32:]) == (3, 1, 7, 0xFEDCBA98)
    ranges = [(0, 5), (9, 2**40)]
    model_files.write_ranges(spark.createDataFrame(ranges[::-1], "beg long, end long"), str(tmp_path / "r"))
    assert [tuple(r) for r in model_files.read_ranges(spark, str(tmp_path / "r")).orderBy("beg").collect()] == ranges


def test_vectors_are_padded_and_normalised(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b##0", 0.25, 3, [0.0, 2.0, 0.0]), (0, "a##1", 0.75, 9, [3.0, 0.0, 4.0])], "row long, key string, prob double, frq long, vec array<double>")
    model_files.write_vectors(rows, str(tmp_path / "v"))
    found = np.frombuffer((tmp_path / "v" / "vectors.bvec32").read_bytes(), "<f4").reshape(2, 8)
    assert np.allclose(found, [[0.6, 0, 0.8, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0, 0, 0]])
    assert (tmp_path / "v" / "vectors.dic").read_text() == "2 8\na##1\nb##0\n"
    assert (tmp_path / "v" / "vectors.cnt").read_text() == "a##1\t0.75\t9\nb##0\t0.25\t3\n"


def test_lines_keep_quotes(spark, tmp_path):
    rows = spark.createDataFrame([('say "x', "a b"), ("y", "c")], "head string, context string")
    model_files.write_lines(rows, str(tmp_path / "l"), header=False)
    want = [('say "x', "a b"), ("y", "c")]
    assert sorted(map(tuple, model_files.read_lines(spark, str(tmp_path / "l"), ["head", "context"]).collect())) == want
    model_files.write_lines(rows, str(tmp_path / "l"))
    assert sorted(map(tuple, model_files.read_lines(spark, str(tmp_path / "l"), ["h", "c"], header=True).collect())) == want


def test_model_tables_of_a_file(spark, tmp_path):
    paths = huffman.paths([5, 3, 2])
    model_files.write_model(str(tmp_path / "m"), ["x", "y", "z"], np.array([5, 3, 2]), paths, np.ones((3, 2)), np.ones((3, 2, 4)), np.ones((3, 4)), 0.1, np.ones((3, 2)))
    tables = model_files.model_tables(spark, model_files.read_model(str(tmp_path / "m")))
    assert {k: t.count() for k, t in tables.items()} == {"lexicon": 3, "senses": 6, "nodes": 3, "hs_path": sum(map(len, paths))}


def test_ranks_follow_the_whole_order(spark):
    df = spark.createDataFrame([(f"w{i:04d}", 1 if i > 50 else 100 - i // 2) for i in range(2000)], "word string, freq long")
    got = [(r["word"], r["id"]) for r in lexicon.with_rank(df, "freq", [F.col("word").asc()], "id").collect()]
    want = sorted((-(1 if i > 50 else 100 - i // 2), f"w{i:04d}") for i in range(2000))
    assert sorted(got, key=lambda x: x[1]) == [(w, k) for k, (_, w) in enumerate(want)]
    assert lexicon.with_rank(df.limit(0), "freq", [F.col("word").asc()], "id").count() == 0


def test_overlapping_ranges_select_a_token_once(spark):
    tokens = spark.range(20).select(F.col("id").alias("pos"))
    ranges = spark.createDataFrame([(2, 8), (5, 10), (5, 10), (12, 12)], "beg long, end long")
    assert sorted(r["pos"] for r in corpus.within_ranges(tokens, ranges, 4, semi=True).collect()) == list(range(2, 10))


def test_tools_read_the_documents_few_times(spark, monkeypatch):
    """Scans of documents in all plans that a query runs, those of written tables included."""
    scans, write = [], store.materialise

    def counted(df):
        scans.append(df._jdf.queryExecution().sparkPlan().toString().count("documents.parquet"))
        return df

    for module in (catalogue, context, corpus, fixtures, lexicon, senses):
        monkeypatch.setattr(module, "materialise", lambda df, name: write(counted(df), name))
    for name, most in (("posterior", 4), ("sense_freqs_hard", 5), ("sketch_stats", 6)):
        scans.clear()
        counted(catalogue.queries()[name](spark, DATA))
        assert 0 < sum(scans) <= most, (name, scans)
