"""The registered queries: the operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensespark.functions import mathx
from sensespark.operators import context, distribution, huffman, lexicon, model, senses, training, trends
from sensespark.plans import oracle
from sensespark.sources import corpus, fixtures
from sensespark.sources.store import materialise

WINDOW = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.plain_tokens(corpus.documents(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return corpus.placed(corpus.documents(spark, sf_dir))


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query
def lexicon_topk(spark, sf_dir):
    return lexicon.ranked_lexicon(_tokens(spark, sf_dir), 20)


@query
def lexicon_prune_rank(spark, sf_dir):
    return lexicon.ranked_lexicon(_tokens(spark, sf_dir), 20, 10)


@query
def subsample_prob(spark, sf_dir):
    pruned = lexicon.ranked_lexicon(_tokens(spark, sf_dir), 20)
    return _round(lexicon.with_drop_probability(pruned, 1e-3).select("word", "freq", "p_drop"), "p_drop")


@query
def attr_joint_dist(spark, sf_dir):
    return distribution.attribute_counts(_tokens(spark, sf_dir), "lang", "source")


@query
def hit_type_dist(spark, sf_dir):
    return distribution.hits_by_type(_tokens(spark, sf_dir), fixtures.heads(fixtures.model(spark, sf_dir)), "lang")


@query
def hit_type_marginals(spark, sf_dir):
    return distribution.hit_marginals(_tokens(spark, sf_dir), fixtures.heads(fixtures.model(spark, sf_dir)), "lang", "source")


@query
def skip_filtered_hits(spark, sf_dir):
    kept = distribution.without(_tokens(spark, sf_dir), "lang:de,fr")
    return distribution.hits_by_type(kept, fixtures.heads(fixtures.model(spark, sf_dir)), "source")


@query
def subcorpus_tokens(spark, sf_dir):
    docs, structures = _placed(spark, sf_dir)
    ranges = structures.filter("lang = 'en'").select("beg", "end")
    return corpus.within_ranges(corpus.placed_tokens(docs).select("pos", "word"), ranges, semi=True).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


@query
def struct_merge_join(spark, sf_dir):
    docs, structures = _placed(spark, sf_dir)
    found = corpus.within_ranges(corpus.placed_tokens(docs).select("pos"), structures.select(F.col("doc_id").alias("struct_id"), "beg", "end"))
    return found.groupBy("struct_id", "beg", "end").agg(F.count(F.lit(1)).alias("n"))


@query
def epoch_natural_order(spark, sf_dir):
    found = trends.epochs(_tokens(spark, sf_dir), "source")
    key = F.array_join(mathx.natural_key(F.col("value")).cast("array<string>"), ", ")
    return found.select("value", "epoch_no", F.concat(F.lit("<"), key, F.lit(">")).alias("sort_key"))


@query
def epoch_norm_filter(spark, sf_dir):
    return trends.epochs(_tokens(spark, sf_dir), "source", 18000)


def _counts(spark, sf_dir):
    toks = _tokens(spark, sf_dir)
    return trends.word_epoch_counts(toks, fixtures.model(spark, sf_dir).lexicon, _epochs(toks), "source")


def _epochs(toks):
    """One row per epoch, written since it is read more than once."""
    return materialise(trends.epochs(toks, "source"), "epochs")


def _series(spark, sf_dir):
    """One row per word and epoch, written since pairs of epochs read it twice."""
    return materialise(trends.relative(_counts(spark, sf_dir)), "series")


@query
def word_epoch_freq(spark, sf_dir):
    return _counts(spark, sf_dir)


@query
def epoch_relative_freq(spark, sf_dir):
    return _round(_series(spark, sf_dir).select("word", "epoch_no", "normed", "rel"), "normed", "rel", digits=9)


@query
def trend_linreg(spark, sf_dir):
    return _round(trends.linear(_series(spark, sf_dir)).select("word", "slope"), "slope", digits=9)


@query
def trend_mann_kendall_s(spark, sf_dir):
    return trends.mann_kendall(_series(spark, sf_dir))


@query
def trend_theil_sen(spark, sf_dir):
    return _round(trends.theil_sen(_series(spark, sf_dir)).select("word", "slope"), "slope", digits=9)


@query
def trend_angle(spark, sf_dir):
    return trends.linear(_series(spark, sf_dir)).select("word", mathx.angle(F.col("slope"), F.col("epochs")).alias("angle"))


@query
def trend_minigraph(spark, sf_dir):
    return trends.graphs(_series(spark, sf_dir))


@query
def trend_significance(spark, sf_dir):
    return trends.significance(_series(spark, sf_dir))


@query
def order_year_trend(spark, sf_dir):
    """Fewer than eight epochs: order statuses by the year of the order."""
    orders = corpus.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("word"), F.date_format("o_orderdate", "yyyy").alias("year"))
    counted = trends.word_epoch_counts(orders, orders.select("word").distinct(), trends.epochs(orders, "year"), "year")
    return trends.graphs(trends.relative(counted))


@query
def sense_expected_pi(spark, sf_dir):
    m = fixtures.model(spark, sf_dir)
    return _round(model.expected_pi(m.senses, m.alpha).select("word_id", "sense", "pi"), "pi", digits=9)


@query
def active_senses(spark, sf_dir):
    m = fixtures.model(spark, sf_dir)
    return model.active(m.senses, m.alpha).groupBy("word_id").agg(F.count(F.lit(1)).alias("n_active"))


@query
def uniform_prior(spark, sf_dir):
    m = fixtures.model(spark, sf_dir)
    return _round(model.uniform_prior(m.senses, m.alpha).select("word_id", "sense", "log_prior"), "log_prior")


@query
def vector_norms(spark, sf_dir):
    return _round(fixtures.model(spark, sf_dir).senses.select("word_id", "sense", mathx.norm(F.col("vec")).alias("norm")), "norm")


def _head_senses(m):
    return m.senses.filter(F.col("word_id").isin(*fixtures.HEADS))


@query
def sense_cosine_matrix(spark, sf_dir):
    m = fixtures.model(spark, sf_dir)
    return _round(model.sense_similarities(_head_senses(m)), "sim")


def _nearest(spark, sf_dir):
    m = fixtures.model(spark, sf_dir)
    return model.nearest(model.active(_head_senses(m), m.alpha), m.senses.filter("cnt >= 5"))


@query
def nearest_long(spark, sf_dir):
    return _round(_nearest(spark, sf_dir), "sim")


@query
def nearest_compact(spark, sf_dir):
    return _round(model.compact(_nearest(spark, sf_dir)), "minsim", "maxsim")


@query
def model_export(spark, sf_dir):
    m = fixtures.model(spark, sf_dir)
    return _round(model.export(m.senses, m.alpha).select("row", "key", "prob", "frq"), "prob", digits=9)


def _occ(spark, sf_dir):
    m, (docs, _) = fixtures.model(spark, sf_dir), _placed(spark, sf_dir)
    toks = corpus.placed_tokens(docs)
    # What the tools start from, written since every step reads it.
    return m, docs, toks, materialise(context.occurrences(toks, fixtures.heads(m)), "occurrences")


def _surrounded(spark, sf_dir):
    """The model, the occurrences with their contexts, which are written since every step reads them, and the structures."""
    m, docs = fixtures.model(spark, sf_dir), corpus.documents(spark, sf_dir)
    begins = corpus.placed(docs, 2 * WINDOW)[1]
    return m, context.surrounded(docs, begins, fixtures.heads(m), 2 * WINDOW), docs, begins


@query
def kwic(spark, sf_dir):
    return context.kwic(_surrounded(spark, sf_dir)[1], None, 3)


@query
def kwic_glue(spark, sf_dir):
    """Lines with documents as the glue structure: no blank where one begins."""
    return context.kwic(_surrounded(spark, sf_dir)[1], None, 3, glued=True)


@query
def context_window_infer(spark, sf_dir):
    m, occ, _, _ = _surrounded(spark, sf_dir)
    return context.inference_window(occ, None, m.lexicon, WINDOW).withColumnRenamed("at", "pos")


@query
def context_window_train(spark, sf_dir):
    m = fixtures.model(spark, sf_dir)
    return context.training_counts(_tokens(spark, sf_dir), m.lexicon, WINDOW)


def _pair_scores(spark, sf_dir, fast):
    m = fixtures.model(spark, sf_dir)
    pairs = fixtures.heads(m).select("head_id").crossJoin(m.lexicon.select(F.col("word_id").alias("ctx_id")))
    return _round(context.pair_scores(pairs, m.senses, m.nodes, m.paths, fast), "score")


@query
def pair_score(spark, sf_dir):
    return _pair_scores(spark, sf_dir, False)


@query
def pair_score_fast(spark, sf_dir):
    return _pair_scores(spark, sf_dir, True)


def _posterior(spark, sf_dir):
    m, occ, docs, begins = _surrounded(spark, sf_dir)
    return m, occ, docs, begins, materialise(senses.occurrence_posteriors(occ, None, m, WINDOW), "posteriors")


@query
def posterior(spark, sf_dir):
    return _round(_posterior(spark, sf_dir)[4].withColumnRenamed("at", "pos"), "p")


def _rows(spark, sf_dir):
    m = fixtures.model(spark, sf_dir)
    rows = fixtures.context_rows(spark, sf_dir, m.words)
    return m, rows, *senses.row_contexts(rows, m.lexicon, WINDOW)


@query
def desamb_status(spark, sf_dir):
    return _rows(spark, sf_dir)[2].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _row_posteriors(m, found):
    # Read for the best sense and for the list of all.
    found = materialise(found, "row-contexts")
    scores = context.pair_scores(found.filter("ctx_id is not null").select("head_id", "ctx_id").distinct(), m.senses, m.nodes, m.paths)
    return materialise(context.posteriors(found, scores, senses.log_priors(m.senses, m.alpha), ["row_id"]), "row-posteriors")


@query
def desamb_rows(spark, sf_dir):
    m, _, status, found = _rows(spark, sf_dir)
    best = context.best_sense(_row_posteriors(m, found), ["row_id"])
    out = status.join(best.select("row_id", "sense", "p"), "row_id", "left")
    return _round(out.select("row_id", "status", F.concat(F.lit("c"), F.col("sense").cast("string")).alias("cluster"), "p"), "p")


@query
def desamb_table(spark, sf_dir):
    """The rows as given with all that the tool appends."""
    m, rows, status, found = _rows(spark, sf_dir)
    return _round(senses.disambiguated(rows, status, _row_posteriors(m, found), fixtures.SENSES), "p")


def _frequencies(spark, sf_dir, soft):
    _, occ, _, begins, post = _posterior(spark, sf_dir)
    lengths = begins.groupBy(F.col("source").alias("value")).agg(F.sum(F.col("end") - F.col("beg")).cast("double").alias("norm"))
    return senses.sense_frequencies(post, occ, materialise(trends.numbered(lengths), "epochs"), "source", fixtures.SENSES, soft)


@query
def sense_freqs_hard(spark, sf_dir):
    return _frequencies(spark, sf_dir, False)


@query
def sense_freqs_soft(spark, sf_dir):
    return _round(_frequencies(spark, sf_dir, True), *[f"s{k}" for k in range(fixtures.SENSES)], digits=4)


@query
def sense_concordance(spark, sf_dir):
    _, occ, _, _, post = _posterior(spark, sf_dir)
    return senses.concordance(post, occ, None, 0.9, 1.0, 20, 3)


def _head_sketches(occ, m):
    found = fixtures.sketches(occ, m.counts).filter("cnt >= 5 and rnk >= 2")
    return materialise(found.select("doc_id", "head_id", "head", "coll", "cnt", "rnk", "pos"), "sketches")


@query
def sketch_stats(spark, sf_dir):
    m, occ, _, _, post = _posterior(spark, sf_dir)
    found = senses.sketch_statistics(_head_sketches(occ, m), post, fixtures.SENSES)
    return _round(found.drop("dist"), "mean", "sd", "rnk", digits=4)


@query
def sketch_eval(spark, sf_dir):
    """The same statistics without a mask; collocates of an even count have a longest match of three words."""
    m, occ, _, _, post = _posterior(spark, sf_dir)
    lcm = F.when(F.col("cnt") % 2 == 0, F.array("head", "coll", "coll")).otherwise(F.array("coll"))
    rows = _head_sketches(occ, m).withColumn("lcm", lcm)
    return _round(senses.sketch_evaluation(rows, post), "mean", "sd", "rnk", digits=4)


@query
def sketch_sample(spark, sf_dir):
    """The statistics over at most ten positions of each collocate."""
    m, occ, _, _, post = _posterior(spark, sf_dir)
    rows = lexicon.sample_positions(_head_sketches(occ, m), 10, ["head_id", "coll"])
    return _round(senses.sketch_statistics(rows, post, fixtures.SENSES).drop("dist"), "mean", "sd", "rnk", digits=4)


@query
def sketch_overlap(spark, sf_dir):
    """Documents that two collocates of a head have in common."""
    m, occ, _, _ = _surrounded(spark, sf_dir)
    rows = _head_sketches(occ, m).filter("cnt >= 10").select("head_id", "coll", "doc_id").distinct()
    other = rows.select("head_id", F.col("coll").alias("other"), "doc_id")
    return rows.join(other, ["head_id", "doc_id"]).filter("coll < other").groupBy("head_id", "coll", "other").agg(F.count(F.lit(1)).alias("n_shared"))


@query
def sample_positions(spark, sf_dir):
    occ = _occ(spark, sf_dir)[3]
    return lexicon.sample_positions(occ.select("hw", "pos"), 100, ["hw"])


@query
def sense_hierarchy(spark, sf_dir):
    return model.hierarchy(model.sense_similarities(fixtures.model(spark, sf_dir).senses))


@query
def sense_tree(spark, sf_dir):
    m = fixtures.model(spark, sf_dir)
    return model.trees(_head_senses(m), _nearest(spark, sf_dir))


@query
def huffman_dump(spark, sf_dir):
    # The fixture's tree is a heap, whose nodes are numbered by depth.
    return huffman.dump(fixtures.model(spark, sf_dir).paths.withColumn("depth", F.col("node_id")))


@query
def range_scan(spark, sf_dir):
    """A stretch of the corpus: the positions of its second to fifth thousand."""
    return corpus.scan(_placed(spark, sf_dir)[0], 1000, 5000).select("pos", "doc_id", "word")


@query
def huffman_codes(spark, sf_dir):
    return huffman.path_table(spark, fixtures.model(spark, sf_dir).lexicon)


@query
def train_smoke(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    words = lexicon.ranked_lexicon(corpus.plain_tokens(docs), 20)
    options = training.Options(dim=16, senses=3, window=2, epochs=1)
    state, _ = training.train_documents(docs, words, options)
    return model.expected_pi(training.sense_table(docs, state, words), options.alpha).select("word", "sense", "cnt", "pi")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
