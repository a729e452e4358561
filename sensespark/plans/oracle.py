"""DuckDB SQL for the registered queries, over the same tables."""

from __future__ import annotations

_PRELUDE = r"""
WITH RECURSIVE d AS (SELECT doc_id, lang, source, string_split_regex(lower(trim(text)), '\s+') AS words FROM documents),
st AS (SELECT doc_id, lang, source, words, coalesce(sum(len(words)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS beg FROM d),
tok AS MATERIALIZED (SELECT doc_id, lang, source, unnest(words) AS word, unnest(range(len(words)))::INT AS tok_ix, beg + unnest(range(len(words))) AS pos FROM st),
lexall AS (SELECT word, count(*) AS freq FROM tok GROUP BY word),
vs AS (SELECT count(*) // 5 AS v FROM embeddings),
lex AS MATERIALIZED (SELECT row_number() OVER (ORDER BY freq DESC, word) - 1 AS word_id, word, freq FROM lexall QUALIFY word_id < (SELECT v FROM vs)),
sen AS MATERIALIZED (SELECT vec_id // 5 AS word_id, word, (vec_id % 5)::INT AS sense, embedding::DOUBLE[] AS vec,
  freq * CASE (vec_id // 5) % 3 WHEN 0 THEN [0.5, 0.3, 0.15, 0.05, 0]::DOUBLE[] WHEN 1 THEN [0.7, 0.3, 0, 0, 0]::DOUBLE[] ELSE [1, 0, 0, 0, 0]::DOUBLE[] END[vec_id % 5 + 1] AS cnt
  FROM embeddings JOIN lex ON lex.word_id = vec_id // 5),
later AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY word_id ORDER BY sense ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS ts FROM sen),
stick AS (SELECT *, CASE WHEN sense = 4 THEN 1.0::DOUBLE ELSE (1 + cnt) / (1 + cnt + 0.1::DOUBLE + ts) END AS m FROM later),
pis AS MATERIALIZED (SELECT *, m * exp(coalesce(sum(CASE WHEN sense < 4 THEN ln(1 - m) END) OVER (PARTITION BY word_id ORDER BY sense ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS pi FROM stick),
heads AS (SELECT word_id AS head_id, word AS hw FROM lex WHERE word_id IN (6, 19, 50)),
hsteps AS (SELECT word_id, (v + word_id)::BIGINT AS h, unnest(range(1, 40)) AS dd FROM lex, vs),
hs AS MATERIALIZED (SELECT word_id, (h >> dd) - 1 AS node_id, ((h >> (dd - 1)) & 1)::INT AS code FROM hsteps WHERE (h >> dd) >= 1),
nodes AS (SELECT vec_id AS node_id, embedding::DOUBLE[] AS vec FROM embeddings, vs WHERE vec_id < v - 1),
crows AS (SELECT conv_id * 1000 + turn AS row_id, text FROM conversations),
crow AS MATERIALIZED (SELECT row_id, CASE WHEN row_id % 5 <> 0 THEN row_id % v END AS head_id, CASE WHEN row_id % 7 = 0 THEN '' WHEN row_id % 7 = 1 THEN 'qqq xxx qqq' ELSE lower(text) END AS context FROM crows, vs),
rowheads AS (SELECT DISTINCT head_id FROM crow WHERE head_id IS NOT NULL),
dots AS MATERIALIZED (SELECT s.word_id AS head_id, s.sense, n.node_id, list_dot_product(s.vec, n.vec) AS dot FROM sen s, nodes n WHERE s.word_id IN (SELECT head_id FROM heads) OR s.word_id IN (SELECT head_id FROM rowheads)),
steps AS (SELECT head_id, hs.word_id AS ctx_id, sense, (1 - 2 * code) * dot AS x FROM dots JOIN hs USING (node_id)),
scores AS MATERIALIZED (SELECT head_id, ctx_id, sense, sum(CASE WHEN x >= 0 THEN -ln(1 + exp(-x)) ELSE x - ln(1 + exp(x)) END) AS score FROM steps GROUP BY ALL),
occ AS MATERIALIZED (SELECT head_id, hw, pos, doc_id, lang, source FROM tok JOIN heads ON word = hw),
win AS MATERIALIZED (SELECT head_id, hw, apos, delta, ctx_id FROM (SELECT o.head_id, o.hw, o.pos AS apos, (t.pos - o.pos)::INT AS delta, l.word_id AS ctx_id,
  row_number() OVER (PARTITION BY o.head_id, o.pos, t.pos > o.pos ORDER BY abs(t.pos - o.pos)) AS r
  FROM (SELECT head_id, hw, pos, unnest(range(-8, 9)) AS o FROM occ) o JOIN tok t ON t.pos = o.pos + o.o AND o.o <> 0 JOIN lex l ON l.word = t.word) WHERE r <= 4),
pz AS (SELECT o.head_id, o.pos AS apos, p.sense, max(ln(p.pi)) + coalesce(sum(s.score), 0) AS z FROM occ o JOIN pis p ON p.word_id = o.head_id AND p.pi >= 1e-3
  LEFT JOIN win w ON w.head_id = o.head_id AND w.apos = o.pos LEFT JOIN scores s ON s.head_id = o.head_id AND s.ctx_id = w.ctx_id AND s.sense = p.sense GROUP BY ALL),
pw AS (SELECT *, exp(z - max(z) OVER (PARTITION BY apos)) AS w FROM pz),
post AS MATERIALIZED (SELECT apos, head_id, sense, w / sum(w) OVER (PARTITION BY apos) AS p FROM pw),
best AS (SELECT apos, head_id, sense, round(p, 9) AS p FROM post QUALIFY row_number() OVER (PARTITION BY apos ORDER BY round(p, 9) DESC, sense DESC) = 1),
norms AS (SELECT source AS value, count(*)::DOUBLE AS norm FROM tok GROUP BY 1),
ep AS MATERIALIZED (SELECT value, norm, row_number() OVER (ORDER BY list_transform(regexp_split_to_array(value, '[^0-9]'), lambda x: CASE WHEN x = '' THEN 0 ELSE x::BIGINT END), value) - 1 AS epoch_no
  FROM norms WHERE value IS NOT NULL AND norm >= floor((SELECT avg(norm) FROM norms) * 0.15)),
wc AS (SELECT word, source AS value, count(*) AS n FROM tok WHERE word IN (SELECT word FROM lex) GROUP BY ALL),
we AS (SELECT l.word, e.epoch_no, e.norm, coalesce(n, 0) AS n FROM lex l CROSS JOIN ep e LEFT JOIN wc ON wc.word = l.word AND wc.value = e.value),
nr AS (SELECT *, n::DOUBLE / norm AS normed, count(*) OVER (PARTITION BY word) AS epochs FROM we),
tt AS (SELECT *, sum(normed) OVER (PARTITION BY word) AS total FROM nr),
ser AS MATERIALIZED (SELECT word, epoch_no, normed, epochs, epochs * normed / total AS rel FROM tt WHERE total > 0),
pr AS (SELECT a.word, a.epoch_no AS i, b.epoch_no AS j, a.normed AS ni, b.normed AS nj, a.rel AS ri, b.rel AS rj FROM ser a JOIN ser b ON a.word = b.word AND a.epoch_no < b.epoch_no),
kept AS (SELECT apos, head_id, sense, round(p, 6) AS p FROM best),
cs AS (SELECT row_id, head_id, word AS hw, list_filter(string_split_regex(trim(context), '\s+'), lambda x: x <> '') AS toks FROM crow JOIN lex ON word_id = head_id),
cu AS (SELECT row_id, head_id, hw, unnest(toks) AS word, unnest(range(len(toks))) AS i, len(toks) // 2 AS mid FROM cs),
ca AS (SELECT row_id, min_by(i, abs(i - mid) * 100000 + i) AS anchor FROM cu WHERE word = hw GROUP BY 1),
cx AS (SELECT cu.*, anchor, coalesce(anchor, mid) AS c, CASE WHEN anchor IS NULL THEN i >= mid ELSE i > anchor END AS r, l.word_id AS ctx_id FROM cu LEFT JOIN ca USING (row_id) LEFT JOIN lex l ON l.word = cu.word WHERE cu.word <> hw),
cy AS (SELECT *, coalesce(sum((ctx_id IS NOT NULL)::INT) OVER (PARTITION BY row_id, r ORDER BY abs(i - c) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cx),
cz AS MATERIALIZED (SELECT * FROM cy WHERE before < 4),
cstat AS MATERIALIZED (SELECT crow.row_id, crow.head_id, CASE WHEN crow.head_id IS NULL THEN 'nhead' ELSE CASE WHEN coalesce(seen, 0) = 0 THEN 'noctx' WHEN valid = 0 THEN 'unctx' ELSE 'allok' END || CASE WHEN anchor IS NULL THEN '_mw' ELSE '_hw' END END AS status
  FROM crow LEFT JOIN ca USING (row_id) LEFT JOIN (SELECT row_id, count(ctx_id) AS valid, count(*) AS seen FROM cz GROUP BY 1) USING (row_id)),
cpz AS (SELECT c.row_id, p.sense, max(ln(p.pi)) + coalesce(sum(s.score), 0) AS z FROM cs c JOIN pis p ON p.word_id = c.head_id AND p.pi >= 1e-3
  LEFT JOIN cz ON cz.row_id = c.row_id AND cz.ctx_id IS NOT NULL LEFT JOIN scores s ON s.head_id = c.head_id AND s.ctx_id = cz.ctx_id AND s.sense = p.sense GROUP BY ALL),
cpw AS (SELECT *, exp(z - max(z) OVER (PARTITION BY row_id)) AS w FROM cpz),
cpost AS (SELECT row_id, sense, w / sum(w) OVER (PARTITION BY row_id) AS p FROM cpw),
nxt AS (SELECT doc_id, pos, word AS head, lead(word) OVER (PARTITION BY doc_id ORDER BY tok_ix) AS coll FROM tok),
sk AS MATERIALIZED (SELECT doc_id, pos, head, coll, cnt, 14 + log2(2.0::DOUBLE * cnt / (x.freq + y.freq)) AS rnk FROM (SELECT *, count(*) OVER (PARTITION BY head, coll) AS cnt FROM nxt WHERE coll IS NOT NULL)
  JOIN lexall x ON x.word = head JOIN lexall y ON y.word = coll WHERE cnt >= 5),
hk AS MATERIALIZED (SELECT sk.*, head_id FROM sk JOIN heads ON hw = head WHERE rnk >= 2),
near AS (SELECT q.word_id AS q_id, q.word AS hw, q.sense AS sn, p.word_id, p.word AS nn, p.sense AS nn_sn, round(list_dot_product(q.vec, p.vec) / sqrt(list_dot_product(q.vec, q.vec)) / sqrt(list_dot_product(p.vec, p.vec)), 9) AS sim
  FROM pis q, sen p WHERE q.word_id IN (6, 19, 50) AND q.pi >= 1e-3 AND p.cnt >= 5),
topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, sn ORDER BY sim DESC, word_id, nn_sn) AS r FROM near) WHERE r <= 11 AND q_id <> word_id),
nearest AS (SELECT hw, sn, sim, nn, nn_sn, row_number() OVER (PARTITION BY q_id, sn ORDER BY r) AS rank FROM topk QUALIFY rank <= 10),
"""

_EACH = {
    "lexicon_topk": "q AS (SELECT row_number() OVER (ORDER BY freq DESC, word) - 1 AS word_id, word, freq FROM lexall WHERE freq >= 20)",
    "lexicon_prune_rank": "q AS (SELECT row_number() OVER (ORDER BY freq DESC, word) - 11 AS word_id, word, freq FROM lexall WHERE freq >= 20 QUALIFY word_id >= 0)",
    "subsample_prob": "q AS (SELECT word, freq, round(greatest(1 - sqrt(1e-3::DOUBLE * sum(freq) OVER () / freq), 0), 6) AS p_drop FROM lexall WHERE freq >= 20)",
    "attr_joint_dist": "q AS (SELECT lang, source, count(*) AS n FROM tok GROUP BY ALL)",
    "hit_type_dist": "q AS (SELECT hw, tt, norm, count(t.word) AS total FROM heads CROSS JOIN (SELECT lang AS tt, count(*) AS norm FROM tok GROUP BY 1) LEFT JOIN tok t ON t.word = hw AND t.lang = tt GROUP BY ALL)",
    "hit_type_marginals": "q AS (SELECT hw, lang AS tt, source AS epoch, count(*) AS total FROM occ GROUP BY GROUPING SETS ((hw, lang), (hw, source)))",
    "skip_filtered_hits": "s AS (SELECT * FROM tok WHERE lang NOT IN ('de', 'fr')), q AS (SELECT hw, tt, norm, count(t.word) AS total FROM heads CROSS JOIN (SELECT source AS tt, count(*) AS norm FROM s GROUP BY 1) LEFT JOIN s t ON t.word = hw AND t.source = tt GROUP BY ALL)",
    "subcorpus_tokens": "q AS (SELECT word, count(*) AS freq FROM tok WHERE lang = 'en' GROUP BY 1)",
    "struct_merge_join": "q AS (SELECT doc_id AS struct_id, beg, beg + len(words) AS \"end\", len(words)::BIGINT AS n FROM st)",
    "epoch_natural_order": "q AS (SELECT value, epoch_no, '<' || array_to_string(list_transform(regexp_split_to_array(value, '[^0-9]'), lambda x: CASE WHEN x = '' THEN 0 ELSE x::BIGINT END), ', ') || '>' AS sort_key FROM ep)",
    "epoch_norm_filter": "q AS (SELECT value, row_number() OVER (ORDER BY epoch_no) - 1 AS epoch_no, norm FROM ep WHERE norm >= 18000)",
    "word_epoch_freq": "q AS (SELECT word, epoch_no, norm, n FROM we)",
    "epoch_relative_freq": "q AS (SELECT word, epoch_no, round(normed, 9) AS normed, round(rel, 9) AS rel FROM ser)",
    "trend_linreg": "q AS (SELECT word, round(regr_slope(rel, epoch_no), 9) AS slope FROM ser GROUP BY 1)",
    "trend_mann_kendall_s": "q AS (SELECT word, sum(sign(nj - ni))::BIGINT AS s FROM pr GROUP BY 1)",
    "trend_theil_sen": "q AS (SELECT word, round(quantile_cont((rj - ri) / (j - i), 0.5), 9) AS slope FROM pr GROUP BY 1)",
    "trend_angle": "q AS (SELECT word, round(atan(regr_slope(rel, epoch_no) * (max(epochs) - 1)) * 180 / 3.141592)::INT AS angle FROM ser GROUP BY 1)",
    "trend_minigraph": "l AS (SELECT word, list(rel ORDER BY epoch_no) AS x FROM ser GROUP BY 1), g AS (SELECT word, unnest(range(8)) AS i, x FROM l), q AS (SELECT word, sum(least(floor(round(x[(i * len(x)) // 8 + 1], 9) * 6), 15)::BIGINT << (4 * i)::BIGINT)::BIGINT AS graph FROM g GROUP BY 1)",
    "order_year_trend": "o AS (SELECT o_orderpriority AS word, strftime(o_orderdate, '%Y') AS y FROM orders), yn AS (SELECT y, count(*)::DOUBLE AS norm FROM o GROUP BY 1), ye AS (SELECT *, row_number() OVER (ORDER BY y) - 1 AS e FROM yn WHERE norm >= floor((SELECT avg(norm) FROM yn) * 0.15)), yc AS (SELECT word, y, count(*) AS n FROM o GROUP BY ALL), yw AS (SELECT w.word, e, coalesce(n, 0)::DOUBLE / norm AS normed FROM (SELECT DISTINCT word FROM o) w CROSS JOIN ye LEFT JOIN yc ON yc.word = w.word AND yc.y = ye.y), yr AS (SELECT word, e, count(*) OVER (PARTITION BY word) * normed / sum(normed) OVER (PARTITION BY word) AS rel FROM yw), l AS (SELECT word, list(rel ORDER BY e) AS x FROM yr GROUP BY 1), g AS (SELECT word, unnest(range(8)) AS i, x FROM l), q AS (SELECT word, sum(least(floor(round(x[(i * len(x)) // 8 + 1], 9) * 6), 15)::BIGINT << (4 * i)::BIGINT)::BIGINT AS graph FROM g GROUP BY 1)",
    "sense_expected_pi": "q AS (SELECT word_id, sense, round(pi, 9) AS pi FROM pis)",
    "active_senses": "q AS (SELECT word_id, count(*) AS n_active FROM pis WHERE pi >= 1e-3 GROUP BY 1)",
    "uniform_prior": "q AS (SELECT word_id, sense, round(-ln(count(*) OVER (PARTITION BY word_id)), 6) AS log_prior FROM pis WHERE pi >= 1e-3)",
    "vector_norms": "q AS (SELECT word_id, sense, round(sqrt(list_dot_product(vec, vec)), 6) AS norm FROM sen)",
    "sense_cosine_matrix": "h AS (SELECT * FROM sen WHERE word_id IN (6, 19, 50) AND cnt >= 5), q AS (SELECT x.word, x.sense AS a, y.sense AS b, round(list_dot_product(x.vec, y.vec) / (sqrt(list_dot_product(x.vec, x.vec)) * sqrt(list_dot_product(y.vec, y.vec))), 6) AS sim FROM h x JOIN h y ON x.word_id = y.word_id AND x.sense <> y.sense)",
    "nearest_long": "q AS (SELECT hw, sn, round(sim, 6) AS sim, nn, nn_sn, rank FROM nearest)",
    "nearest_compact": "q AS (SELECT hw, sn, string_agg(nn || '##' || nn_sn, ' ' ORDER BY rank) AS nn, round(min(sim), 6) AS minsim, round(max(sim), 6) AS maxsim FROM nearest GROUP BY 1, 2)",
    "model_export": "q AS (SELECT row_number() OVER (ORDER BY floor(cnt)::BIGINT DESC, word_id DESC, sense DESC) - 1 AS row, word || '##' || sense AS key, round(pi, 9) AS prob, floor(cnt)::BIGINT AS frq FROM pis WHERE pi >= 1e-3)",
    "kwic": "k AS (SELECT o.hw, o.pos, t.pos - o.pos AS delta, t.word FROM occ o JOIN tok t ON t.pos BETWEEN o.pos - 3 AND o.pos + 3 AND t.pos <> o.pos), q AS (SELECT hw, pos, hw AS kw, coalesce(string_agg(word, ' ' ORDER BY delta) FILTER (delta < 0), '') AS lctx, coalesce(string_agg(word, ' ' ORDER BY delta) FILTER (delta > 0), '') AS rctx FROM k GROUP BY hw, pos)",
    "kwic_glue": "k AS (SELECT o.hw, o.pos, t.pos - o.pos AS delta, t.word, CASE WHEN t.pos IN (SELECT beg FROM st) THEN '' ELSE ' ' END AS gap FROM occ o JOIN tok t ON t.pos BETWEEN o.pos - 3 AND o.pos + 3), g AS (SELECT *, CASE WHEN delta = min(delta) OVER (PARTITION BY hw, pos) THEN '' ELSE gap END AS sep FROM k), q AS (SELECT hw, pos, hw AS kw, coalesce(string_agg(sep || word, '' ORDER BY delta) FILTER (delta < 0), '') || max(sep) FILTER (delta = 0) AS lctx, coalesce(string_agg(sep || word, '' ORDER BY delta) FILTER (delta > 0), '') AS rctx FROM g GROUP BY hw, pos)",
    "context_window_infer": "q AS (SELECT head_id, hw, apos AS pos, delta, ctx_id FROM win)",
    "context_window_train": "n AS (SELECT doc_id, word_id, row_number() OVER (PARTITION BY doc_id ORDER BY tok_ix) - 1 AS i FROM tok JOIN lex USING (word)), s AS (SELECT doc_id, i, word_id, unnest(range(-4, 4))::INT AS delta FROM n), q AS (SELECT s.word_id, n.word_id AS ctx_id, delta, count(*) AS n FROM s JOIN n ON n.doc_id = s.doc_id AND n.i = s.i + delta WHERE delta <> 0 GROUP BY ALL)",
    "pair_score": "q AS (SELECT head_id, ctx_id, sense, round(score, 6) AS score FROM scores WHERE head_id IN (6, 19, 50))",
    "pair_score_fast": "c AS (SELECT *, (x + 8) * 4095 / 16 AS t, least(floor((x + 8) * 4095 / 16), 4094) AS i FROM steps WHERE head_id IN (6, 19, 50)), e AS (SELECT *, -ln(1 + exp(8 - i * 16 / 4095)) AS a, -ln(1 + exp(8 - (i + 1) * 16 / 4095)) AS b FROM c), q AS (SELECT head_id, ctx_id, sense, round(sum(CASE WHEN x >= 8 THEN 0 WHEN x <= -8 THEN x ELSE a + (b - a) * (t - i) END), 6) AS score FROM e GROUP BY ALL)",
    "huffman_dump": "q AS (SELECT word_id, string_agg(node_id || ':' || code, ' ' ORDER BY node_id) AS path FROM hs GROUP BY 1)",
    "range_scan": "q AS (SELECT pos, doc_id, word FROM tok WHERE pos >= 1000 AND pos < 5000)",
    "posterior": "q AS (SELECT apos AS pos, head_id, sense, round(p, 6) AS p FROM post)",
    "desamb_status": "q AS (SELECT status, count(*) AS n FROM cstat GROUP BY 1)",
    "desamb_rows": "b AS (SELECT row_id, sense, round(p, 9) AS p FROM cpost QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(p, 9) DESC, sense DESC) = 1), q AS (SELECT c.row_id, status, 'c' || sense AS cluster, round(p, 6) AS p FROM cstat c LEFT JOIN b USING (row_id))",
    "desamb_table": "b AS (SELECT row_id, sense, round(p, 9) AS p FROM cpost QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY round(p, 9) DESC, sense DESC) = 1), n AS (SELECT row_id, count(*) AS nsenses FROM cpost GROUP BY 1), a AS (SELECT n.row_id, string_agg(k || ':' || printf('%.2f', round(coalesce(p, 0), 9)), ' ' ORDER BY k) AS cluster_probs FROM n CROSS JOIN range(5) r(k) LEFT JOIN cpost c ON c.row_id = n.row_id AND c.sense = k GROUP BY 1), q AS (SELECT crow.row_id, crow.head_id, context, status, 'c' || sense AS cluster, round(p, 6) AS p, cluster_probs, nsenses FROM crow JOIN cstat USING (row_id) LEFT JOIN b USING (row_id) LEFT JOIN a USING (row_id) LEFT JOIN n USING (row_id))",
    "sense_freqs_hard": "f AS (SELECT b.head_id, e.epoch_no, b.sense, 1.0::DOUBLE AS p FROM best b JOIN occ o ON o.head_id = b.head_id AND o.pos = b.apos JOIN ep e ON e.value = o.source), {pivot}",
    "sense_freqs_soft": "f AS (SELECT b.head_id, e.epoch_no, b.sense, b.p FROM post b JOIN occ o ON o.head_id = b.head_id AND o.pos = b.apos JOIN ep e ON e.value = o.source), {pivot}",
    "sense_concordance": "s AS (SELECT head_id, sense, p, min(apos) AS apos FROM kept WHERE p BETWEEN 0.9 AND 1.0 GROUP BY 1, 2, 3), c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY head_id, sense ORDER BY p DESC, apos) <= 20), k AS (SELECT hw, sense AS sn, p AS prob, apos AS pos, t.pos - apos AS delta, t.word FROM c JOIN heads USING (head_id) JOIN tok t ON t.pos BETWEEN apos - 3 AND apos + 3 AND t.pos <> apos), q AS (SELECT hw, sn, prob, pos, hw AS kw, coalesce(string_agg(word, ' ' ORDER BY delta) FILTER (delta < 0), '') AS lctx, coalesce(string_agg(word, ' ' ORDER BY delta) FILTER (delta > 0), '') AS rctx FROM k GROUP BY hw, sn, prob, pos)",
    "sketch_stats": "g AS (SELECT h.head_id, coll, cnt, rnk, h.pos AS apos, sense, p FROM hk h JOIN post ON post.head_id = h.head_id AND post.apos = h.pos), s AS (SELECT head_id, coll, cnt, rnk, sense, avg(p) AS mean, coalesce(stddev_samp(p), 0) AS sd FROM g GROUP BY ALL), c AS (SELECT head_id, coll, count(DISTINCT apos) AS n FROM g GROUP BY ALL), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY head_id, coll ORDER BY round(mean, 9) DESC, sense DESC) = 1), q AS (SELECT head_id, coll, cnt, round(rnk, 4) AS rnk, CASE WHEN mean < 0.6 OR n < 5 THEN '-' ELSE sense::VARCHAR END AS cluster, round(mean, 4) AS mean, round(sd, 4) AS sd, n FROM b JOIN c USING (head_id, coll))",
    "sketch_eval": "g AS (SELECT h.head_id, head, coll, cnt, rnk, sense, p FROM hk h JOIN post ON post.head_id = h.head_id AND post.apos = h.pos), s AS (SELECT head_id, head, coll, cnt, rnk, sense, avg(p) AS mean, coalesce(stddev_samp(p), 0) AS sd FROM g GROUP BY ALL), q AS (SELECT round(mean, 4) AS mean, round(sd, 4) AS sd, head_id, coll, cnt, round(rnk, 4) AS rnk, CASE WHEN cnt % 2 = 0 THEN head || ' ' || coll ELSE '' END AS label FROM s QUALIFY row_number() OVER (PARTITION BY head_id, coll ORDER BY round(mean, 9) DESC, sense DESC) = 1)",
    "sketch_overlap": "r AS (SELECT DISTINCT head_id, coll, doc_id FROM hk WHERE cnt >= 10), q AS (SELECT a.head_id, a.coll, b.coll AS other, count(*) AS n_shared FROM r a JOIN r b ON a.head_id = b.head_id AND a.doc_id = b.doc_id AND a.coll < b.coll GROUP BY ALL)",
}


def _pivot(digits: int) -> str:
    sums = ", ".join(f"round(coalesce(sum(p) FILTER (sense = {k}), 0), {digits}) AS s{k}" for k in range(5))
    return f"q AS (SELECT h.head_id, e.epoch_no, {sums}, e.norm FROM heads h CROSS JOIN ep e LEFT JOIN f ON f.head_id = h.head_id AND f.epoch_no = e.epoch_no GROUP BY h.head_id, e.epoch_no, e.norm)"


def statements() -> dict[str, str]:
    """One statement per query that SQL can express."""
    return {name: _PRELUDE + rest.replace("{pivot}", _pivot(4)) + " SELECT * FROM q" for name, rest in _EACH.items()}
