"""SQL of the queries, for an independent engine over the same tables."""

from __future__ import annotations

from ..functions.lexicon import BOOST_SPECIAL, BOOST_STOP, CONTRADICTION, STOP_WORDS, VERB_ENDINGS, FilterConfig


def _list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


C = FilterConfig()
_PHRASES = [p for ps in CONTRADICTION.values() for p in ps]
_HITS = lambda ps: " + ".join(f"contains(low, '{p}')::INT" for p in ps)

SEGMENTS = r"""docs AS (SELECT doc_id AS sample_id, list_filter(list_transform(regexp_split_to_array(
  regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda s: trim(s)), lambda s: s <> '') AS sents FROM documents),
segs AS (SELECT sample_id, i AS ord, sents[i + 1] AS sentence FROM (SELECT *, unnest(range(0, len(sents))) AS i FROM docs))"""
CANDIDATES = (
    SEGMENTS
    + r""", cand AS (SELECT s.sample_id, ord, sentence, sents[1] AS claim,
  list_distinct(list_transform(regexp_extract_all(sents[1], '[A-Z][a-z]{3,}'), lambda x: lower(x))) AS entities
  FROM segs s JOIN docs USING (sample_id) WHERE ord > 0)"""
)
WORDS = (
    CANDIDATES
    + r""", w0 AS (SELECT *, list_filter(regexp_split_to_array(trim(sentence), '[\s\p{Z}]+'), lambda x: x <> '') AS w,
  list_filter(regexp_split_to_array(trim(lower(claim)), '[\s\p{Z}]+'), lambda x: x <> '') AS cw, lower(sentence) AS low FROM cand),
words AS (SELECT *, list_distinct(list_transform(w, lambda x: lower(x))) AS s, list_distinct(cw) AS c FROM w0)"""
)
SCORES = (
    WORDS
    + f""", p0 AS (SELECT *, len(w) AS n,
  CASE WHEN len(w) < 3 THEN 0.2::DOUBLE WHEN len(w) < 5 THEN 0.5 WHEN len(w) <= 50 THEN 1 ELSE greatest(0.3, 1 - (len(w) - 50) * 0.01::DOUBLE) END AS length_score,
  len(list_filter(w, lambda x: length(x) > 2 AND NOT list_contains({_list(STOP_WORDS)}, lower(x)))) / greatest(len(w), 1) AS density,
  len(list_filter(w, lambda x: regexp_matches(lower(x), '({"|".join(VERB_ENDINGS)})$'))) > 0 AS verb,
  len(list_filter(w, lambda x: length(x) > 3)) > 0 AS noun,
  CASE WHEN len(w) = 0 THEN 0 ELSE 0.6::DOUBLE * len(list_distinct(w)) / len(w) + 0.4::DOUBLE * least(1, list_sum(list_transform(w, lambda x: length(x))) / len(w) / 8) END AS richness,
  len(list_intersect(s, c)) AS common, len(list_filter(list_intersect(s, c), lambda x: length(x) > 3)) AS common_long, len(list_filter(c, lambda x: length(x) > 3)) AS c_long,
  len(list_filter(range(1, greatest(len(cw) - 4, 1)), lambda i: contains(low, array_to_string(cw[i:i + 5], ' ')))) > 0 AS gram,
  len(list_filter(entities, lambda e: contains(low, e))) AS hits, len(entities) AS ne,
  {_HITS(_PHRASES)} AS contra FROM words),
p1 AS (SELECT *, CASE WHEN n < 3 THEN 0.3::DOUBLE WHEN verb AND noun THEN 0.8 WHEN verb OR noun THEN 0.5 ELSE 0.3 END AS structure FROM p0),
scored AS (SELECT *, round(least(1, 0.3::DOUBLE * length_score + 0.3::DOUBLE * density + 0.2::DOUBLE * structure + 0.2::DOUBLE * richness), 9) AS quality_score,
  round(least(1, (0.6::DOUBLE * CASE WHEN len(c) = 0 THEN 0 ELSE common / len(c) END + 0.4::DOUBLE * CASE WHEN c_long = 0 THEN 0 ELSE common_long / c_long END) + CASE WHEN gram THEN 0.3::DOUBLE ELSE 0 END), 9) AS relevance_score,
  round(CASE WHEN ne = 0 OR hits = 0 THEN 0 ELSE least(1, 0.6::DOUBLE * hits / ne + 0.4::DOUBLE * hits / ne) END, 9) AS entity_score,
  round(contra / {len(_PHRASES)}, 9) AS contradiction_score FROM p1)"""
)
STAGES = (
    SCORES
    + f""", s1 AS (SELECT * FROM scored WHERE quality_score >= {C.min_quality}),
a2 AS (SELECT *, count(*) OVER q AS m, count(*) FILTER (relevance_score >= {C.min_relevance}) OVER q AS k, row_number() OVER (PARTITION BY sample_id ORDER BY relevance_score DESC, ord) AS r FROM s1 WINDOW q AS (PARTITION BY sample_id)),
s2 AS (SELECT * EXCLUDE (m, k, r) REPLACE (CASE WHEN k = 0 THEN r ELSE ord END AS ord) FROM a2 WHERE relevance_score >= {C.min_relevance} OR (k = 0 AND r <= greatest(m // 2, 5))),
a3 AS (SELECT *, (relevance_score >= {C.bypass} OR entity_score >= {C.min_entity}) AND ne > 0 AS good FROM s2),
b3 AS (SELECT *, count(*) OVER q AS m, count(*) FILTER (good) OVER q AS k, row_number() OVER (PARTITION BY sample_id ORDER BY entity_score DESC, ord) AS r FROM a3 WINDOW q AS (PARTITION BY sample_id)),
s3 AS (SELECT * EXCLUDE (m, k, r, good) REPLACE (CASE WHEN k > 0 AND k < {C.min_entity_keep} THEN r ELSE ord END AS ord) FROM b3
  WHERE k = 0 OR CASE WHEN k < {C.min_entity_keep} THEN r <= greatest(m // 2, {C.min_entity_keep}) ELSE good END),
a4 AS (SELECT *, CASE WHEN contradiction_score <= {C.support} THEN 'support' WHEN contradiction_score >= {C.refute} THEN 'refute' END AS stance FROM s3),
b4 AS (SELECT *, count(stance) OVER (PARTITION BY sample_id) AS k FROM a4),
s4 AS (SELECT * EXCLUDE (k) FROM b4 WHERE stance IS NOT NULL OR k = 0),
a5 AS (SELECT *, round(least(1, 0.2::DOUBLE * quality_score + 0.3::DOUBLE * relevance_score + 0.2::DOUBLE * entity_score + 0.2::DOUBLE * (1 - contradiction_score)), 9) AS confidence_score
  FROM s4 QUALIFY row_number() OVER (PARTITION BY sample_id, sentence ORDER BY ord) = 1),
s5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY confidence_score DESC, ord) AS rank FROM a5) WHERE rank <= {C.max_final}),
cov AS (SELECT t.sample_id, context, coalesce(retrieved, 0) AS retrieved, round(coalesce(retrieved, 0) / greatest(context, 1) * 100, 2) AS coverage
  FROM (SELECT sample_id, count(*) AS context FROM cand GROUP BY 1) t LEFT JOIN (SELECT sample_id, count(*) AS retrieved FROM s5 GROUP BY 1) USING (sample_id))"""
)
TOKENS = (
    SEGMENTS
    + r""", tw AS (SELECT sample_id, ord, list_filter(regexp_split_to_array(trim(sentence), '[\s\p{Z}]+'), lambda x: x <> '') AS w FROM segs),
tokens AS (SELECT sample_id, ord, i - 1 AS idx, w[i] AS word, CASE WHEN regexp_matches(w[i], '^[0-9]+$') THEN 'M' WHEN regexp_matches(w[i], '^[A-Z]') THEN 'Np' ELSE 'N' END AS pos
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM tw)),
edges AS (SELECT DISTINCT sample_id, word, ord FROM tokens)"""
)
VECTORS = """v AS (SELECT vec_id // 64 AS sample_id, vec_id, label AS pos, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.sample_id, a.vec_id AS a_id, a.pos AS a_pos, b.vec_id AS b_id, b.pos AS b_pos, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.sample_id = b.sample_id AND a.vec_id < b.vec_id),
sem AS (SELECT * FROM pairs WHERE a_pos = b_pos AND similarity >= 0.1),
claims AS (SELECT sample_id, min(vec_id) AS claim_id, arg_min(v, vec_id) AS claim FROM v GROUP BY 1),
tc AS (SELECT v.sample_id, vec_id, round(list_cosine_similarity(v, claim), 6) AS similarity FROM v JOIN claims USING (sample_id) WHERE vec_id <> claim_id)"""

SQL = {
    "sentence_segments": f"WITH {SEGMENTS} SELECT sample_id, ord, sentence FROM segs",
    "text_normalize_dedup": rf"WITH {SEGMENTS} SELECT sample_id, ord, trim(regexp_replace(lower(sentence), '[\s\p{{Z}}]+', ' ', 'g')) AS dedup, trim(regexp_replace(replace(lower(sentence), '_', ' '), '[\s\p{{Z}}]+', ' ', 'g')) AS strong FROM segs",
    "text_normalize_basic": rf"WITH {SEGMENTS} SELECT sample_id, ord, trim(strip_accents(regexp_replace(lower(sentence), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) AS basic FROM segs",
    "quality_analysis": f"WITH {SCORES} SELECT sample_id, ord, n AS word_count, round(density, 9) AS density, round(structure, 9) AS structure, round(richness, 9) AS richness, round(quality_score, 6) AS quality_score FROM scored",
    "relevance_analysis": f"WITH {SCORES} SELECT sample_id, ord, common AS overlap_count, round(CASE WHEN c_long = 0 THEN 0 ELSE common_long / c_long END, 6) AS coherence, gram AS has_gram, round(relevance_score, 6) AS relevance_score FROM scored",
    "jaccard_overlap": f"WITH {SCORES} SELECT sample_id, ord, round(0.4::DOUBLE * CASE WHEN len(s) + len(c) - common = 0 THEN 0 ELSE common / (len(s) + len(c) - common) END + 0.6::DOUBLE * CASE WHEN len(c) = 0 THEN 0 ELSE common / len(c) END, 6) AS overlap_score FROM scored",
    "entity_analysis": f"WITH {SCORES} SELECT sample_id, ord, hits AS entities_found, ne AS entities_total, round(entity_score, 6) AS entity_score FROM scored",
    "contradiction_by_category": f"WITH {SCORES} SELECT sample_id, ord, {', '.join(f'{_HITS(ps)} AS {k}' for k, ps in CONTRADICTION.items())}, round(contradiction_score, 6) AS contradiction_score FROM scored",
    "keyword_boost": f"WITH {WORDS} SELECT sample_id, ord, round(least(2, 1 + 0.1::DOUBLE * len(list_filter(cw, lambda x: length(x) > 3 AND NOT list_contains({_list(BOOST_STOP)}, x) AND contains(low, x))) + 0.2::DOUBLE * ({' + '.join(f'''(contains(low, '{k}') OR contains(low, '{k.replace('_', ' ')}'))::INT''' for k in BOOST_SPECIAL)})), 6) AS boost FROM words",
    "stage1_quality": f"WITH {STAGES} SELECT sample_id, ord, sentence, quality_score FROM s1",
    "stage2_relevance": f"WITH {STAGES} SELECT sample_id, ord, sentence, relevance_score FROM s2",
    "stage3_entities": f"WITH {STAGES} SELECT sample_id, ord, sentence, entity_score FROM s3",
    "stage4_stance": f"WITH {STAGES} SELECT sample_id, ord, sentence, stance FROM s4",
    "cascade_full": f"WITH {STAGES} SELECT sample_id, rank, sentence, stance, confidence_score FROM s5",
    "cascade_stats": f"WITH {STAGES}, c AS ({' UNION ALL '.join(f'SELECT sample_id, {k} AS stage, count(*) AS n FROM {t} GROUP BY 1' for k, t in enumerate(('scored', 's1', 's2', 's3', 's4', 's5')))}), wide AS (SELECT sample_id, {', '.join(f'coalesce(max(n) FILTER (stage = {k}), 0) AS n{k}' for k in range(6))} FROM c GROUP BY 1) SELECT *, round((1 - n5 / n0) * 100, 6) AS filtering_rate FROM wide",
    "multi_path_aggregate": f"WITH {SCORES}, g AS (SELECT sample_id, trim(sentence) AS sentence, count(*) AS n, avg(quality_score) AS mean, min(quality_score) AS lo, max(quality_score) AS hi FROM scored GROUP BY 1, 2) SELECT sample_id, sentence, n, round(mean + CASE WHEN n > 1 THEN least(0.05::DOUBLE * ln(n), 0.2) ELSE 0 END, 6) AS score, round(hi - lo, 6) AS score_range FROM g",
    "normalized_dedup_rank": rf"WITH {SEGMENTS}, d AS (SELECT *, trim(regexp_replace(replace(lower(sentence), '_', ' '), '[\s\p{{Z}}]+', ' ', 'g')) AS norm FROM segs), f AS (SELECT * FROM d WHERE length(norm) > 10 QUALIFY row_number() OVER (PARTITION BY sample_id, norm ORDER BY ord) = 1) SELECT sample_id, ord, sentence, row_number() OVER (PARTITION BY sample_id ORDER BY ord) AS aggregation_rank FROM f",
    "graph_word_nodes": f"WITH {TOKENS} SELECT sample_id, word, arg_min(pos, ord * 1000000 + idx) AS pos, min(ord) AS first_ord FROM tokens GROUP BY 1, 2",
    "graph_structural_edges": f"WITH {TOKENS} SELECT * FROM edges",
    "graph_dependency_edges": f"WITH {TOKENS} SELECT t.sample_id, least(t.word, h.word) AS a, greatest(t.word, h.word) AS b, count(*) AS n FROM tokens t JOIN tokens h ON t.sample_id = h.sample_id AND t.ord = h.ord AND t.idx = h.idx + 1 GROUP BY 1, 2, 3",
    "graph_shared_words": f"WITH {TOKENS} SELECT sample_id, word, count(*) FILTER (ord > 0) AS sentences FROM edges GROUP BY 1, 2 HAVING bool_or(ord = 0) AND count(*) FILTER (ord > 0) > 0",
    "graph_stats": f"WITH {TOKENS}, pw AS (SELECT sample_id, word, count(*) AS degree FROM edges GROUP BY 1, 2), x AS (SELECT sample_id, count(*) AS words, sum(degree)::BIGINT AS edges, max(degree) AS max_degree FROM pw GROUP BY 1), y AS (SELECT sample_id, count(DISTINCT ord) AS sentences FROM edges WHERE ord > 0 GROUP BY 1) SELECT sample_id, words, edges, max_degree, coalesce(sentences, 0) AS sentences, round(words / greatest(coalesce(sentences, 0), 1), 6) AS words_per_sentence FROM x LEFT JOIN y USING (sample_id)",
    "phrase_islands": f"WITH {TOKENS}, o AS (SELECT *, idx - row_number() OVER (PARTITION BY sample_id, ord ORDER BY idx) AS island FROM tokens WHERE pos IN ('Np', 'M')), l AS (SELECT *, min(idx) FILTER (pos = 'Np') OVER (PARTITION BY sample_id, ord, island) AS led FROM o), r AS (SELECT sample_id, ord, island, string_agg(word, ' ' ORDER BY idx) AS phrase FROM l WHERE idx >= led GROUP BY 1, 2, 3) SELECT sample_id, lower(phrase) AS phrase, min(ord) AS first_ord, count(*) AS n FROM r WHERE length(phrase) > 2 GROUP BY 1, 2",
    "embedding_pairs": f"WITH {VECTORS} SELECT sample_id, a_id, b_id, similarity FROM pairs",
    "semantic_edges_same_class": f"WITH {VECTORS} SELECT a_id, b_id, similarity FROM sem",
    "embedding_knn": f"WITH {VECTORS}, b2 AS (SELECT a_id, a_pos, b_id, b_pos, similarity FROM pairs UNION ALL SELECT b_id, b_pos, a_id, a_pos, similarity FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY similarity DESC, b_id) AS rank FROM b2) SELECT a_id, b_id, rank, similarity FROM r WHERE rank <= 5 AND a_pos = b_pos AND similarity >= 0",
    "rerank_topk": f"WITH {VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY similarity DESC, vec_id) AS rank FROM tc) SELECT * FROM r WHERE rank <= 10",
    "level_filter": f"WITH {VECTORS}, r AS (SELECT *, count(*) FILTER (similarity >= 0.4) OVER (PARTITION BY sample_id) AS k, row_number() OVER (PARTITION BY sample_id ORDER BY similarity DESC, vec_id) AS r FROM tc) SELECT sample_id, vec_id, similarity FROM r WHERE CASE WHEN k < 5 THEN r <= 5 ELSE similarity >= 0.4 END",
    "similarity_buckets": f"WITH {VECTORS} SELECT sample_id, count(*) AS n, round(avg(similarity), 5) AS avg_similarity, max(similarity) AS max_similarity, min(similarity) AS min_similarity, count(*) FILTER (similarity < 0.2) AS low, count(*) FILTER (similarity >= 0.2 AND similarity < 0.5) AS middle, count(*) FILTER (similarity >= 0.5) AS high FROM sem GROUP BY 1",
    "threshold_recommendation": f"WITH {VECTORS} SELECT sample_id, vec_id, similarity, CASE WHEN similarity >= 0.9 THEN 0.85::DOUBLE WHEN similarity >= 0.8 THEN 0.75 WHEN similarity >= 0.7 THEN 0.65 WHEN similarity >= 0.6 THEN 0.55 ELSE 0.5 END AS threshold FROM tc",
    "coverage_stats": f"WITH {STAGES} SELECT * FROM cov",
    "coverage_histogram": f"WITH {STAGES}, b AS (SELECT CASE WHEN coverage <= 20 THEN '<=20' WHEN coverage <= 40 THEN '<=40' WHEN coverage <= 60 THEN '<=60' WHEN coverage <= 80 THEN '<=80' ELSE '>80' END AS bucket FROM cov), names(bucket) AS (VALUES ('<=20'), ('<=40'), ('<=60'), ('<=80'), ('>80')) SELECT bucket, count(b.bucket) AS n FROM names LEFT JOIN b USING (bucket) GROUP BY 1",
    "evidence_histogram": f"WITH {STAGES} SELECT retrieved, count(*) AS n FROM cov GROUP BY 1",
    "report_summary": f"WITH {STAGES} SELECT count(*) AS samples, round(count(*) FILTER (retrieved > 0) / count(*), 6) AS success_rate, "
    + ", ".join(f"round({'sum(' + c + ')' if f == 'sum' else f + '(' + c + ')'}, {2 if f == 'sum' else 5})::DOUBLE AS {f if f != 'avg' else 'mean'}_{c}" if f in ("sum", "avg", "median") else f"{f}({c}) AS {f}_{c}" for c in ("context", "retrieved", "coverage") for f in ("sum", "avg", "median", "min", "max"))
    + " FROM cov",
}

_NORM = lambda c: rf"trim(strip_accents(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')))"
ENTITIES = f"ent AS (SELECT sample_id, phrase AS entity, {_NORM('phrase')} AS en FROM ({SQL['phrase_islands']}) WHERE first_ord = 0)"
SQL |= {
    "entity_edges": f"""WITH {SEGMENTS}, {ENTITIES}, x AS (SELECT *, {_NORM('sentence')} AS sn FROM ent JOIN segs USING (sample_id))
SELECT sample_id, entity, ord, CASE WHEN ord = 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM x WHERE CASE WHEN ord = 0
  THEN contains(lower(sentence), lower(entity)) OR len(list_filter(string_split(lower(entity), ' '), lambda w: w <> '' AND contains(lower(sentence), w))) > 0
  ELSE contains(sn, en) OR contains(replace(lower(sentence), '_', ' '), replace(lower(entity), '_', ' '))
    OR (contains(en, ' ') AND len(list_filter(string_split(en, ' '), lambda w: length(w) > 2 AND NOT contains(sn, w))) = 0) END""",
    "entity_word_nodes": f"""WITH {TOKENS}, {ENTITIES}, n AS (SELECT sample_id, word, {_NORM('word')} AS wn, min(ord * 1000000 + idx) AS place FROM tokens GROUP BY ALL)
SELECT e.sample_id, entity, arg_min(word, place) AS word FROM ent e LEFT JOIN n ON e.sample_id = n.sample_id AND wn <> '' AND (contains(en, wn) OR contains(wn, en)) GROUP BY 1, 2""",
    "stance_tiers": f"""WITH {VECTORS}, o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY vec_id) AS i FROM v),
d AS (SELECT x.sample_id, x.vec_id AS ord, round(list_cosine_similarity(x.v, a.v) - list_cosine_similarity(x.v, b.v), 6) AS diff
  FROM o x JOIN o a ON x.sample_id = a.sample_id AND a.i = 1 JOIN o b ON x.sample_id = b.sample_id AND b.i = 2 WHERE x.i > 2),
r AS (SELECT *, max(abs(diff)) OVER q AS most, row_number() OVER (PARTITION BY sample_id ORDER BY diff, ord) AS lo, row_number() OVER (PARTITION BY sample_id ORDER BY diff DESC, ord DESC) AS hi FROM d WINDOW q AS (PARTITION BY sample_id)),
t AS (SELECT *, CASE WHEN most > {C.delta} THEN 2 WHEN most > {C.delta / 2} THEN 3 ELSE 4 END AS tier FROM r)
SELECT sample_id, ord, CASE WHEN tier = 4 THEN CASE WHEN lo = 1 THEN 'refute' ELSE 'support' END WHEN diff > 0 THEN 'support' ELSE 'refute' END AS stance, abs(diff) AS stance_score, tier::INT AS stance_tier
FROM t WHERE CASE tier WHEN 2 THEN abs(diff) > {C.delta} WHEN 3 THEN abs(diff) > {C.delta / 2} ELSE lo = 1 OR hi = 1 END""",
    "hybrid_merge": f"""WITH {SCORES}, n AS (SELECT *, trim(replace(lower(sentence), '_', ' ')) AS norm FROM scored),
d AS (SELECT sample_id, norm, arg_min(sentence, ord) AS sentence, arg_min(relevance_score, ord) AS score FROM n WHERE relevance_score >= {C.min_relevance} GROUP BY 1, 2),
b AS (SELECT sample_id, norm, arg_min(sentence, ord) AS sentence, arg_min(quality_score, ord) AS score FROM n WHERE quality_score >= 0.8 GROUP BY 1, 2)
SELECT sample_id, coalesce(d.sentence, b.sentence) AS sentence, round(CASE WHEN d.norm IS NULL THEN b.score WHEN b.norm IS NOT NULL AND d.score < 0.9 THEN least(d.score + 0.1::DOUBLE, 0.95) ELSE d.score END, 6) AS score,
  CASE WHEN d.norm IS NULL THEN 'beam_search_unique' WHEN b.norm IS NULL THEN 'direct' ELSE 'hybrid_both_methods' END AS source
FROM d FULL JOIN b USING (sample_id, norm)""",
}
