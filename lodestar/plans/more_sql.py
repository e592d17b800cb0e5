"""SQL of the queries over graph tables, entity lists, analyses and reports; with it, SQL of all queries."""

from __future__ import annotations

from ..functions.lexicon import CONTRADICTION, STOP_WORDS
from .sql import CANDIDATES, SCORES, SEGMENTS, SQL, STAGES, TOKENS, VECTORS, WORDS, C, _list

_REC = (
    TOKENS
    + r""", rec AS (SELECT sample_id FROM docs WHERE len(sents) > 1), t AS (SELECT * FROM tokens JOIN rec USING (sample_id)),
pl AS (SELECT sample_id, word, ord, idx, CASE WHEN ord = 0 THEN 1 ELSE 0 END AS phase, CASE WHEN ord = 0 THEN 0 ELSE ord - 1 END AS sent FROM t),
dep AS (SELECT DISTINCT a.sample_id, least(a.word, b.word) AS x, greatest(a.word, b.word) AS y FROM t a JOIN t b ON a.sample_id = b.sample_id AND a.ord = b.ord AND a.idx = b.idx + 1),
st AS (SELECT DISTINCT sample_id, word, ord FROM t)"""
)
_FIRST_STEP = (
    _REC
    + r""", low AS (SELECT sample_id, ord, list_distinct(list(lower(word))) AS ws FROM t GROUP BY 1, 2),
c AS (SELECT sample_id, ws FROM low WHERE ord = 0),
one AS (SELECT sample_id, word, row_number() OVER (PARTITION BY sample_id ORDER BY min(idx)) AS rank FROM t WHERE ord = 0 GROUP BY 1, 2 QUALIFY rank <= 10)"""
)
_NAMES = SEGMENTS + r""", names AS (SELECT sample_id, regexp_extract_all(sents[1], '[A-Z][a-z]{3,}') AS f, regexp_extract_all(sents[1], '[A-Za-z]{5,}') AS s FROM docs WHERE len(sents) > 0)"""
_STRICT = (
    STAGES.replace(f"quality_score >= {C.min_quality})", "quality_score >= 0.9)")
    .replace("SELECT *, len(w) AS n,", "SELECT *, len(w) AS n, (length(sentence) % 7) / 10 AS score,")
    .replace("(1 - contradiction_score)), 9) AS confidence_score", "(1 - contradiction_score) + 0.1::DOUBLE * score), 9) AS confidence_score")
)
_SUBJECT = "(starts_with(x, 'th') OR starts_with(x, 'un'))"
_HELD = "list_filter(entities, lambda e: contains(low, e))"
_MEANS = ", ".join(f"round(avg({c}_score), 6) AS avg_{c}_score" for c in ("quality", "relevance", "confidence"))
_RANGES = ", ".join(f"min({c}_score) AS min_{c}, max({c}_score) AS max_{c}, round(avg({c}_score), 6) AS avg_{c}" for c in ("quality", "relevance", "confidence"))
_FOUND = ", ".join(f"array_to_string(list_filter({_list(ps)}, lambda p: contains(low, p)), ',') AS {k}" for k, ps in CONTRADICTION.items())

SQL = SQL | {
    "graph_counts": f"""WITH {_REC}, w AS (SELECT sample_id, count(DISTINCT word) AS word_nodes, count(DISTINCT ord) FILTER (ord > 0) AS sentence_nodes, count(DISTINCT ord) FILTER (ord = 0) AS claim_nodes FROM t GROUP BY 1),
e AS (SELECT sample_id, count(*) AS structural_edges FROM st GROUP BY 1), q AS (SELECT sample_id, count(*) AS dependency_edges FROM dep GROUP BY 1)
SELECT sample_id, word_nodes + sentence_nodes + claim_nodes AS nodes, word_nodes, sentence_nodes, claim_nodes, 0::BIGINT AS entity_nodes, structural_edges + coalesce(dependency_edges, 0) AS edges, structural_edges, coalesce(dependency_edges, 0) AS dependency_edges,
  0::BIGINT AS entity_structural_edges, 0::BIGINT AS semantic_edges, 0::BIGINT AS sentence_claim_semantic_edges, round(word_nodes / greatest(sentence_nodes, 1), 6) AS words_per_sentence FROM w JOIN e USING (sample_id) LEFT JOIN q USING (sample_id)""",
    "dependency_statistics": f"WITH {_REC} SELECT sample_id, 'prev' AS relation, count(*) AS n, count(*) AS total, 1 AS rank FROM dep GROUP BY 1",
    "word_frequency": f"WITH {_REC} SELECT sample_id, word, count(*) AS n, row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, min(phase * 1000000000000 + sent * 1000000 + idx)) AS rank FROM pl GROUP BY 1, 2 QUALIFY rank <= 5",
    "claim_word_neighbours": f"WITH {_REC} SELECT DISTINCT sample_id, word FROM t WHERE ord = 0",
    "beam_one_step": f"WITH {_FIRST_STEP} SELECT sample_id, rank, word, 7.9::DOUBLE AS score FROM one",
    "beam_two_hop_topk": f"""WITH {_FIRST_STEP}, two AS (SELECT o.sample_id, o.word, o.rank AS parent, s.ord - 1 AS sent_idx, s.ord AS adj,
  round(6.8::DOUBLE + 1.2::DOUBLE * len(c.ws) / (len(c.ws) + len(l.ws) - len(list_intersect(c.ws, l.ws))) - 0.15::DOUBLE + 1.5::DOUBLE, 9) AS score
  FROM one o JOIN st s ON o.sample_id = s.sample_id AND o.word = s.word AND s.ord > 0 JOIN low l ON l.sample_id = s.sample_id AND l.ord = s.ord JOIN c ON c.sample_id = o.sample_id)
SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, parent, adj) AS rank, word, sent_idx, round(score, 6) AS score FROM two QUALIFY rank <= 20""",
    "entity_union": f"""WITH {_NAMES}, b AS (SELECT sample_id, list_concat(f, s) AS es FROM names), u AS (SELECT sample_id, i, es[i] AS entity FROM (SELECT *, unnest(range(1, len(es) + 1)) AS i FROM b)),
k AS (SELECT * FROM u WHERE length(entity) > 2 QUALIFY row_number() OVER (PARTITION BY sample_id, lower(entity) ORDER BY i) = 1) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY i) - 1 AS ord, entity FROM k""",
    "entity_score_lookup": f"""WITH {_NAMES}, e AS (SELECT sample_id, unnest(list_distinct(s)) AS entity FROM names), n AS (SELECT sample_id, i, f[i] AS name FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM names)),
m AS (SELECT e.sample_id, entity, arg_min(length(name), i) AS score FROM e JOIN n ON e.sample_id = n.sample_id AND (contains(lower(entity), lower(name)) OR contains(lower(name), lower(entity))) GROUP BY 1, 2)
SELECT e.sample_id, e.entity, coalesce(score, 1)::DOUBLE AS score FROM e LEFT JOIN m ON e.sample_id = m.sample_id AND e.entity = m.entity""",
    "quality_words": f"WITH {WORDS} SELECT sample_id, ord, len(w) AS word_count, len(list_filter(w, lambda x: length(x) > 2 AND NOT list_contains({_list(STOP_WORDS)}, lower(x)))) AS meaningful_words FROM words",
    "relevance_shared": f"WITH {WORDS} SELECT sample_id, ord, round(CASE WHEN len(c) = 0 THEN 0 ELSE len(list_intersect(s, c)) / len(c) END, 6) AS overlap_ratio, array_to_string(list_sort(list_intersect(s, c)), ' ') AS shared_words FROM words",
    "entity_coverage": f"WITH {WORDS} SELECT sample_id, ord, array_to_string(list_sort({_HELD}), ' ') AS found, round(CASE WHEN len(entities) = 0 THEN 0 ELSE len({_HELD}) / len(entities) END, 6) AS coverage FROM words",
    "contradiction_phrases": f"WITH {WORDS} SELECT sample_id, ord, {_FOUND} FROM words",
    "subject_relevance": f"""WITH {SCORES}, s1 AS (SELECT * FROM scored WHERE quality_score >= {C.min_quality}),
g AS (SELECT * REPLACE (CASE WHEN len(list_filter(cw, lambda x: {_SUBJECT})) = 0 OR len(list_filter(cw, lambda x: {_SUBJECT} AND contains(low, x))) > 0 THEN relevance_score ELSE 0 END AS relevance_score) FROM s1),
a2 AS (SELECT *, count(*) OVER q AS m, count(*) FILTER (relevance_score >= {C.min_relevance}) OVER q AS k, row_number() OVER (PARTITION BY sample_id ORDER BY relevance_score DESC, ord) AS r FROM g WINDOW q AS (PARTITION BY sample_id))
SELECT sample_id, CASE WHEN k = 0 THEN r ELSE ord END AS ord, sentence, relevance_score FROM a2 WHERE relevance_score >= {C.min_relevance} OR (k = 0 AND r <= greatest(m // 2, 5))""",
    "cascade_fallback": f"""WITH {_STRICT}, left_out AS (SELECT sample_id, sentence, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, ord) AS r FROM scored WHERE sample_id NOT IN (SELECT sample_id FROM s5))
SELECT sample_id, sentence, false AS is_fallback, round(confidence_score, 6) AS confidence_score FROM s5 UNION ALL SELECT sample_id, sentence, true, 0 FROM left_out WHERE r = 1""",
    "best_scored_topk": f"WITH {CANDIDATES} SELECT sample_id, ord, row_number() OVER (PARTITION BY sample_id ORDER BY length(sentence) % 7 DESC, ord) AS rank, ((length(sentence) % 7) / 10)::DOUBLE AS score FROM cand QUALIFY rank <= 5",
    "filtering_ranges": f"WITH {STAGES} SELECT sample_id, count(*) AS sentences, {_RANGES} FROM s5 GROUP BY 1",
    "overall_averages": f"WITH {STAGES} SELECT sample_id, count(*) AS total_sentences, {_MEANS} FROM s5 GROUP BY 1",
    "threshold_pass_fail": f"WITH {VECTORS} SELECT sample_id, vec_id, similarity, threshold, similarity >= threshold AS passes FROM tc, (VALUES (-0.1::DOUBLE), (0.0), (0.1), (0.2)) x(threshold)",
    "pairs_without_edges": f"WITH {VECTORS} SELECT sample_id, a_id AS a, b_id AS b, similarity FROM pairs p WHERE similarity >= 0.1 AND NOT EXISTS (SELECT 1 FROM sem WHERE sem.a_id = p.a_id AND sem.b_id = p.b_id)",
    "sentence_claim_statistics": f"""WITH {VECTORS} SELECT sample_id, count(*) AS n, round(avg(similarity), 5) AS avg_similarity, max(similarity) AS max_similarity, min(similarity) AS min_similarity,
  count(*) FILTER (similarity >= 0 AND similarity < 0.1) AS from_0, count(*) FILTER (similarity >= 0.1 AND similarity < 0.2) AS from_10, count(*) FILTER (similarity >= 0.2 AND similarity < 0.3) AS from_20, count(*) FILTER (similarity >= 0.3 AND similarity <= 1) AS from_30,
  string_agg(vec_id || ':' || CASE WHEN length(repeat('vector ' || vec_id, 12)) > 100 THEN 103 ELSE length(repeat('vector ' || vec_id, 12)) END, ',' ORDER BY similarity DESC, vec_id) AS connected_sentences FROM tc WHERE similarity >= 0 GROUP BY 1""",
    "hop_counters": f"""WITH {SCORES}, p AS (SELECT sample_id, count(*) FILTER (relevance_score >= 0.15) AS direct, count(*) FILTER (quality_score >= 0.8) AS searched, count(*) // 10 AS levels FROM scored GROUP BY 1)
SELECT count(*) AS samples, sum(direct)::BIGINT AS direct_total, round(avg(direct), 6) AS direct_mean, count(*) FILTER (direct > 0) AS with_direct, sum(searched)::BIGINT AS searched_total, round(avg(searched), 6) AS searched_mean, max(levels) AS most_levels FROM p""",
    "run_summary": f"WITH {SEGMENTS} SELECT count(*) AS total_samples, count(*) FILTER (len(sents) > 1) AS successful_samples, count(*) FILTER (len(sents) < 2) AS failed_samples, count(*) FILTER (len(sents) < 2) AS failures, 3 AS num_hops FROM docs",
}
for _name, _of in (("coverage_shares", "coverage_histogram"), ("evidence_shares", "evidence_histogram")):
    SQL[_name] = f"SELECT *, round(n / sum(n) OVER () * 100, 6) AS percentage FROM ({SQL[_of]})"
