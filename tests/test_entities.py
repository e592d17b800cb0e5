"""Entity matching, stance tiers, hybrid merge, hop and path statistics, and graph documents on small rows."""

from lodestar.operators import beam, entities, hops
from lodestar.operators.cascade import FilterCascade
from lodestar.sources.io import graph_documents, parse_graph_documents


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_entity_edges(spark):
    e = spark.createDataFrame([(1, "Ha Noi City"), (1, "ha_noi"), (1, "Hue")], "sample_id long, entity string")
    s = spark.createDataFrame([(1, 0, "Hue and the city"), (1, 1, "In Hà Nội, rain"), (1, 2, "a city, Hanoi: ha noi"), (2, 1, "Hue")], "sample_id long, ord long, sentence string")
    got = rows(entities.entity_edges(e, s), "entity", "ord", "weight")
    assert got == [("Ha Noi City", 0, 1.5), ("Ha Noi City", 2, 1.0), ("Hue", 0, 1.5), ("ha_noi", 1, 1.0), ("ha_noi", 2, 1.0)]


def test_entity_words(spark):
    e = spark.createDataFrame([(1, "New York"), (1, "Oslo")], "sample_id long, entity string")
    w = spark.createDataFrame([(1, "york", 2, 0), (1, "New", 1, 5), (1, "...", 0, 0)], "sample_id long, word string, first_ord long, first_idx long")
    assert {(r.entity, r.word) for r in entities.entity_words(e, w).collect()} == {("New York", "New"), ("Oslo", None)}


def test_stance_tiers(spark):
    data = [
        (1, 1, "Entailment", 0.5, 0.0), (1, 2, "neutral", 0.9, 0.0),
        (2, 1, "neutral", 0.2, 0.0), (2, 2, None, -0.15, 0.0), (2, 3, None, 0.07, 0.0),
        (3, 1, None, 0.06, 0.0), (3, 2, None, 0.01, 0.0),
        (4, 1, None, 0.01, 0.0), (4, 2, None, 0.03, 0.0), (4, 3, None, 0.02, 0.0), (4, 4, None, None, 0.0),
        (5, 1, None, None, 0.1), (5, 2, None, None, 0.5), (5, 3, None, None, 0.8),
        (6, 1, None, None, 0.5), (7, 1, None, 0.0, 0.0),
    ]
    df = spark.createDataFrame(data, "sample_id long, ord long, nli_label string, diff double, contradiction_score double")
    got = {(r.sample_id, r.ord): (r.stance, r.stance_tier) for r in FilterCascade().stage4(df).collect()}
    assert got == {
        (1, 1): ("support", 1), (2, 1): ("support", 2), (2, 2): ("refute", 2), (3, 1): ("support", 3), (4, 1): ("refute", 4), (4, 2): ("support", 4),
        (5, 1): ("support", 5), (5, 3): ("refute", 5), (6, 1): (None, None), (7, 1): ("refute", 4),
    }


def test_hybrid(spark):
    s = "sample_id long, ord long, sentence string, score double"
    d = spark.createDataFrame([(1, 1, "A_b", 0.5), (1, 2, "C", 0.95), (1, 3, "D", 0.2), (1, 4, "E", 0.89)], s)
    b = spark.createDataFrame([(1, 1, " a b", 0.7), (1, 2, "c", 0.1), (1, 3, "F", 0.3), (1, 4, "e", 0.3)], s)
    assert rows(hops.hybrid(d, b), "sentence", "score", "source") == [("A_b", 0.6, "hybrid_both_methods"), ("C", 0.95, "hybrid_both_methods"), ("D", 0.2, "direct"), ("E", 0.95, "hybrid_both_methods"), ("F", 0.3, "beam_search_unique")]


def test_statistics(spark):
    f = spark.createDataFrame([(1, 1, 0.4), (1, 1, 0.6), (1, 3, 0.2)], "sample_id long, hop int, confidence_score double")
    r = hops.hop_statistics(f).first()
    assert (r.total, r.contributions, r.diversity, r.avg_confidence) == (3, {1: 2, 3: 1}, 0.666667, 0.4)
    p = spark.createDataFrame([(1, 2.0, ["claim_0", "word_0", "sentence_1"]), (1, 1.0, ["claim_0", "word_1"])], "sample_id long, score double, nodes array<string>")
    q = beam.path_quality(p).first()
    assert (q.paths, q.avg_score, q.avg_length, q.reached_sentence_rate) == (2, 1.5, 2.5, 0.5)


def test_graph_documents(spark):
    n = spark.createDataFrame([(1, "w0", "a < b & \"c\"", "word"), (1, "s0", None, "sentence"), (2, "w0", "x", "word")], "sample_id long, id string, label string, type string")
    e = spark.createDataFrame([(1, "w0", "s0", "structural", None), (1, "s0", "w0", "semantic", 0.5)], "sample_id long, source string, target string, type string, weight double")
    nodes, edges = parse_graph_documents(graph_documents(n, e))
    assert rows(nodes.na.fill(""), "sample_id", "id", "label", "type") == [(1, "s0", "", "sentence"), (1, "w0", "a < b & \"c\"", "word"), (2, "w0", "x", "word")]
    assert rows(edges, "source", "target", "type", "weight") == [("s0", "w0", "semantic", 0.5), ("w0", "s0", "structural", 1.0)]
