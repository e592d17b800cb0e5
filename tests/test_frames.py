"""The frame search goes over the graph's own edges, without a table of all steps, and likens a sentence once."""

import pandas as pd

from lodestar.functions import text
from lodestar.operators import evidence_graph, paths
from lodestar.operators.beam import SampleGraph


def test_no_table_of_steps(spark, monkeypatch):
    monkeypatch.setattr(paths, "steps", None)
    samples = spark.createDataFrame([(1, "b c\nc d\na x y", "a b"), (2, "p q\nq r", "z"), (3, "u v\nv w\nw o", "u")], "sample_id long, context string, claim string")
    graph = evidence_graph.build(samples)
    got = {k: [] for k in (1, 2, 3)}
    for x in paths.best_paths(graph).orderBy("sample_id", "rank").collect():
        got[x.sample_id].append((x.score, tuple(x.nodes)))
    for k in got:
        nodes = [(x.node_id, x.text, None) for x in graph.nodes.where(f"sample_id = {k}").orderBy("ord").collect()]
        edges = [(x.src, x.dst) for x in graph.edges.where(f"sample_id = {k}").orderBy("first_ord").collect()]
        assert got[k] == SampleGraph.of(nodes, edges).best_paths(10, 6, 20)
    assert got[1] and got[3] and not got[2]


def test_equal_rows_share_a_ratio(monkeypatch):
    seen, plain = [], text.matching_ratio
    monkeypatch.setattr(text, "matching_ratio", lambda a, b: seen.append((a, b)) or plain(a, b))
    a, b = pd.Series(["Ab", "Ab", None, "x"]), pd.Series(["abc", "abc", None, "x"])
    assert list(text.fuzzy_ratio.func(a, b)) == [0.8, 0.8, 1.0, 1.0] and len(seen) == 3
