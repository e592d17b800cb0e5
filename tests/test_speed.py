"""Fast ways give what the plain ones give."""

import difflib
import random

import pytest

from lodestar.functions import text
from lodestar.operators.beam import SampleGraph


def pairs(n, longest):
    r = random.Random(n)
    for _ in range(n):
        letters = r.choice(["ab", "abc ", "abcdefgh ", "etaoin shrdlué"])
        a, b = ("".join(r.choice(letters) for _ in range(r.randint(0, longest))) for _ in range(2))
        yield a, a[r.randint(0, 5) :] + b if r.random() < 0.3 else b


def test_ratio_is_that_of_difflib(monkeypatch):
    for a, b in pairs(300, 260):
        assert text.matching_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
    short = [(a, b[:199], difflib.SequenceMatcher(None, a, b[:199]).ratio()) for a, b in pairs(3000, 50)]
    monkeypatch.setattr(text.difflib, "SequenceMatcher", None)
    assert all(text.matching_ratio(a, b) == want for a, b, want in short)


def plain_from_sentence(g, root, exclude, width, depth):
    beam, done = [(0, (root,))], []
    for _ in range(depth):
        grown = []
        for _, path in beam:
            for n in g.near[path[-1]]:
                if n not in path:
                    (done if n[0] == "s" and n not in exclude else grown).append((g.score((*path, n)), (*path, n)))
        beam = sorted(grown, key=lambda x: -x[0])[:width]
    return sorted(done, key=lambda x: -x[0])


@pytest.mark.parametrize("linked", [False, True])
def test_best_paths_from_a_sentence(linked):
    r = random.Random(9)
    for _ in range(60):
        g = SampleGraph([" ".join(r.choice([*"abcdefgh", "New", "York"]) for _ in range(r.randint(1, 5))) for _ in range(r.randint(3, 9))], linked)
        for most in (1, 3, 1000):
            got = g.from_sentence("sentence_0", {"sentence_0", "sentence_1"}, 4, 5, most)
            assert got == plain_from_sentence(g, "sentence_0", {"sentence_0", "sentence_1"}, 4, 5)[:most]


@pytest.mark.parametrize("linked", [False, True])
def test_paths_above_a_score(linked):
    r = random.Random(10)
    for _ in range(60):
        g = SampleGraph([" ".join(r.choice([*"abcdefgh", "New", "York"]) for _ in range(r.randint(1, 5))) for _ in range(r.randint(3, 9))], linked)
        want = plain_from_sentence(g, "sentence_0", {"sentence_0", "sentence_1"}, 4, 5)
        for above in {s for s, _ in want[:9]}:
            got = g.from_sentence("sentence_0", {"sentence_0", "sentence_1"}, 4, 5, 3, above)
            assert got == [x for x in want if x[0] > above][:3]


def test_statistics_are_the_stages_counts(spark):
    from lodestar.functions.lexicon import FilterConfig
    from lodestar.operators.cascade import FilterCascade
    from lodestar.operators.samples import candidates

    r = random.Random(4)
    say = lambda: " ".join(r.choice(["River", "Elbe", "flooded", "not", "the", "town", "is", "a", "Dresden", "walked"]) for _ in range(r.randint(1, 9)))
    docs = spark.createDataFrame([(k, "\n".join([say() for _ in range(r.randint(1, 30))] * r.choice([1, 2]))) for k in range(40)] + [(90, None), (91, "Alone"), (92, "Two here\na")], "doc_id long, text string")
    for config in (FilterConfig(), FilterConfig(max_final=3, min_quality=0.8), FilterConfig(max_final=0)):
        cascade, rows = FilterCascade(config), candidates(docs, scored=True)
        want = [{x.sample_id: x["count"] for x in s.groupBy("sample_id").count().collect()} for s in cascade.stages(rows)]
        got = cascade.statistics(rows)
        assert {x.sample_id: [x[f"n{k}"] for k in range(6)] for x in got.collect()} == {i: [w.get(i, 0) for w in want] for i in want[0]}
        assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Scan ExistingRDD") <= 2  # not one for each stage
