"""Scorers and normalisers against plain restatements, cascade branches, sources and streaming."""

import json
import unicodedata

from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators.cascade import FilterCascade
from lodestar.sources import io
from lodestar.streaming.engine import cascade_stream

SAMPLES = ["Việt Nam là một", "Đường  phố _x_ ÀÉ!", "", "a_b  C", "…"]


def plain(s):
    import re

    s = re.sub(r"[\W_]+", " ", s.lower())
    return " ".join("".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").split())


def test_normalize(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    assert [r[0] for r in df.select(text.normalize_basic(F.col("s"))).collect()] == [plain(s) for s in SAMPLES]
    assert df.select(text.normalize_strong(F.col("s"))).collect()[3][0] == "a b c"


def rows(*items):
    return [(1, k + 1, s, "the quick brown fox jumps over lazy dogs", ["quick", "brown"]) for k, s in enumerate(items)]


SCHEMA = "sample_id long, ord long, sentence string, claim string, entities array<string>"


def test_cascade_branches(spark):
    c = FilterCascade()
    df = spark.createDataFrame(rows("nothing in common with anything here", "other things that are long enough", "third one of these sentences", "fourth one of these sentences", "fifth one of those sentences", "sixth one of those sentences", ""), SCHEMA)
    stages = c.stages(df)
    assert stages[0].count() == 6 and stages[2].count() == 5  # none is relevant: the best five
    df = spark.createDataFrame(rows("quick brown fox jumps", "quick brown fox jumps", "quick animals like the fox jumps"), SCHEMA)
    got = c.transform(df).orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 2] and {r.stance for r in got} == {"support"}
    assert c.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps([{"context": "a b.", "claim": "a", "label": 1}, {"context": " ", "claim": "x"}]))
    assert [r.claim for r in io.read_samples(spark, str(tmp_path / "in.json")).collect()] == ["a"]
    assert io.fallback_sample(spark).count() == 1
    df = spark.createDataFrame([('```json\n["A", " b ", "", "A"]\n```',), ("oops",), (None,)], "r string")
    assert [r[0] for r in df.select(io.parse_entities(F.col("r"))).collect()] == [["A", "b"], [], []]
    n = spark.createDataFrame([("w", None)], "word string, pos string")
    io.save_graph(n, n, str(tmp_path / "g"))
    assert io.load_graph(spark, str(tmp_path / "g"))[0].collect()[0].pos == ""


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Some Claim here. Some other claim is here. Not this one though."), (2, "x")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    cascade_stream(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "ck"), docs.schema).awaitTermination()
    from lodestar.operators.samples import candidates

    want = FilterCascade().transform(candidates(docs)).select("sample_id", "sentence", "rank").collect()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select("sample_id", "sentence", "rank").collect()) == sorted(want)
