"""Stage 3 of samples whose claim has no entities."""

from lodestar.operators.cascade import FilterCascade


def test_rows_stay_without_entities(spark):
    rows = [(s, k, f"sentence {k}", entities, 0.95 if k == 11 else 0.5, 0.0) for s, entities in ((1, []), (2, ["Hanoi"])) for k in range(12)]
    df = spark.createDataFrame(rows, "sample_id long, ord long, sentence string, entities array<string>, relevance_score double, entity_score double")
    kept = {(x.sample_id, x.ord) for x in FilterCascade().stage3(df).collect()}
    assert {k for s, k in kept if s == 1} == set(range(12)) and sum(s == 2 for s, _ in kept) == 6
