"""The five-stage filter cascade, all samples at once: conditional fallbacks are window counts over a sample's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.lexicon import FilterConfig
from ..functions.text import once, words_of


def _all():
    return Window.partitionBy("sample_id")


def _ranked(name: str, *order):
    return F.row_number().over(Window.partitionBy("sample_id").orderBy(*order)).alias(name)


def here_or(chain, condition, value):
    return F.when(condition, value) if chain is None else chain.when(condition, value)


class FilterCascade:
    """candidates(sample_id, ord, sentence, claim, entities[, score]) through quality, relevance, entities, stance, ranking."""

    def __init__(self, config: FilterConfig | None = None):
        self.config = config or FilterConfig()

    def scored(self, df: DataFrame) -> DataFrame:
        c, df = self.config, scores.with_words(df.where("sentence <> ''"))
        df = df.withColumns(scores.quality_parts(c))
        df = df.withColumns({"quality_score": scores.quality(), "relevance_score": scores.relevance(), "entity_score": scores.entity_score(), "contradiction_score": scores.contradiction(c)})
        return df.withColumns({n: once(F.round(n, 9)) for n in ("quality_score", "relevance_score", "entity_score", "contradiction_score")}).drop("w", "low", "s", *scores.CLAIM_COLUMNS)

    def stage1(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("quality_score") >= self.config.min_quality)

    def stage2(self, df: DataFrame) -> DataFrame:
        """Rows of enough relevance; where a sample has none, its best half, five at least. With subject keywords (a column
        `subjects`), a row that holds none of them counts as of no relevance, but in samples without any."""
        if "subjects" in df.columns:
            held = (F.size("subjects") == 0) | F.exists("subjects", lambda k: F.contains(F.lower("sentence"), k))
            df = df.withColumn("relevance_score", F.when(held, F.col("relevance_score")).otherwise(0.0)).drop("subjects")
        good = F.col("relevance_score") >= self.config.min_relevance
        df = df.select("*", F.count("*").over(_all()).alias("n"), F.count_if(good).over(_all()).alias("k"), _ranked("r", F.desc("relevance_score"), "ord"))
        kept = df.where(good | ((F.col("k") == 0) & (F.col("r") <= F.greatest(F.floor(F.col("n") / 2), F.lit(5)))))
        return kept.withColumn("ord", F.when(F.col("k") == 0, F.col("r").cast("long")).otherwise(F.col("ord"))).drop("n", "k", "r")

    def stage3(self, df: DataFrame) -> DataFrame:
        """Rows with entities or near the claim; too few: the best half of the input by entity score; none, or a sample without
        entities: the input."""
        c = self.config
        good = ((F.col("relevance_score") >= c.bypass) | (F.col("entity_score") >= c.min_entity)) & (F.size("entities") > 0)
        df = df.select("*", F.count("*").over(_all()).alias("n"), F.count_if(good).over(_all()).alias("k"), _ranked("r", F.desc("entity_score"), "ord"))
        few = (F.col("k") > 0) & (F.col("k") < c.min_entity_keep)
        kept = df.where((F.col("k") == 0) | F.when(few, F.col("r") <= F.greatest(F.floor(F.col("n") / 2), F.lit(c.min_entity_keep))).otherwise(good))
        return kept.withColumn("ord", F.when(few, F.col("r").cast("long")).otherwise(F.col("ord"))).drop("n", "k", "r")

    def stage4(self, df: DataFrame) -> DataFrame:
        """Stance by contradiction score; a sample without any stance keeps its rows. With columns nli_label or diff, the tiers
        of `stance_tiers` come first, and the score serves only samples that no tier decides."""
        if {"nli_label", "diff"} & set(df.columns):
            return self.stance_tiers(df)
        c, score = self.config, F.col("contradiction_score")
        stance = F.when(score <= c.support, "support").when(score >= c.refute, "refute")
        df = df.withColumn("stance", stance).withColumn("stance_score", F.when(score <= c.support, 1 - score).when(score >= c.refute, score))
        return df.withColumn("k", F.count("stance").over(_all())).where(F.col("stance").isNotNull() | (F.col("k") == 0)).drop("k")

    def stance_tiers(self, df: DataFrame) -> DataFrame:
        """Stance by the first tier that decides any row of a sample: labels of an inference model (entail, contradict); `diff`,
        cosine to the claim less cosine to its negation, beyond delta, then beyond half of delta; the least diff as refuting and
        the greatest as supporting; the contradiction score, for samples without labels and diffs. Other rows go."""
        c = self.config
        for name, kind in (("nli_label", "string"), ("diff", "double"), ("contradiction_score", "double")):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(None).cast(kind))
        label, diff, score = F.lower("nli_label"), F.col("diff"), F.col("contradiction_score")
        # nulls sort after all diffs in `low` and before them in `high`
        df = df.select("*", _ranked("low", F.asc_nulls_last("diff"), "ord"), _ranked("high", F.desc_nulls_last("diff"), F.desc("ord")))
        beyond = lambda d: F.when(diff > d, "support").when(diff < -d, "refute")
        tiers = [
            F.when(F.startswith(label, F.lit("entail")), "support").when(F.startswith(label, F.lit("contradict")), "refute"),
            beyond(c.delta),
            beyond(c.delta / 2),
            F.when(diff.isNotNull() & (F.col("low") == 1), "refute").when(diff.isNotNull() & (F.col("high") == 1), "support"),
            F.when(score <= c.support, "support").when(score >= c.refute, "refute"),
        ]
        df = df.withColumns({f"t{k}": t for k, t in enumerate(tiers)})
        df = df.withColumns({f"n{k}": F.count(f"t{k}").over(_all()) for k in range(len(tiers))})
        strength = [F.lit(1.0), F.abs("diff"), F.abs("diff"), F.abs("diff"), F.when(score <= c.support, 1 - score).otherwise(score)]
        stance = worth = tier = None
        for k in range(len(tiers)):
            here = F.col(f"n{k}") > 0
            stance = here_or(stance, here, F.col(f"t{k}"))
            worth = here_or(worth, here, strength[k])
            tier = here_or(tier, here, F.lit(k + 1))
        df = df.withColumns({"stance": stance, "stance_score": worth, "stance_tier": tier})
        kept = df.where(F.col("stance").isNotNull() | F.col("stance_tier").isNull())
        return kept.drop("low", "high", *(f"{x}{k}" for k in range(len(tiers)) for x in "tn"))

    def stage5(self, df: DataFrame) -> DataFrame:
        """The first of equal texts, by confidence; the best of each sample."""
        first = df.select("*", F.row_number().over(Window.partitionBy("sample_id", "sentence").orderBy("ord")).alias("r")).where("r = 1").drop("r")
        score = F.col("score") if "score" in df.columns else None
        final = first.withColumn("confidence_score", F.round(scores.confidence(score), 9))
        return final.select("*", _ranked("rank", F.desc("confidence_score"), "ord")).where(F.col("rank") <= self.config.max_final)

    def stages(self, df: DataFrame, stance: bool = True, entities: bool = True) -> list[DataFrame]:
        out = [self.scored(df)]
        for step in (self.stage1, self.stage2, *([self.stage3] if entities else []), *([self.stage4] if stance else []), self.stage5):
            out.append(step(out[-1]))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stages(df)[-1]

    def with_metadata(self, df: DataFrame) -> DataFrame:
        """The cascade's rows with their scores as one struct."""
        names = ("quality_score", "relevance_score", "entity_score", "contradiction_score", "confidence_score")
        return self.transform(df).withColumn("filtering_metadata", F.struct(*names))

    def with_fallback(self, df: DataFrame) -> DataFrame:
        """The cascade's rows with `is_fallback`; a sample that it leaves without any keeps its row of the best `score`."""
        kept = self.transform(df).withColumn("is_fallback", F.lit(False))
        best = self.scored(df).select("*", _ranked("rank", F.desc("score"), "ord")).where("rank = 1")
        best = best.join(kept.select("sample_id").distinct(), "sample_id", "left_anti").withColumns({"confidence_score": F.lit(0.0).cast("double"), "is_fallback": F.lit(True)})
        return kept.unionByName(best, allowMissingColumns=True)

    def statistics(self, df: DataFrame) -> DataFrame:
        """Rows of each sample after each stage, and its filtering rate, in one pass: rows carry the counts of the stages before."""
        every = df.where("sentence <> ''").groupBy("sample_id").agg(F.count("*").alias("n0"))
        counted = lambda rows, n: rows.withColumn(n, F.count("*").over(_all()))
        rows = counted(self.stage1(self.scored(df)), "n1")
        rows = counted(self.stage2(rows), "n2")
        rows = self.stage4(counted(self.stage3(rows), "n3"))
        # what stage 5 keeps is told by the number of texts; no stage but the first leaves a sample without rows
        texts = rows.groupBy("sample_id", "sentence").agg(F.count("*").alias("n"), *(F.max(n).alias(n) for n in ("n1", "n2", "n3")))
        last = texts.groupBy("sample_id").agg(*(F.max(n).alias(n) for n in ("n1", "n2", "n3")), F.sum("n").alias("n4"), F.least(F.count("*"), F.lit(self.config.max_final)).alias("n5"))
        wide = every.join(last, "sample_id", "left").select("sample_id", "n0", *(F.coalesce(f"n{k}", F.lit(0)).alias(f"n{k}") for k in range(1, 6)))
        return wide.withColumn("filtering_rate", F.round((1 - F.col("n5") / F.col("n0")) * 100, 6))

    def score_ranges(self, df: DataFrame) -> DataFrame:
        """(sample_id, sentences, least, greatest and mean of three scores) of what the cascade keeps."""
        stats = [g.alias(f"{n}_{c.split('_')[0]}") for c in ("quality_score", "relevance_score", "confidence_score") for n, g in (("min", F.min(c)), ("max", F.max(c)), ("avg", F.round(F.avg(c), 6)))]
        return self.transform(df).groupBy("sample_id").agg(F.count("*").alias("sentences"), *stats)


def best_scored(df: DataFrame, most: int) -> DataFrame:
    """In place of the cascade: the rows of the best `score` of each sample."""
    return df.select("*", _ranked("rank", F.desc("score"), "ord")).where(F.col("rank") <= most)


def subject_keywords(claim, entities, parts: tuple[str, ...], words: tuple[str, ...], starts: tuple[str, ...]) -> F.Column:
    """Subjects that a sentence should mention: entities with one of `parts`, and the claim's words that are one of `words` or
    start with one of `starts`; lower-cased."""
    of_entities = F.filter(F.transform(entities, F.lower), lambda e: any_of(F.contains, e, parts))
    of_claim = F.filter(words_of(F.lower(claim)), lambda w: w.isin(*words) | any_of(F.startswith, w, starts))
    return F.array_distinct(F.concat(of_entities, of_claim))


def any_of(test, value, parts: tuple[str, ...]) -> F.Column:
    out = F.lit(False)
    for p in parts:
        out = out | test(value, F.lit(p))
    return out
