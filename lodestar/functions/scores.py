"""Sentence scorers as column expressions over precomputed word arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import BOOST_SPECIAL, BOOST_STOP, VERB_ENDINGS, FilterConfig
from .text import words_of


#: What a claim brings to the scores of its sentences.
CLAIM_COLUMNS = ("cw", "c", "long", "grams")


def claim_words(df: DataFrame) -> DataFrame:
    """df with the claim's words, its lower-cased set, that of its longer words, and its 6-grams; once for all its sentences
    where the claim is a column of its sample."""
    df = df.withColumn("cw", words_of(F.lower("claim")))
    n = F.size("cw")
    grams = F.when(n >= 6, F.transform(F.sequence(F.lit(1), n - 5), lambda i: F.array_join(F.slice("cw", i, 6), " "))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("c", F.array_distinct("cw")).withColumn("long", longer("c")).withColumn("grams", grams)


def with_words(df: DataFrame) -> DataFrame:
    """sentence and claim with their words, lower-cased sets, and the claim's 6-grams."""
    df = df if set(CLAIM_COLUMNS) <= set(df.columns) else claim_words(df)
    df = df.withColumn("w", words_of(F.col("sentence"))).withColumn("low", F.lower("sentence"))
    return df.withColumn("s", F.array_distinct(F.transform("w", F.lower)))


def longer(words) -> Column:
    return F.filter(words, lambda x: F.length(x) > 3)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def meaningful(config: FilterConfig) -> Column:
    """Number of words of more than two letters that are no stop words."""
    return F.size(F.filter("w", lambda x: (F.length(x) > 2) & ~F.lower(x).isin(*config.stop_words)))


def quality_parts(config: FilterConfig) -> dict[str, Column]:
    n, w = F.size("w"), F.col("w")
    length = F.when(n < 3, 0.2).when(n < 5, 0.5).when(n <= 50, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (n - 50) * 0.01))
    density = meaningful(config) / F.greatest(n, F.lit(1))
    # of the whole sentence, which is as much as of any of its words
    verb = F.col("low").rlike(r"(" + "|".join(VERB_ENDINGS) + r")([\s\p{Z}]|$)")
    noun = F.col("sentence").rlike(r"[^\s\p{Z}]{4}")
    structure = F.when(n < 3, 0.3).when(verb & noun, 0.8).when(verb | noun, 0.5).otherwise(0.3)
    letters = F.length(F.regexp_replace("sentence", r"[\s\p{Z}]+", ""))
    richness = F.when(n == 0, 0.0).otherwise(0.6 * F.size(F.array_distinct(w)) / n + 0.4 * F.least(F.lit(1.0), letters / n / 8))
    return {"length_score": length, "density": density, "structure": structure, "richness": richness}


def quality(length: str = "length_score", density: str = "density", structure: str = "structure", richness: str = "richness") -> Column:
    return F.least(F.lit(1.0), 0.3 * F.col(length) + 0.3 * F.col(density) + 0.2 * F.col(structure) + 0.2 * F.col(richness))


def overlap() -> Column:
    return F.size(F.array_intersect("s", "c"))


def coherence() -> Column:
    return ratio(F.size(F.array_intersect("s", "long")), F.size("long"))


def has_gram() -> Column:
    return F.exists("grams", lambda g: F.contains(F.col("low"), g))


def relevance(similarity: Column | None = None) -> Column:
    """Keyword and topic overlap, with the embedding's cosine where one is positive; a shared 6-gram adds 0.3."""
    kw, coh = ratio(overlap(), F.size("c")), coherence()
    base = 0.6 * kw + 0.4 * coh
    if similarity is not None:
        base = F.when(similarity > 0, 0.4 * kw + 0.4 * similarity + 0.2 * coh).otherwise(base)
    return F.least(F.lit(1.0), base + F.when(has_gram(), 0.3).otherwise(0.0))


def jaccard_overlap() -> Column:
    return 0.4 * ratio(overlap(), F.size(F.array_union("s", "c"))) + 0.6 * ratio(overlap(), F.size("c"))


def entity_hits() -> Column:
    return F.size(F.filter("entities", lambda e: F.contains(F.col("low"), e)))


def entity_score() -> Column:
    """Share of the entities that the sentence holds, weighted with that of the claim's."""
    own = F.filter("entities", lambda e: F.contains(F.lower("claim"), e))
    both = F.size(F.filter(own, lambda e: F.contains(F.col("low"), e)))
    score = 0.6 * entity_hits() / F.size("entities") + 0.4 * both / F.greatest(F.size(own), F.lit(1))
    return F.when((F.size("entities") == 0) | (entity_hits() == 0), 0.0).otherwise(F.least(F.lit(1.0), score))


def category_hits(phrases: tuple[str, ...]) -> Column:
    return sum((F.contains(F.col("low"), F.lit(p)).cast("int") for p in phrases), F.lit(0))


def contradiction(config: FilterConfig) -> Column:
    phrases = [p for ps in config.contradiction.values() for p in ps]
    return category_hits(tuple(phrases)) / len(phrases)


def confidence(score: Column | None = None) -> Column:
    base = 0.2 * F.col("quality_score") + 0.3 * F.col("relevance_score") + 0.2 * F.col("entity_score") + 0.2 * (1 - F.col("contradiction_score"))
    return F.least(F.lit(1.0), base + 0.1 * (score if score is not None else F.lit(0.0)))


def keyword_boost() -> Column:
    stop = F.array(*map(F.lit, BOOST_STOP))
    words = F.size(F.filter("cw", lambda x: (F.length(x) > 3) & ~F.array_contains(stop, x) & F.contains(F.col("low"), x)))
    special = sum(((F.contains(F.col("low"), F.lit(k)) | F.contains(F.col("low"), F.lit(k.replace("_", " ")))).cast("int") for k in BOOST_SPECIAL), F.lit(0))
    return F.least(F.lit(2.0), 1 + 0.1 * words + 0.2 * special)


def entities_found() -> Column:
    return F.filter("entities", lambda e: F.contains(F.col("low"), e))


def phrases_found(phrases: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.col("low"), p))


def analyses(config: FilterConfig) -> dict[str, Column]:
    """What the scores of a row with its words rest on, one struct for each."""
    parts = quality_parts(config)
    shared = F.sort_array(F.array_intersect("s", "c"))
    quality_ = F.struct(F.size("w").alias("word_count"), meaningful(config).alias("meaningful_words"), *(parts[k].alias(k) for k in ("density", "structure", "richness")))
    relevance_ = F.struct(overlap().alias("overlap_count"), ratio(overlap(), F.size("c")).alias("overlap_ratio"), shared.alias("shared_words"), coherence().alias("coherence"))
    entity_ = F.struct(entities_found().alias("found"), entity_hits().alias("count"), ratio(entity_hits(), F.size("entities")).alias("coverage"))
    contradiction_ = F.struct(*(phrases_found(ps).alias(k) for k, ps in config.contradiction.items()))
    return {"quality_analysis": quality_, "relevance_analysis": relevance_, "entity_analysis": entity_, "contradiction_analysis": contradiction_}
