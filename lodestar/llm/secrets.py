"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Candidates of three kinds are matched in every whole text. Each candidate value's digest is counted over the corpus by
distinct repository and by distinct owner: a value that many of either have is a widely copied example, one that few have and
that looks random is a live-looking credential. What the counts say about a value then adds spans: a live-looking value that
holds a digit is one wherever it stands, so a run of value characters that equals it counts too where no key word gives it
away (kind `known`). Matches keep their places (code points, end exclusive) because the text between them is known from
splitting at the same pattern.

A value is told by its characters without full stops at its end. Live-looking values without a digit, or with an equals sign
inside, are not sought elsewhere.

Rows: a null or empty text has no spans; null repositories and owners count as one more of each; repeated ids keep one row
each, also null ones, whose texts are told apart; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialize, table, unused

#: (kind, pattern, group of the value, least length of the value). A shorter match of `assign` still consumes its text;
#: runs of the other two kinds that are too short cannot hide longer ones, so their lengths are part of the pattern.
_LETTERS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = [
    ("assign", rf"""({_LETTERS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
]
#: Runs of value characters with a digit; the look-behind and the possessive stars only spare the search dead ends.
RUN = "[A-Za-z+/_.-]*[0-9][A-Za-z0-9+/_.-]*={0,2}"
KINDS = [*BASE, ("known", "(?<![A-Za-z0-9+/_.-])[A-Za-z+/_.-]*+[0-9][A-Za-z0-9+/_.-]*+={0,2}", 0, 8)]
KNOWN = len(BASE)
WORDS = ["passw", "secret", "token", "api"]
#: From so many owners or repositories on a value is a copied example; a live-looking one has at least so many different
#: characters.
COPIED_OWNERS, COPIED_REPOS, LIVE_CHARACTERS = 3, 5, 6
MASK = "[SECRET]"
_NONE = "array<struct<kind:int,nth:int,before:bigint,size:bigint,value:string>>"


def likely(text: Column, kind: str, pattern: str) -> Column:
    """A cheap test that texts with a match of the kind pass."""
    low = F.lower(text)
    if kind == "assign":
        return F.contains(low, F.lit(WORDS[0])) | F.contains(low, F.lit(WORDS[1])) | F.contains(low, F.lit(WORDS[2])) | F.contains(low, F.lit(WORDS[3]))
    return F.contains(text, F.lit("AKIA")) if kind == "access" else F.rlike(text, F.lit(pattern if kind == "hex" else "[0-9]"))


def _match(kind: int):
    return lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["piece"]).cast("long").alias("before"), F.length(x["whole"]).cast("long").alias("size"), x["value"].alias("value"))


def found_in(text: Column) -> Column:
    """Array of struct(kind, nth, before: length of the text before the match since the last one, size, value)."""
    parts = []
    for k, (kind, pattern, group, _) in enumerate(KINDS):
        pieces, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        made = F.transform(F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("whole"), value.alias("value")), _match(k))
        parts.append(F.when(likely(text, kind, pattern), made).otherwise(F.array().cast(_NONE)))
    return F.concat(*parts)


def key_of(value: Column) -> Column:
    """What tells a value: its characters without full stops at the end."""
    return F.rtrim(value, F.lit("."))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | str = "source", owner: Column | str = "source") -> DataFrame:
    """Rows (uid, doc_id, mark, head, kind, start, end, digest, varied, digit, repo, owner) of every match; one with null kind
    for a text without any. `good` matches are long enough; `mark` is a hash of the text, `head` one row of each text."""
    name = lambda c: F.col(c) if isinstance(c, str) else c
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), name(repo).alias("repo"), name(owner).alias("owner"), found_in(text).alias("all"))
    docs = docs.select("uid", "doc_id", "mark", "repo", "owner", F.posexplode_outer("all").alias("place", "m"))
    key = key_of(F.col("m.value"))
    own = ["uid", "doc_id", "mark", "repo", "owner"]
    rows = docs.select(*own, (F.coalesce("place", F.lit(0)) == 0).alias("head"), "m.kind", "m.nth", "m.before", "m.size", F.sha2(key, 256).alias("digest"), F.length("m.value").alias("chars"), F.length(key).alias("own"), F.size(F.array_distinct(F.split(key, ""))).alias("varied"), F.rlike(key, F.lit("[0-9]")).alias("digit"))
    least = F.element_at(F.array(*(F.lit(n) for *_, n in BASE)), F.col("kind") + 1)
    w = Window.partitionBy("uid", "kind").orderBy("nth")
    known = F.col("kind") == KNOWN
    stop = F.sum(F.col("before") + F.col("size")).over(w)
    some = rows.where("kind is not null").withColumn("start", stop - F.col("size"))
    some = some.withColumn("end", F.col("start") + F.when(known, F.col("own")).otherwise(F.col("size")))
    # runs that can be no live-looking value are left out here; other matches that fail keep a row, as their text may have no other
    good = F.when(known, (F.col("own") >= KINDS[KNOWN][3]) & (F.col("varied") >= LIVE_CHARACTERS)).otherwise(F.col("chars") >= least)
    shape = [*own, "head", "kind", "start", "end", "digest", "varied", "digit"]
    some = some.withColumn("good", good).where(F.col("good") | F.col("head")).select(*shape, "good")
    none = rows.where("kind is null").withColumns({"start": F.lit(None).cast("long"), "end": F.lit(None).cast("long"), "good": F.lit(False)}).select(*shape, "good")
    return some.unionByName(none)


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_repos, n_owners, varied, digit) of every base value, over the whole corpus. Equal values of one repository are
    one row before they meet the others, so a value in a third of all texts makes no large group."""
    pairs = found.where(F.col("good") & (F.col("kind") < KNOWN)).groupBy("digest", "repo", "owner").agg(F.first("varied").alias("varied"), F.first("digit").alias("digit"))
    null = lambda c: F.max(F.col(c).isNull().cast("int"))
    count = lambda c: F.count_distinct(c) + null(c)
    return pairs.groupBy("digest").agg(count("repo").alias("n_repos"), count("owner").alias("n_owners"), F.first("varied").alias("varied"), F.first("digit").alias("digit"))


def statuses(found: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """(digest, copied, live, sought): what its owners and repositories make of a value; sought ones add spans."""
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    live = ~copied & (F.col("varied") >= LIVE_CHARACTERS)
    return materialize(ownership(found).select("digest", copied.alias("copied"), live.alias("live"), (live & F.col("digit")).alias("sought")))


def classified(found: DataFrame) -> DataFrame:
    """The matches of found that count, with `copied` and `live`: base ones, and runs that equal a sought value and overlap no
    base match."""
    rows = found.where("good").drop("varied", "digit").join(statuses(found), "digest").where((F.col("kind") < KNOWN) | F.col("sought"))
    w = Window.partitionBy("uid").orderBy("start", "kind")
    base = F.col("kind") < KNOWN
    before = F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.select("*", before.alias("before"), after.alias("after"))
    apart = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end"))
    return rows.where(base | apart).drop("before", "after")


def spans(df: DataFrame, **columns: Column | str) -> DataFrame:
    """One row per document with its spans and how many of them are copied examples and live-looking credentials."""
    found = materialize(candidates(df, **columns))
    names = F.array(*(F.lit(k) for k, *_ in KINDS))
    listed = lambda s: F.array_join(F.transform(F.sort_array(s), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    span = F.struct("start", "kind", "end")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    made = classified(found).groupBy("uid").agg(*counts, F.collect_list(F.when(F.col("kind") < KNOWN, span)).alias("base"), F.collect_list(span).alias("all"), F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"))
    made = made.withColumns({"base": listed(F.col("base")), "spans": listed(F.col("all"))}).drop("all")
    none = {f"n_{name}": F.lit(0).cast("long") for name, *_ in KINDS} | {"base": F.lit(""), "spans": F.lit(""), "n_live": F.lit(0).cast("long"), "n_copied": F.lit(0).cast("long")}
    heads = found.where("head")
    some = heads.where("kind is not null").select("uid", "doc_id").join(made, "uid", "left").select("doc_id", *(F.coalesce(c, none[c]).alias(c) for c in none))
    rest = heads.where("kind is null").select("doc_id", *(none[c].alias(c) for c in none))
    return some.unionByName(rest).select("doc_id", *(f"n_{name}" for name, *_ in BASE), F.sha2("base", 256).alias("base_sha256"), "spans", f"n_{KINDS[KNOWN][0]}", "n_live", "n_copied")


def masked(text: Column, found: Column, digests: Column) -> Column:
    """text with each value of `found` whose digest is among `digests` masked; values that overlap have one mask."""
    spans_type = "array<struct<start:bigint,end:bigint>>"

    def placed(acc, m):
        end = F.when(m["nth"] == 0, F.lit(0).cast("long")).otherwise(acc["at"]) + m["before"] + m["size"]
        start, key = end - F.length(m["value"]), key_of(m["value"])
        span = F.struct(start.alias("start"), (start + F.length(key)).alias("end"))
        return F.struct(end.alias("at"), F.when(F.array_contains(digests, F.sha2(key, 256)), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def written(acc, s):
        apart = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(MASK))
        return F.struct(F.when(apart, more).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(spans_type).alias("spans"))
    spans = F.array_sort(F.aggregate(found, none, placed, lambda acc: acc["spans"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(spans, start, written, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: Column | str) -> DataFrame:
    """df with live-looking credentials masked, with and without their key words; copied examples stay. All values are found in
    the text as it was. Rows are told by id and text, so null ids are no group."""
    found = materialize(candidates(df, id_col, text_col, **columns))
    names = {c: unused(df, c) for c in ("own_id", "own_mark", "digests")}
    live = classified(found).where("live").groupBy(F.col("doc_id").alias(names["own_id"]), F.col("mark").alias(names["own_mark"])).agg(F.collect_set("digest").alias(names["digests"]))
    live = materialize(live)
    forget(found)
    digests, text = F.col(names["digests"]), F.col(text_col)
    same = df[id_col].eqNullSafe(F.col(names["own_id"])) & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == F.col(names["own_mark"]))
    joined = df.join(live, same, "left")
    text = F.when(digests.isNotNull() & text.isNotNull(), masked(text, found_in(text), digests)).otherwise(text)
    kept = [f.name for f in df.schema]
    return joined.select(*(text.alias(text_col) if c == text_col else F.col(c) for c in kept))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents. A source is an owner, its part in one language a repository."""
    return spans(table(spark, sf_dir, "documents"), repo=F.concat_ws("/", "source", "lang"), owner="source")


_QUOTED = [(n, (RUN if n == "known" else p).replace("'", "''"), g, m) for n, p, g, m in KINDS]
SQL = rf"""
WITH docs AS (SELECT doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
found AS (
  {" UNION ALL ".join(f"SELECT doc_id, source, repo, {k} AS kind, {m} AS least, regexp_split_to_array(t, '{p}') AS pieces, regexp_extract_all(t, '{p}', 0) AS whole, regexp_extract_all(t, '{p}', {g}) AS val FROM docs" for k, (n, p, g, m) in enumerate(_QUOTED))}),
each AS (SELECT doc_id, source, repo, kind, least, i, length(pieces[i]) AS before, length(whole[i]) AS size, val[i] AS val, rtrim(val[i], '.') AS key
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found)),
placed AS (SELECT *, sum(before + size) OVER (PARTITION BY doc_id, kind ORDER BY i) - size AS start FROM each),
base AS (SELECT doc_id, source, repo, kind, start, start + size AS stop, key FROM placed WHERE kind < {KNOWN} AND length(val) >= least),
owners AS (SELECT key, count(DISTINCT source) AS n, count(DISTINCT repo) AS r FROM base GROUP BY key),
status AS (SELECT key, copied, NOT copied AND len(list_distinct(string_split(key, ''))) >= {LIVE_CHARACTERS} AS live
  FROM (SELECT *, n >= {COPIED_OWNERS} OR r >= {COPIED_REPOS} AS copied FROM owners)),
added AS (SELECT p.doc_id, p.kind, p.start, p.start + length(p.key) AS stop, p.key FROM placed p JOIN status s USING (key)
  WHERE p.kind = {KNOWN} AND length(p.key) >= p.least AND s.live AND regexp_matches(p.key, '[0-9]')),
fresh AS (SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.start < a.stop AND a.start < b.stop)),
marked AS (SELECT x.*, s.copied, s.live FROM (SELECT doc_id, kind, start, stop, key FROM base UNION ALL SELECT doc_id, kind, start, stop, key FROM fresh) x JOIN status s USING (key)),
named AS (SELECT *, [{", ".join(f"'{n}'" for n, *_ in KINDS)}][kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM marked),
per AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{n}" for k, (n, *_) in enumerate(KINDS))},
  string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {KNOWN}) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied FROM named GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n, *_ in KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs d LEFT JOIN per USING (doc_id)
"""
