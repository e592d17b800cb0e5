"""N-gram Jaccard self-join with grouped prefixes.

1. All texts' shingles are counted in counters of bounded size. They order the shingles, rarest first; the order decides the
   speed, never the result.
2. A set's prefix is its first n - ceil(t n) + 1 elements. Two sets that reach the threshold t share a prefix element.
   Documents with the same prefix and size collapse into one group; each group is posted once for each prefix element
   (packed by buckets). Under each element, groups in size order form stretches within which sizes may link; two groups
   alone are also held to the position filter. A stretch is tied to its first group: a number of ties linear in the
   postings. Map tasks tie their own postings first and pass on one for each stretch, so that an element shared by a third
   of all groups reaches its bucket as a few postings of each task.
3. The components of these ties hold every pair that could link, and many that could not. Their sets' bitmaps, in which every
   shingle flips one bit, come together (in pairs of blocks, if a component is large): two sets differ by as many shingles as
   their bitmaps differ by bits, at least. Pairs that this bound rules out fall apart.
4. What still holds together is expanded: the sets themselves come together and are verified by counting common shingles. The
   components of the links found are the result.

Equal sets are one member, so copies are never paired. Shingles are told apart by 64 bits, sets by 127.

Rows: every row gives one row; null or empty texts have no shingles and link with nothing; texts of a repeated id share its
links; a null id has the class of its set's other documents, or null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOBS, forget, gathered, is_marked, lean, marks, materialize, mix, packed, partitions, runs, sketch, table, zstd
from .graph import components
from .shingles import shingle_sets

#: Counters for so many shingles each, within these bounds; 32 MB is the most that is ever broadcast.
SHINGLES_A_COUNTER, FEWEST, MOST = 8, 1 << 20, 1 << 25
#: `place` is LOOSE where a posting stands for a stretch of sizes lo..hi.
POSTING = np.dtype([("token", "<u8"), ("lo", "<u4"), ("hi", "<u4"), ("group", "<i8"), ("place", "<u4")])
LOOSE = 0xFFFFFFFF
#: Postings of a bucket, postings after which a map task passes on what it has, members of a block.
BUCKET_POSTINGS, FLUSH, BLOCK = 200_000, 400_000, 2048
#: Bytes of each field that a bucket gets. Tokens and groups are hashes; where cut ones meet, ties are added, never lost, and
#: verifying drops them. A bucket is chosen by the whole token and its postings are bounded, so cut tokens hardly ever meet.
PLANES = (("token", 5), ("group", 7), ("lo", 4), ("hi", 4), ("place", 4))
EDGES = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def signatures(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free digests of each set, of 63 and 64 bits."""
    out = []
    for salt in (7, 17):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements, salt))])
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + (offsets[1:] - offsets[:-1]).astype(np.uint64), salt - 4))
    return (out[0] >> np.uint64(1)).astype(np.int64), out[1].view(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b that link: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def tie(r: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(ties between groups, postings with each stretch as one) of postings."""
    r = np.unique(r)  # by token, lo
    if len(r) < 2:
        return np.zeros((0, 2), np.int64), r
    rank = np.cumsum(np.concatenate([[0], r["token"][1:] != r["token"][:-1]])).astype(np.uint64)
    reach = (np.maximum.accumulate(rank << np.uint64(32) | r["hi"].astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (100 * reach[:-1] < percent * r["lo"][1:].astype(np.int64))])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(r)))
    two = first[length == 2]
    a, b = r[two], r[two + 1]
    na, nb, pa_, pb = (x.astype(np.int64) for x in (a["lo"], b["lo"], a["place"], b["place"]))
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
    new[two[(pa_ != LOOSE) & (pb != LOOSE) & (most < needed(na, nb, percent))] + 1] = True
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(r)))
    ties = np.stack([np.repeat(r["group"][first], length - 1), r["group"][~new]], 1)
    kept = r[first]
    kept["hi"] = np.maximum.reduceat(r["hi"], first)
    kept["place"][length > 1] = LOOSE
    return np.unique(ties[ties[:, 0] != ties[:, 1]], axis=0), kept


def planes_of(r: np.ndarray) -> bytes:
    """Postings of a bucket by cut token, as compressed byte planes: tokens as differences, `hi` as what it exceeds `lo` by."""
    r = r.copy()
    r["token"] &= np.uint64((1 << 40) - 1)
    r.sort(order="token")
    r["token"] = np.diff(r["token"], prepend=np.uint64(0))
    r["hi"] -= r["lo"]
    planes = [r[f].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T for f, width in PLANES]
    return len(r).to_bytes(8, "little") + zstd().compress(np.concatenate(planes).tobytes(), asbytes=True)


def from_planes(blob: bytes, offset: int = 0) -> np.ndarray:
    n, total = int.from_bytes(blob[offset : offset + 8], "little"), sum(width for _, width in PLANES)
    planes = np.frombuffer(zstd().decompress(blob[offset + 8 :], n * total), np.uint8).reshape(total, n)
    r, at = np.empty(n, POSTING), 0
    for f, width in PLANES:
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :width] = planes[at : at + width].T
        r[f] = whole.view("<u8")[:, 0]
        at += width
    r["token"] = np.cumsum(r["token"])
    r["hi"] += r["lo"]
    return r


def _postings(batches, counts, percent: int, buckets: int):
    """Packed rows: edges (first byte 0) and postings (first byte 1)."""
    width, held, ties, size = np.uint64(len(counts) - 1), [], [], 0

    def flush():
        if held:
            more, kept = tie(np.concatenate(held), percent)
            docs = np.unique(np.array(ties, np.int64), axis=0)
            edges = np.concatenate([np.concatenate([np.zeros((len(docs), 1), np.int64), docs], 1), np.concatenate([np.ones((len(more), 1), np.int64), more], 1)])
            for flag, records, key, written in ((b"\0", np.ascontiguousarray(edges), edges[:, 2].astype(np.uint64), np.ndarray.tobytes), (b"\1", kept, kept["token"], planes_of)):
                for b in packed(records, (mix(key, 12) % np.uint64(buckets)).astype(np.int64), BLOBS, written):
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flag + x for x in b.column(1).to_pylist()], pa.binary())], schema=BLOBS)

    for batch in batches:
        elements, offsets = shingle_sets(batch["text"])
        sign, _ = signatures(elements, offsets)
        keys = counts[elements & width].astype(np.uint64) << np.uint64(52) | elements & np.uint64((1 << 52) - 1)
        for s, a, b in zip(sign.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if a == b:
                continue
            p = prefix_length(b - a, percent)
            k = keys[a:b]
            k = np.sort(np.partition(k, p - 1)[:p]) if p < len(k) else np.sort(k)
            g = int(mix(np.array([mix(k, 4).sum() + np.uint64(b - a)]), 21)[0] >> np.uint64(8))
            ties.append((s, g))
            r = np.empty(len(k), POSTING)
            r["token"], r["group"], r["lo"], r["hi"], r["place"] = k, g, b - a, b - a, np.arange(len(k))
            held.append(r)
            size += len(k)
        if size > FLUSH:
            yield from flush()
            held, ties, size = [], [], 0
    yield from flush()


def verified(members: list[tuple[int, int, np.ndarray]], percent: int, cross: bool) -> list[tuple[int, int]]:
    """Links that span the components of members (name, side, set); only between sides 0 and 1 if cross."""
    members = sorted(members, key=lambda m: len(m[2]))
    sizes = np.array([len(m[2]) for m in members], np.int64)
    side = np.array([m[1] for m in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    _, token = np.unique(np.concatenate([m[2] for m in members]), return_inverse=True)
    order = np.argsort(token, kind="stable")  # postings, by token and then by member
    posted = owner[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(token))])[token]
    here = np.empty(len(order), np.int64)
    here[order] = np.arange(len(order))
    sets, links, at = Sets(len(members)), [], np.concatenate([[0], np.cumsum(sizes)])
    for x in range(1, len(members)):
        s, e = start[at[x] : at[x + 1]], here[at[x] : at[x + 1]]
        n = e - s
        if not n.any():
            continue
        places = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        overlap = np.bincount(posted[places], minlength=x)
        for y in np.flatnonzero(overlap * (100 + percent) >= percent * (sizes[:x] + sizes[x])).tolist():
            if not (cross and side[x] == side[y]) and sets.join(x, y):
                links.append((members[x][0], members[y][0]))
    return links


def bitmap(elements: np.ndarray) -> bytes:
    """Bits that the elements flip, two to four for each; with its upper half folded onto the lower, that of half the size."""
    bits = max(64, 1 << (2 * len(elements) - 1).bit_length())
    return np.packbits(np.bincount((elements >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


class Sets:
    """Union-find over members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        self.parent[a] = b
        return a != b


def possible(members: list[tuple[int, int, int, bytes]], percent: int, cross: bool) -> list[tuple[int, int]]:
    """Pairs that span the components of members (name, side, size, bitmap) whose sizes and bitmaps leave a link possible; only
    between sides 0 and 1 if cross."""
    members = sorted(members, key=lambda m: m[2])
    sizes, side = np.array([m[2] for m in members], np.int64), np.array([m[1] for m in members])
    wide = np.array([len(m[3]) for m in members])
    maps = {w: np.frombuffer(b"".join(m[3] for m in members if len(m[3]) == w), "<u8").reshape(-1, w // 8) for w in set(wide.tolist())}
    head = {w: int(np.searchsorted(wide, w)) for w in maps}
    sets, links = Sets(len(members)), []
    for x in range(1, len(members)):
        own, y0 = maps[wide[x]][x - head[wide[x]]], int(np.searchsorted(100 * sizes, percent * sizes[x]))
        w = int(wide[x])
        while w >= 8 and y0 < x:
            if w in maps:
                a, b = max(y0, head[w]), min(x, head[w] + len(maps[w]))
                if a < b:
                    apart = np.bitwise_count(maps[w][a - head[w] : b - head[w]] ^ own).sum(1).astype(np.int64)
                    both = sizes[a:b] + sizes[x]
                    for y in (a + np.flatnonzero((both - apart) // 2 * (100 + percent) >= percent * both)).tolist():
                        if not (cross and side[x] == side[y]) and sets.join(x, y):
                            links.append((members[x][0], members[y][0]))
            if w == 8 or head.get(w, x) <= y0:
                break
            own, w = own[: len(own) // 2] ^ own[len(own) // 2 :], w // 2
    return links


def _tied(docs: DataFrame, counts, postings: float, percent: int) -> DataFrame:
    """(id, component) of the sets' digests and groups that ties hold together."""
    n = partitions(docs.sparkSession)
    buckets = max(n, int(postings // BUCKET_POSTINGS) + 1)

    def meeting(_, blobs):
        edges = [np.frombuffer(b, "<i8", offset=1).reshape(-1, 3) for b in blobs if b[0] == 0]
        posted = [from_planes(b, 1) for b in blobs if b[0] == 1]
        if posted:
            ties, _ = tie(np.concatenate(posted), percent)
            edges.append(np.concatenate([np.ones((len(ties), 1), np.int64), ties], 1))
        e = np.unique(np.concatenate(edges), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].astype(np.int32)), pa.array(e[:, 1]), pa.array(e[:, 2])], schema=EDGES)

    posted = docs.select("text").mapInArrow(lean(lambda it: _postings(it, counts.value, percent, buckets)), "bucket long, blob binary")
    ties = materialize(gathered(posted, meeting, "kind int, a long, b long", n).distinct())
    between = ties.where("kind = 1").select("a", "b")
    own = ties.where("kind = 0").select("a", "b")
    active = own.groupBy("b").count().where("count > 1").select("b").union(between.select("a")).union(between.select("b")).distinct()
    near = components(between.union(own.join(active, "b", "left_semi").select("a", "b")))
    forget(ties)
    return near


def _several(members: DataFrame) -> DataFrame:
    """The members of components that hold more than one, with `members`, their number; written."""
    sizes = members.groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
    return materialize(members.join(sizes, "component"))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(component, members, sign, ...) by `task`: a component, or each pair of its blocks if it is large."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("sign"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    task = F.concat_ws("/", "component", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select("*", task.alias("task"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") != F.col("other")).alias("crossed")).drop("component", "members", "block", "other")
    return rows.repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task")


def _reps(members: DataFrame) -> np.ndarray:
    return marks(members.select("rep"), lambda batch: [batch["rep"].fill_null(-1).to_numpy()])


def _kept(batches, bitmap_of_ids: np.ndarray):
    """Rows(doc_id, text) whose ids are marked, with their sets' digests; equal sets of one id once for each task."""
    seen: set[tuple] = set()
    for batch in batches:
        batch = batch.filter(pa.array(is_marked(bitmap_of_ids, batch["doc_id"].fill_null(-1).to_numpy())))
        sign, check = signatures(*shingle_sets(batch["text"]))
        new = []
        for row in zip(batch["doc_id"].to_pylist(), sign.tolist(), check.tolist(), strict=True):
            new.append(row not in seen)
            seen.add(row)
        keep = pa.array(new, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch["doc_id"].filter(keep), batch["text"].filter(keep), pa.array(sign).filter(keep), pa.array(check).filter(keep)], names=["doc_id", "text", "sign", "check"])


def ngram_components(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of df."""
    spark = df.sparkSession
    n, sc = partitions(spark), spark.sparkContext
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def measuring(batches):
        for batch in batches:
            elements, offsets = shingle_sets(batch["text"])
            sign, check = signatures(elements, offsets)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(offsets)), pa.array(sign), pa.array(check)], names=["doc_id", "n_shingles", "sign", "check"])

    base = materialize(docs.mapInArrow(lean(measuring), "doc_id long, n_shingles long, sign long, check long"))
    reps = materialize(base.where("n_shingles > 0").groupBy("sign", "check").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles")))
    postings = lambda sets: sets.agg(F.sum(F.col("n_shingles") * (100 - percent) / 100 + 1)).first()[0] or 0
    shingles = base.agg(F.sum("n_shingles")).first()[0] or 0
    width = min(MOST, max(FEWEST, 1 << (int(shingles) // SHINGLES_A_COUNTER).bit_length()))
    counts = sc.broadcast(sketch(docs.select("text"), lambda b: shingle_sets(b["text"])[0], width))
    near = _tied(docs, counts, postings(reps), percent).withColumnRenamed("id", "sign")
    first = _several(reps.join(near, "sign"))
    member = F.expr("t.sign = m.sign and t.check = m.check and t.doc_id <=> m.rep")
    own = ["component", "members", "m.sign", "m.check", "rep"]

    def sketched(batches):
        for batch in _kept(batches, bits.value):
            elements, offsets = shingle_sets(batch["text"])
            maps = [bitmap(elements[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "sign", "check")), pa.array(np.diff(offsets)), pa.array(maps, pa.binary())], names=["doc_id", "sign", "check", "size", "bits"])

    def filtering(batches):
        for group in runs(batches, "task"):
            found = {(r["sign"], r["check"]): (r["sign"], r["side"], r["size"], r["bits"]) for r in group}
            links = possible(list(found.values()), percent, group[0]["crossed"]) if len(found) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    bits = sc.broadcast(_reps(first))  # bounded by marks()
    maps = docs.mapInArrow(lean(sketched), "doc_id long, sign long, check long, size long, bits binary").alias("t").join(first.alias("m"), member)
    links = _dealt(maps.select(*own, "size", "bits")).mapInArrow(lean(filtering), "a long, b long")
    near = components(links).withColumnRenamed("id", "sign")
    members = _several(first.drop("component", "members").join(near, "sign"))
    forget(first)

    def wanted(batches):
        for batch in _kept(batches, later.value):
            yield batch.select(["doc_id", "text", "sign", "check"])

    def expanding(batches):
        for batch in batches:
            elements, offsets = shingle_sets(batch["text"])
            blobs = [elements[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("component", "members", "sign", "check", "rep")), pa.array(blobs, pa.binary())], names=["component", "members", "sign", "check", "rep", "blob"])

    later = sc.broadcast(_reps(members))  # bounded by marks()
    texts = docs.mapInArrow(lean(wanted), "doc_id long, text string, sign long, check long").alias("t").join(members.alias("m"), member)
    expanded = texts.select(*own, "text").mapInArrow(lean(expanding), "component long, members long, sign long, check long, rep long, blob binary")

    def verifying(batches):
        for group in runs(batches, "task"):
            # by set: different sets of a repeated id have one rep
            found = {(r["sign"], r["check"]): (r["rep"], r["side"], np.frombuffer(r["blob"], np.uint64)) for r in group if r["rep"] is not None}
            links = verified(list(found.values()), percent, group[0]["crossed"]) if len(found) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    links = _dealt(expanded).mapInArrow(lean(verifying), "a long, b long")
    classes = components(links).select(F.col("id").alias("rep"), "component")
    heads = materialize(reps.select("sign", "check", "rep").join(classes, "rep", "left").select("sign", "check", F.coalesce("component", "rep").alias("component")))
    forget(reps, members)
    # texts of one repeated id may differ; the smallest id of their classes holds
    return base.join(heads, ["sign", "check"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents under five-word shingles and a similarity of 0.8."""
    return ngram_components(table(spark, sf_dir, "documents"))
