"""Approximate nearest neighbours by collision counting.

Each of `projections` directions (random orthonormal bases, one after the other) gives a sorted array of one projection per
vector. A query opens, in every array, a window centred on its own projection; the windows' half-width grows by factors
(virtual rehashing: no array is rebuilt for a wider radius). A vector inside the windows of at least `threshold` of the arrays
has collided often enough and is verified by its exact distance. The search ends once the k-th verified distance fits the
radius that the windows stand for, or once `share` of the vectors and `spare` times k more are verified; as the number of
colliding vectors rises steeply with the width, the last factor before that is taken in small steps.

Vectors are dealt into blocks of bounded size, each vector into one; a block's arrays are built once, and all queries, the
smaller side, stream past every block. Collisions are counted where a block is, so none of them travel, and the k best of each
block meet in one ranking per query.

Rows: vectors that are null, empty, all zero, or hold null or non-finite components take no part, neither as query nor as
candidate; vectors of different length are never compared. Repeated ids are distinct candidates of other ids, a query never
meets a row with its own id; queries of one id have one ranking. Null ids take no part. Ties go to the smaller id. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, table

OUT = "query_id long, vec_id long, score double"
PROJECTIONS, THRESHOLD, SHARE, SPARE = 128, 0.8, 0.04, 4
#: Growth of the half-width in a round, and the small steps that a round is cut into near the end.
GROWTH, STEPS = 1.25, 12


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    """Columns of random orthonormal bases, scaled so that a projection of a displacement spreads like its length."""
    r = np.random.default_rng([seed, dim])
    bases = [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.concatenate(bases, 1)[:, :count] * np.sqrt(dim)


class SortedProjections:
    """The sorted arrays of one block of vectors, laid end to end."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = PROJECTIONS, threshold: float = THRESHOLD, share: float = SHARE, spare: int = SPARE, seed: int = 11):
        self.ids, self.vectors, self.need = ids, vectors, max(1, int(np.ceil(threshold * projections)))
        self.share, self.spare = share, spare
        self.a = directions(vectors.shape[1], projections, seed)
        p = vectors @ self.a
        self.order = np.argsort(p, axis=0, kind="stable").T.astype(np.int32)
        p = np.sort(p, axis=0).T
        self.least, self.most = float(p.min()) - 1, float(p.max()) + 1
        self.lift = np.arange(projections) * 2 * (self.most - self.least)  # keeps the arrays apart
        self.flat = (p + self.lift[:, None]).reshape(-1)
        self.order = self.order.reshape(-1)
        spread = np.quantile(p, 0.75, axis=1) - np.quantile(p, 0.25, axis=1)
        self.base = max(float(np.median(spread)) / 8, 1e-9)

    def window(self, h: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = (np.clip(h + s * half, self.least, self.most) + self.lift for s in (-1, 1))
        return np.searchsorted(self.flat, lo, "left"), np.searchsorted(self.flat, hi, "right")

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, distances, number of verified vectors) of the k nearest found."""
        n, h = len(self.ids), q @ self.a
        enough = k * self.spare + int(np.ceil(self.share * n))
        lo = hi = np.searchsorted(self.flat, np.clip(h, self.least, self.most) + self.lift)
        hits, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        found, dist, count, half, factor = np.zeros(0, np.int64), np.zeros(0), 0, self.base, GROWTH
        while True:
            left, right = self.window(h, half)
            new = np.concatenate([self.order[s] for a, b, c, d in zip(left.tolist(), lo.tolist(), hi.tolist(), right.tolist(), strict=True) for s in (slice(a, b), slice(c, d)) if s.start < s.stop] or [self.order[:0]])
            more = hits + np.bincount(new, minlength=n)
            fresh = np.flatnonzero((more >= self.need) & ~seen)
            if count + len(fresh) > enough and factor == GROWTH and half > self.base:
                factor = GROWTH ** (1 / STEPS)
                half = half / GROWTH * factor
                continue
            hits, lo, hi = more, left, right
            seen[fresh] = True
            count += len(fresh)
            fresh = fresh[self.ids[fresh] != query_id]
            if len(fresh):
                d = np.sqrt(((self.vectors[fresh] - q) ** 2).sum(axis=1))
                found, dist = np.concatenate([found, fresh]), np.concatenate([dist, d])
            # a vector at distance r is in four fifths of the windows once their half-width is 1.28 r; 1.5 leaves room for chance
            if count == n or count >= enough or len(dist) >= k and np.partition(dist, k - 1)[k - 1] * 1.5 <= half:
                best = np.lexsort((self.ids[found], dist))[:k]
                return self.ids[found][best], dist[best], count
            half *= factor


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, projections: int = PROJECTIONS, threshold: float = THRESHOLD, share: float = SHARE, spare: int = SPARE, block_rows: int = 16384, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query(id, v) among vectors(id, v)."""
    blocks = max(1, -(-vectors.count() // block_rows))
    dealt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks))
    block = vectors.select("id", "v", F.size("v").alias("dim"), dealt.alias("block"), F.lit(0).alias("side"))
    asked = queries.select("id", "v", F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("side"))
    rows = block.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "dim", "side")

    def run(batches):
        own, index, ids, held = None, None, [], []
        for batch in batches:
            place = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("block", "dim", "side")], 1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part, group = batch.slice(a, b - a), tuple(place[a, :2].tolist())
                if group != own:
                    own, index, ids, held = group, None, [], []
                if place[a, 2] == 0:
                    ids.append(part["id"].to_numpy().copy())
                    held.append(_vectors(part))
                    continue
                if index is None and held:
                    index = SortedProjections(np.concatenate(ids), np.concatenate(held), projections, threshold, share, spare, seed)
                    ids, held = [], []
                if index is not None:
                    for i, q in zip(part["id"].to_pylist(), _vectors(part), strict=True):
                        got, dist, _ = index.search(i, q, k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), i)), pa.array(got), pa.array(dist)], names=["query_id", "vec_id", "score"])

    local = rows.mapInArrow(lean(run), OUT)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every embedding whose id is divisible by 100, against all embeddings."""
    v = clean_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(v.where("id % 100 = 0"), v)
