"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words and a few shape features gives a document's score s; ordered thresholds t1 < t2 < ...
turn it into P(grade >= k) = logistic(s - t_k). Weights and thresholds are trained together (Adagrad on the likelihood of the
grades, thresholds kept ordered as a first one and positive steps). Training uses a bounded sample of the rated documents
(`sample` rows, those of the smallest id hashes, a parameter); features that fewer than `least` of them have are left out, as
their weights would only learn those documents by heart. Every document is scored, whole.

Rows: a null or empty text has shape features only; ratings that are null or without a document are left out; a document
rated twice counts twice. Without any rating there is no model: every grade is equally likely and every document is selected.
Repeated and null ids are kept, one result per row. `score` replaces input columns that have its results' names; `selected_rows`
keeps all columns. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, lean, mix, table
from .shingles import word_hashes

BITS, SAMPLE, EPOCHS, RATE, DECAY, LEAST = 18, 24000, 40, 0.2, 2e-5, 3
#: A document is selected if P(top grade) reaches this.
KEEP = 0.5
#: ASCII punctuation and white space part words here.
_PARTS = np.zeros(256, bool)
_PARTS[:48] = _PARTS[58:65] = _PARTS[91:97] = _PARTS[123:128] = True
_KINDS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 white space, 5 full stop or comma, 6 other punctuation
_KINDS[33:48] = _KINDS[58:65] = _KINDS[91:97] = _KINDS[123:127] = 6
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[[32, *range(9, 14)]], _KINDS[[44, 46]] = 1, 2, 3, 4, 5


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(indices, offsets): the distinct feature numbers of every text."""
    data, offsets = buffers(column)
    words, owner = word_hashes(data, offsets, _PARTS)
    index = (words & np.uint64((1 << bits) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))])
    out = []
    for a, b, s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = np.sort(index[s:e])
        own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
        count, n = np.bincount(_KINDS[data[a:b]], minlength=7), max(1, b - a)
        ratios = [*(count / n), len(own) / max(1, e - s), min(1.0, (e - s) / n * 4)]
        level = np.minimum(9, (np.sqrt(ratios) * 10).astype(np.int64))
        shape = np.array([*(k * 16 + v for k, v in enumerate(level.tolist())), 150 + min(9, (e - s).bit_length())], np.uint64)
        out.append(np.concatenate([own, (mix(shape, 77) & np.uint64((1 << bits) - 1)).astype(np.int64) | 1 << bits]))
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


class Ordinal:
    """weights by feature number, thresholds in increasing order. `blank`: fitted on no rating."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, blank: bool = False):
        self.weights, self.thresholds, self.blank = weights, thresholds, blank

    def selects(self, tails: np.ndarray, keep: float) -> np.ndarray:
        """Whether the top grade is likely enough; without a model everything is."""
        return np.ones(len(tails), bool) if self.blank else tails[:, -1] >= keep

    def scores(self, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[index])])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -40, 40)))


def gradient(s: np.ndarray, t: np.ndarray, g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean log-likelihood of grades g under scores s and thresholds t, and its gradients by s and by t."""
    p = np.concatenate([np.ones((len(s), 1)), 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -40, 40))), np.zeros((len(s), 1))], 1)
    r = np.arange(len(s))
    hi, lo = p[r, g], p[r, g + 1]
    like = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / like, lo * (1 - lo) / like
    dt = np.zeros(len(t) + 2)
    np.add.at(dt, g, -d_hi / len(s))
    np.add.at(dt, g + 1, d_lo / len(s))
    return float(np.log(like).mean()), (d_hi - d_lo) / len(s), dt[1:-1]


def fit(index: np.ndarray, offsets: np.ndarray, grades: np.ndarray, top: int, bits: int = BITS, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, least: int = LEAST, seed: int = 5) -> Ordinal:
    w, size = np.zeros(2 << bits), 256
    start = np.linspace(-1, 1, top) if top > 1 else np.zeros(1)
    theta = np.concatenate([start[:1], np.log(np.diff(start))])
    if not len(grades):
        share = np.log(np.arange(1, top + 1) / (top + 1 - np.arange(1, top + 1)))
        return Ordinal(w, share, blank=True)
    if len(grades) >= least:
        common = (np.bincount(index, minlength=len(w)) >= least)[index]
        index, offsets = index[common], np.concatenate([[0], np.cumsum(common)])[offsets]
    grad_w, grad_t = np.full(len(w), 1e-2), np.full(top, 1e-2)
    rng, lengths = np.random.default_rng(seed), np.diff(offsets)
    cut = lambda t: np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])
    for _ in range(epochs):
        order = rng.permutation(len(grades))
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            n = lengths[rows]
            doc = np.repeat(np.arange(len(rows)), n)
            idx = index[np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
            s = np.bincount(doc, w[idx], len(rows))
            t = cut(theta)
            _, ds, dt = gradient(s, t, grades[rows])
            step = np.bincount(idx, ds[doc], len(w))
            seen = np.flatnonzero(step)
            step = step[seen] - decay * w[seen]
            grad_w[seen] += step**2
            w[seen] += rate * step / np.sqrt(grad_w[seen])
            own = np.concatenate([[dt.sum()], [dt[k:].sum() * np.exp(theta[k]) for k in range(1, top)]])
            grad_t += own**2
            theta += rate * own / np.sqrt(grad_t)
    return Ordinal(w, cut(theta))


def train(docs: DataFrame, ratings: DataFrame, top: int, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Fit on `sample` of the rated documents: ratings(id, grade 0..top). One task fits; only the weights come to the driver."""
    rated = ratings.where(F.col("grade").between(0, top)).select(F.col(id_col).alias("rated_id"), F.col("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(sample)

    def numbers(batches):
        for batch in batches:
            index, offsets = features(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["grade"], pa.array([index[a:b].astype("<i4").tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["grade", "features"])

    def fitting(batches):
        held, sizes, rated = [], [0], []
        for batch in batches:
            data, offsets = buffers(batch["features"])
            held.append(data.view("<i4").astype(np.int32))
            sizes += (np.diff(offsets) // 4).tolist()
            rated += batch["grade"].to_pylist()
        if not rated:
            return
        model = fit(np.concatenate(held), np.cumsum(sizes), np.array(rated, np.int64), top)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))], names=["weights", "thresholds"])

    # the sample's size is bounded by the parameter, and so are what is broadcast here and the one task that fits
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    own = texts.join(F.broadcast(chosen), F.col("id") == F.col("rated_id")).select("grade", "text")
    got = own.mapInArrow(lean(numbers), "grade int, features binary").repartition(1).mapInArrow(lean(fitting), "weights binary, thresholds array<double>").first()
    if got is None:
        return fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), top)
    return Ordinal(np.frombuffer(got["weights"], "<f4").astype(np.float64), np.array(got["thresholds"]))


def score(df: DataFrame, model: Ordinal, text_col: str = "text", keep_text: bool = True, keep: float = KEEP) -> DataFrame:
    """df with p_ge_1 .. p_ge_top (tail probabilities), expected_grade and selected."""
    shared, top = df.sparkSession.sparkContext.broadcast(model), len(model.thresholds)  # weights of fixed size
    more = [*(T.StructField(f"p_ge_{k}", T.DoubleType()) for k in range(1, top + 1)), T.StructField("expected_grade", T.DoubleType()), T.StructField("selected", T.BooleanType())]
    carried = [f for f in df.schema if (keep_text or f.name != text_col) and f.name not in {x.name for x in more}]
    schema = T.StructType([*carried, *more])
    names = [f.name for f in schema]

    def scoring(batches):
        for batch in batches:
            p = shared.value.tails(shared.value.scores(*features(batch[text_col])))
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in carried), *(pa.array(p[:, k]) for k in range(top)), pa.array(p.sum(axis=1)), pa.array(shared.value.selects(p, keep))], names=names)

    return df.mapInArrow(lean(scoring), schema)


def selected_rows(df: DataFrame, model: Ordinal, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of df that the model selects, as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # weights of fixed size

    def selecting(batches):
        for batch in batches:
            p = shared.value.tails(shared.value.scores(*features(batch[text_col])))
            yield batch.filter(pa.array(shared.value.selects(p, keep)))

    return df.mapInArrow(lean(selecting), df.schema)


def grades(labels: DataFrame) -> DataFrame:
    """Grade 0: toxic; 1: harmless, but of low quality; 2: good."""
    good: Column = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", good.alias("grade"))


def rated_model(spark: SparkSession, sf_dir: str) -> Ordinal:
    return train(table(spark, sf_dir, "documents").select("doc_id", "text"), grades(table(spark, sf_dir, "labels")), 2)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tail probabilities, expected grade and selection of every document."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), rated_model(spark, sf_dir), keep_text=False)


def confusion(scored: pd.DataFrame) -> pd.DataFrame:
    return pd.crosstab(scored["grade"], scored["selected"])
