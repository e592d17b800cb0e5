"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's UTF-8 bytes. Chunk boundaries are normalised: before the target size a boundary needs a
strict mask, after it a loose one, between a least and a largest size. The fingerprint is the set of chunk digests with their
lengths, so an insertion or deletion changes only the chunks around it; the likeness of two fingerprints is the share of the
first one's bytes whose chunks the second one has too.

Rows: null text counts as empty; an empty text has an empty fingerprint, which is like another empty one (1) and like nothing
else (0). Null ids are the greatest and so come first; rows of one id are ordered by a hash of their text. A table of one
document takes itself as the next one; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, lean, partitions, table

LEAST, TARGET, MOST, STRICT_BITS, LOOSE_BITS = 16, 48, 256, 8, 4
GEAR = np.random.Generator(np.random.PCG64(32)).integers(0, 1 << 32, 256, dtype=np.uint32)
_SEGMENT, _WINDOW = 1 << 22, 32
#: Text of a range of documents, about.
RANGE_BYTES = 64 << 20


def candidates(data: np.ndarray) -> tuple[list[int], list[int]]:
    """Ends of the 32-byte windows whose gear hash fits the strict mask, and the loose one."""
    strict, loose = [], []
    for at in range(0, len(data), _SEGMENT):
        back = min(at, _WINDOW - 1)
        h = GEAR[data[at - back : at + _SEGMENT]]
        for step in (1, 2, 4, 8, 16):
            h[step:] += h[:-step] << np.uint32(step)
        h = h[back:]
        fit = np.flatnonzero(h < (1 << (32 - LOOSE_BITS)))
        loose.append(fit + at + 1)
        strict.append(fit[h[fit] < (1 << (32 - STRICT_BITS))] + at + 1)
    return (np.concatenate(strict).tolist(), np.concatenate(loose).tolist()) if strict else ([], [])


def boundaries(data: np.ndarray) -> list[int]:
    strict, loose = candidates(data)
    out, s, n, a, b = [], 0, len(data), 0, 0
    while s < n:
        a = bisect_left(strict, s + LEAST, a)
        if a < len(strict) and strict[a] < s + TARGET:
            e = strict[a]
        else:
            b = bisect_left(loose, s + TARGET, b)
            e = loose[b] if b < len(loose) and loose[b] < s + MOST else s + MOST
        s = min(e, n)
        out.append(s)
    return out


def fingerprint(raw: bytes) -> np.ndarray:
    """Sorted distinct values of 48 bits of digest and 16 of length, one for each chunk."""
    view, s, out = memoryview(raw), 0, []
    for e in boundaries(np.frombuffer(raw, np.uint8)):
        out.append((xxhash.xxh3_64_intdigest(view[s:e]) & 0xFFFFFFFFFFFF) << 16 | (e - s))
        s = e
    return np.unique(np.array(out, np.uint64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a):
        return float(not len(b))
    lengths = (a & np.uint64(0xFFFF)).astype(np.int64)
    return float(lengths[np.isin(a, b, assume_unique=True)].sum() / lengths.sum())


def written(f: np.ndarray) -> str:
    return base64.b64encode(f.astype("<u8").tobytes()).decode()


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_SCHEMA = pa.schema([(a, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[b]) for a, b in (x.split() for x in OUT.split(", "))])


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts up to a key, found among the square root of their number and then of as many between two of those."""
    step = max(1, int(len(cuts) ** 0.5))
    upto = lambda some: F.size(F.filter(some, lambda c: c <= key))
    if not cuts:
        return F.lit(0)
    group = upto(F.array(*map(F.lit, cuts[::step])))
    inner = F.array(*(F.array(*map(F.lit, cuts[k : k + step])) for k in range(0, len(cuts), step)))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + upto(F.element_at(inner, F.greatest(group, F.lit(1)))))


def neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(doc_id, text, k), k distinct, dealt into ranges of k; each range also holds the document that follows its last one
    in descending order (halo). Only one key for each range comes to the driver."""
    spark = docs.sparkSession
    cuts = sorted({int(c) for c in docs.select(F.col("k").cast("double")).approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else []
    keyed = docs.withColumn("bucket", bucket_of(F.col("k"), cuts))
    heads = [tuple(r) for r in keyed.groupBy("bucket").agg(F.max("k")).orderBy(F.desc("bucket")).collect()]
    if not heads:
        return keyed.withColumn("halo", F.lit(False))
    follows = spark.createDataFrame([(heads[(i + 1) % len(heads)][1], b) for i, (b, _) in enumerate(heads)], "k long, to int").groupBy("k").agg(F.collect_list("to").alias("to"))
    places = F.concat(F.array(F.struct(F.col("bucket"), F.lit(False).alias("halo"))), F.transform(F.coalesce("to", F.array().cast("array<int>")), lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("halo"))))
    # one row a range on the broadcast side: its size is bounded by the number of ranges
    return keyed.join(F.broadcast(follows), "k", "left").select("doc_id", "text", "k", F.explode(places).alias("p")).select("doc_id", "text", "k", "p.*")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited text, and how like it is to that and to the next document."""
    n = partitions(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = keyed(docs, "doc_id", "text", "k")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for i, text, bucket, halo in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "bucket", "halo")), strict=True):
                now = (bucket, i, text, fingerprint(text.encode()))
                if held and held[0] == bucket:
                    _, j, own, f = held
                    k = len(own) // 3
                    edited = (own[: len(own) - k] + text[:k]).encode()
                    g = fingerprint(edited)
                    out.append((j, len(own), hashlib.sha256(edited).hexdigest(), written(f), written(g), likeness(f, g), likeness(f, now[3])))
                held = None if halo else now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    near = neighbours(docs, max(4 * n, size // RANGE_BYTES)).repartition(max(n, size // RANGE_BYTES), "bucket").sortWithinPartitions("bucket", "halo", F.desc("k"))
    return near.mapInArrow(lean(run), OUT)


def op3_cdc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return fingerprints(table(spark, sf_dir, "documents"))
