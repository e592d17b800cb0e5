"""Packing of token sequences by best-fit decreasing.

Documents are tokenised where they are read; of their ids only lengths and checksums travel. A document longer than a window
is cut into full windows first, which are sequences by themselves; what is left over of each document is packed: pieces are
dealt into shards of bounded size, and in each shard, longest first, a segment tree indexed by remaining capacity gives the
tightest open window that still holds the piece, or a new window is opened. A shard wastes a few windows at most.

Rows: a null or empty text has only its end id; null and repeated document ids are kept, each row packed by itself; ties in
length go by document id; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, safe_slices
from .common import lean, materialize, table

WINDOW, END = 1024, 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


@lru_cache(maxsize=2)
def _json_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text: str, json_path: str, rank_path: str | None, pattern: str) -> bytes:
    """Ids by the tokenizers library, packed. The same vocabulary as ranks, where given, serves the texts of common characters
    faster; texts with other characters or with the special token's string take the library itself."""
    from .bpe import _OTHER

    if rank_path and "<|endoftext|>" not in text and not _OTHER.search(text):
        return encoder(rank_path, pattern).encode(text)
    t = _json_tokenizer(json_path)
    return b"".join(np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in safe_slices(text, 1 << 20))


def cut(df: DataFrame, json_path: str, rank_path: str | None, pattern: str, window: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """Full windows and leftovers of every document."""

    def run(batches):
        mark = np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = ids_of(text or "", json_path, rank_path, pattern) + mark
                n = len(ids) // 4
                out += [(i, a, min(window, n - a), zlib.crc32(ids[4 * a : 4 * (a + window)]), n) for a in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, schema=_SCHEMA)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), PIECES)


class OpenWindows:
    """Segment tree over remaining capacities: a node tells whether an open window has a capacity in its range."""

    def __init__(self, window: int):
        self.leaves = 1 << (window + 1).bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _mark(self, capacity: int) -> None:
        k = self.leaves + capacity
        self.any[k] = bool(self.open[capacity])
        while k > 1:
            k >>= 1
            now = self.any[2 * k] or self.any[2 * k + 1]
            if self.any[k] == now:
                break
            self.any[k] = now

    def put(self, capacity: int, name: int) -> None:
        self.open[capacity].append(name)
        if len(self.open[capacity]) == 1:
            self._mark(capacity)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the smallest capacity >= need."""
        k = self.leaves + need
        while not self.any[k]:
            while k & 1:  # right children: go up
                k >>= 1
                if k <= 1:
                    return None
            k += 1
        while k < self.leaves:
            k = 2 * k if self.any[2 * k] else 2 * k + 1
        capacity = k - self.leaves
        name = self.open[capacity].pop()
        if not self.open[capacity]:
            self._mark(capacity)
        return capacity, name


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; lengths must be in decreasing order."""
    tree, names, offsets, made = OpenWindows(window), [], [], 0
    for n in lengths:
        got = tree.take(n)
        if got is None:
            got, made = (window, made), made + 1
        capacity, name = got
        names.append(name)
        offsets.append(window - capacity)
        if capacity > n:
            tree.put(capacity - n, name)
    return names, offsets


def pack(df: DataFrame, json_path: str, rank_path: str | None, pattern: str, window: int = WINDOW, end: int = END, shard_rows: int = 40000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where its ids lie in the document and where in which sequence they go."""
    pieces = materialize(cut(df, json_path, rank_path, pattern, window, end, id_col, text_col))
    full = pieces.where(F.col("length") == window).select("*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < window)
    shards = max(1, -(-rest.count() // shard_rows))

    def shard(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "ids_crc32"], ascending=[False, True, True], kind="stable")
        names, offsets = best_fit_decreasing(part["length"].tolist(), window)
        return part.drop(columns="shard").assign(sequence_id=((key[0] << 32) + np.array(names, np.int64)) * 2, offset=np.array(offsets, np.int64))

    # rows of a table that is written: their numbers stand, and part equal rows
    packed = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards))).groupBy("shard").applyInPandas(shard, PIECES + ", sequence_id long, offset long")
    return full.unionByName(packed)


def pack_documents(df: DataFrame) -> DataFrame:
    import public_tokenizers as P

    return pack(df, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))
