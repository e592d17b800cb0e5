"""Helpers shared by the training-data operators: tables, lineage cuts, Arrow buffers, byte hashing, packed rows."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Bytes of rows that one Arrow batch may hold, and rows of it; bounds a Python worker's memory.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get; texts may be very long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _trim() -> None:
    """Give freed memory back to the system; a reused worker would hold on to it while other stages run."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(step):
    """A function of mapInArrow whose worker keeps no freed memory after its task."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            _trim()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. A temporary one only where it is unset and the executors
    are threads of this process, as in tests; without a shared folder a cluster is refused."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp()
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def forget(*frames: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in frames:
        for f in df.inputFiles()[:1]:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f).getParent()
            if folder.getName().startswith("table-"):
                folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or the first longer one, that no column of df has."""
    names = {c.lower() for c in df.columns}
    while name in names:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(df: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """df with column `key`, distinct and in the order of id and then text hash: the id itself where ids are distinct, or else
    the place in a table sorted by ranges, which are cut through rows of one id and so bounded."""
    ids = F.col(id_col).cast("long")
    n, distinct = df.agg(F.count("*"), F.count_distinct(ids)).first()
    if n == distinct:
        return df.withColumn(key, ids)
    own, mark, row = (unused(df, c) for c in ("own_id", "text_mark", "row_id"))
    rows = df.withColumns({own: ids, mark: F.xxhash64(text_col), row: F.monotonically_increasing_id()})
    order = [F.asc_nulls_last(own), F.asc(mark), F.asc(row)]
    placed = rows.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(placed.withColumn(key, F.monotonically_increasing_id()).drop(own, mark, row))


# ---- Arrow ----


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, null as empty."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.cast(kind) if column.type != kind else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def longs(column: pa.Array, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy()


def rows(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def runs(batches, key: str):
    """Consecutive rows with equal `key` (sorted within the partition), as lists of dicts; one run is held at a time."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield held


# ---- hashing of byte ranges ----

MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ np.uint64((salt * 0xA0761D6478BD642F) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


class Ranges:
    """Rolling hash of a byte array: `of(s, e)` gives position-free hashes of the ranges [s, e)."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.sums[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(np.uint64))


# ---- counters of bounded size ----

_COUNTS = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])


def zstd() -> pa.Codec:
    return pa.Codec("zstd")


def counters(batches, hashes_of, width: int, slices: int):
    """Count hashed values in `width` saturating 16-bit counters a partition; rows (slice, counts) at its end."""
    total, held, size, mask = np.zeros(width, np.uint16), [], 0, np.uint64(width - 1)

    def settle():
        at, n = np.unique(np.concatenate(held) & mask, return_counts=True)
        total[at] = np.minimum(total[at] + n, 65535)

    for batch in batches:
        h = hashes_of(batch)
        held.append(h)
        size += len(h)
        if size > 1_500_000:
            settle()
            held, size = [], 0
    if size:
        settle()
    yield pa.RecordBatch.from_pydict({"slice": list(range(slices)), "counts": [planes(x) for x in total.reshape(slices, -1)]}, schema=_COUNTS)


def planes(counts: np.ndarray) -> bytes:
    """16-bit counts, most of them small: their two low bits as planes, and what is higher by place."""
    high = counts >> 2
    at = np.flatnonzero(high).astype("<u4")
    parts = [np.packbits((counts & 1).astype(bool)), np.packbits((counts >> 1 & 1).astype(bool)), np.diff(at, prepend=np.uint32(0)).view(np.uint8), high[at].astype("<u2").view(np.uint8)]
    return len(at).to_bytes(4, "little") + zstd().compress(np.concatenate(parts).tobytes(), asbytes=True)


def from_planes_of(blob: bytes, width: int) -> np.ndarray:
    n, bits = int.from_bytes(blob[:4], "little"), width // 8
    raw = np.frombuffer(zstd().decompress(blob[4:], 2 * bits + 6 * n), np.uint8)
    out = np.unpackbits(raw[:bits]).astype(np.uint16) | np.unpackbits(raw[bits : 2 * bits]).astype(np.uint16) << 1
    at = np.cumsum(raw[2 * bits : 2 * bits + 4 * n].copy().view("<u4"), dtype=np.uint32)
    out[at] |= raw[2 * bits + 4 * n :].copy().view("<u2") << 2
    return out


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte, in order: exact below 128, then eight steps for each doubling."""
    high = 128 + np.floor(8 * np.log2(np.maximum(counts, 128) / 128)).astype(np.int64)
    return np.where(counts < 128, counts, np.minimum(high, 255)).astype(np.uint8)


def _summed(width: int):
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                x = from_planes_of(x, width).astype(np.uint32)
                sums[k] = sums[k] + x if k in sums else x
        if sums:
            yield pa.RecordBatch.from_pydict({"slice": list(sums), "counts": [scaled(x).tobytes() for x in sums.values()]}, schema=_COUNTS)

    return run


def sketch(df: DataFrame, hashes_of, width: int, slices: int = 64) -> np.ndarray:
    """Scaled counts of hashed values over all rows of df in `width` one-byte counters. The callers bound `width`, whatever
    the input, so the driver can hold it and broadcast it; partial counts are summed slice by slice on the executors."""
    parts = df.mapInArrow(lean(lambda it: counters(it, hashes_of, width, slices)), "slice int, counts binary")
    done = parts.repartition(min(slices, partitions(df.sparkSession)), "slice").mapInArrow(lean(_summed(width // slices)), "slice int, counts binary").collect()
    out = np.zeros((slices, width // slices), np.uint8)
    for r in done:
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


# ---- marks ----

#: Bits of marks for each key, and the fewest and most of them; 32 MB is the most that is ever broadcast.
BITS_A_KEY, FEWEST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return mix(keys.astype(np.uint64), 8) & np.uint64(bits - 1)


def marks(df: DataFrame, keys_of, slices: int = 16) -> np.ndarray:
    """A bitmap in which every key (64-bit number) that keys_of(batch) lists for the rows of df is marked, and few others are.
    Its size follows the number of keys up to a bound, beyond which more and more others are marked: work that marks save is
    then done, results stay the same."""

    def counting(batches):
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(k) for batch in batches for k in keys_of(batch))], pa.int64())})

    n = df.mapInArrow(lean(counting), "n long").agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_A_KEY * n).bit_length()))

    def marking(batches):
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            found = keys_of(batch)
            if found:
                at = np.unique(_places(np.concatenate(found), bits))
                byte = (at >> np.uint64(3)).astype(np.int64)
                head = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(at) else np.zeros(0, np.int64)
                if len(at):
                    out[byte[head]] |= np.bitwise_or.reduceat((1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8), head)
        part = out.reshape(slices, -1)
        some = np.flatnonzero(part.any(1))
        yield pa.RecordBatch.from_pydict({"slice": some.tolist(), "counts": [zstd().compress(part[k].tobytes(), asbytes=True) for k in some]}, schema=_COUNTS)

    def merging(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                x = np.frombuffer(zstd().decompress(x, bits // 8 // slices), np.uint8)
                sums[k] = sums[k] | x if k in sums else x
        if sums:
            yield pa.RecordBatch.from_pydict({"slice": list(sums), "counts": [x.tobytes() for x in sums.values()]}, schema=_COUNTS)

    parts = df.mapInArrow(lean(marking), "slice int, counts binary").repartition(min(slices, partitions(df.sparkSession)), "slice")
    out = np.zeros((slices, bits // 8 // slices), np.uint8)
    for r in parts.mapInArrow(lean(merging), "slice int, counts binary").collect():  # MOST_BITS at most
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def is_marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _places(keys, 8 * len(bitmap))
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


# ---- packed rows ----


def columns_of(records: np.ndarray) -> bytes:
    """A structured array field by field, doc and place as differences; this compresses better than record by record."""
    parts = []
    for f in records.dtype.names:
        x = np.ascontiguousarray(records[f])
        parts.append((np.diff(x, prepend=x.dtype.type(0)) if f in ("doc", "place") else x).tobytes())
    return b"".join(parts)


def from_columns(blob: bytes, dtype: np.dtype, offset: int = 0) -> np.ndarray:
    n = (len(blob) - offset) // dtype.itemsize
    out = np.empty(n, dtype)
    for f in dtype.names:
        x = np.frombuffer(blob, dtype[f], n, offset)
        out[f] = np.cumsum(x, dtype=x.dtype) if f in ("doc", "place") else x
        offset += n * dtype[f].itemsize
    return out


def packed(records: np.ndarray, buckets: np.ndarray, schema: pa.Schema, written=lambda records: records.tobytes()):
    """Rows (bucket, blob) of a structured array, one for each bucket that occurs."""
    if len(records):
        order = np.argsort(buckets, kind="stable")
        records, buckets = records[order], buckets[order]
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        at = np.concatenate([[0], cuts, [len(buckets)]])
        yield pa.RecordBatch.from_arrays([pa.array(buckets[at[:-1]].astype(np.int64)), pa.array([written(records[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], schema=schema)


BLOBS = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])


def gathered(df: DataFrame, step, schema: str, n: int) -> DataFrame:
    """Bring the blobs of each bucket together and apply step(bucket, list of blobs), which yields record batches."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for k, b in zip(batch["bucket"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                if held and k != now:
                    yield from step(now, held)
                    held = []
                now = k
                held.append(b)
        if held:
            yield from step(now, held)

    return df.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), schema)
