"""Removal of repeated byte strings in corpus order, over a parse of every document.

A byte that a string of `length` bytes covers goes if the string also starts earlier (in document order, then place). The
corpus is parsed at triggers of a rolling hash, like prefix-free parsing: the trigger of a string is the least 8-byte hash
among its first `SPAN` places, so every string has one, whatever the text, and equal strings have the same one at the same
offset (a fixed remainder would leave strings without any trigger, and phrases without bound). A trigger thus owns the strings
of an interval of offsets, and its phrase is the text that they cover; phrases overlap, so each string lies whole in one.

1. Parse: every phrase is named by a digest of its bytes. Of equal phrases all but the first in corpus order are wholly
   repeated. The first one is wholly new if no other phrase has its core, the bytes after the trigger that all its strings
   share.
2. Dictionary: where different phrases share a core (at the rims of repeated passages), their bytes are read again. A task
   lays them side by side and sorts the suffixes that start strings, as far as `length` bytes: the suffix array of its part
   of the dictionary, in which neighbours with a common prefix of `length` bytes are equal strings. Ties stand in corpus
   order, the order of the parse, so the first of each run stays and the others are repeated.
3. Strings that are first in their task meet those of other tasks by a digest of 96 bits, again in corpus order.
4. Every document gets its repeated intervals, which it joins, and loses the bytes that they cover.

Records travel packed by buckets. Within a task equal phrases and equal strings are told apart first, and phrases of a core
that a task holds in several versions are known as rims without meeting others, so no core, phrase or string that a third of
all documents share brings more than a few records of each task to its bucket. Texts longer than SEGMENT bytes are parsed in
overlapping segments.

Rows: a null text counts as empty; rows of one id are ordered by their text's hash and take part in order; null ids come last.
Results replace input columns of their names; other columns are carried. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOBS, Ranges, buffers, columns_of, forget, from_columns, gathered, is_marked, keyed, lean, marks, materialize, mix, packed, partitions, table, unused

LENGTH, SPAN, SEGMENT = 100, 64, 1 << 22
GRAM = 8
#: A trigger with its interval of string starts, place - high .. place - low. `core` has 48 bits and only groups; `whole` is a
#: digest of the phrase's bytes, seeded by the trigger's offset.
PHRASE = np.dtype([("core", "<u4"), ("more", "<u2"), ("whole", "<u8"), ("doc", "<i8"), ("place", "<u4"), ("low", "u1"), ("high", "u1")])
STRING = np.dtype([("hash", "<u8"), ("more", "<u4"), ("doc", "<i8"), ("place", "<u4")])
INTERVAL = np.dtype([("doc", "<i8"), ("first", "<u4"), ("last", "<u4")])
RIM = np.dtype([("doc", "<i8"), ("place", "<u4"), ("low", "u1"), ("high", "u1")])
#: In `low` of a posted phrase: the task knows its core as shared, and the phrase as a rim.
KNOWN = 128
#: Phrases of a bucket; phrases and strings after which a task passes on what it has.
BUCKET_PHRASES, FLUSH_PHRASES, FLUSH_STRINGS = 150_000, 300_000, 200_000


def triggers(data: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, low, high) of each trigger: it owns the strings that start at place - high .. place - low."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    raw = np.ascontiguousarray(data)
    m = n + span - 1  # places that can be a trigger; span + GRAM <= length
    grams = np.ndarray((m,), "<u8", raw, 0, (1,)).copy()
    key = (mix(grams) & ~np.uint64(0xFFFFFF)) | np.arange(m, dtype=np.uint64)  # SEGMENT places fit in 24 bits; ties go left
    step = 1
    while 2 * step <= span:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < span:
        key = np.minimum(key[: -(span - step)], key[span - step :])
    at = (key[:n] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], n) - 1
    place = at[first]
    return place, place - last, place - first


def _segments(column: pa.Array, ids: np.ndarray, length: int):
    """(document, base, bytes) of every text, long ones in overlapping segments."""
    data, offsets = buffers(column)
    for i, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        for base in range(0, max(1, b - a - length + 1), SEGMENT):
            yield i, base, data[a + base : min(b, a + base + SEGMENT + length - 1)]


def _cores(r: np.ndarray) -> np.ndarray:
    return r["more"].astype(np.uint64) << np.uint64(32) | r["core"]


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Flags of the rows that differ from the one before in any key."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def first_phrases(r: np.ndarray) -> np.ndarray:
    """Flags of the first of equal phrases in corpus order."""
    core, flag = _cores(r), np.zeros(len(r), bool)
    order = np.lexsort((r["place"], r["doc"], r["whole"], core))
    flag[order] = _changes(core[order], r["whole"][order])
    return flag


def _marked(records: np.ndarray, flag: bytes, key: np.ndarray, buckets: int):
    for b in packed(records, (mix(key, 12) % np.uint64(buckets)).astype(np.int64), BLOBS, columns_of):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flag + x for x in b.column(1).to_pylist()], pa.binary())], schema=BLOBS)


def _documents(r: np.ndarray) -> np.ndarray:
    return r["doc"].astype(np.uint64)


def _phrases(batches, length: int, span: int, buckets: int):
    """Packed rows: posted phrases (first byte 1), by core; by document those found repeated within the task (0) and rims (2)."""
    held, size = [], 0

    def flush():
        if not held:
            return
        r = np.concatenate(held)
        first = first_phrases(r)
        yield from _marked(r[~first], b"\0", _documents(r[~first]), buckets)
        r = r[first]
        _, at, group, count = np.unique(_cores(r), return_index=True, return_inverse=True, return_counts=True)
        several = count[group] > 1
        yield from _marked(r[several], b"\2", _documents(r[several]), buckets)
        heads = r[at[count > 1]]
        heads["low"] |= KNOWN
        posted = np.concatenate([r[~several], heads])
        yield from _marked(posted, b"\1", _cores(posted), buckets)

    for batch in batches:
        for i, base, part in _segments(batch["text"], batch["key"].to_numpy(), length):
            place, low, high = triggers(part, length, span)
            if not len(place):
                continue
            r, view = np.empty(len(place), PHRASE), memoryview(part)
            core = Ranges(part).of(place, place + length - span + 1)
            r["core"], r["more"] = core & np.uint64(0xFFFFFFFF), core >> np.uint64(48)
            r["whole"] = [xxhash.xxh3_64_intdigest(view[a:b], h) for a, b, h in zip((place - high).tolist(), (place - low + length).tolist(), high.tolist(), strict=True)]
            r["doc"], r["place"], r["low"], r["high"] = i, place + base, low, high
            held.append(r)
            size += len(r)
            if size > FLUSH_PHRASES:
                yield from flush()
                held, size = [], 0
    yield from flush()


def _intervals(r: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), INTERVAL)
    out["doc"], out["first"], out["last"] = r["doc"], r["place"] - r["high"], r["place"] - r["low"]
    return out


KINDS = pa.schema([("kind", pa.int32()), *BLOBS])


def _by_document(records: np.ndarray, kind: int, shards: int):
    for b in packed(records, (mix(_documents(records), 31) % np.uint64(shards)).astype(np.int64), BLOBS):
        yield pa.RecordBatch.from_arrays([pa.array([kind] * b.num_rows, pa.int32()), *b.columns], schema=KINDS)


def _rims(r: np.ndarray) -> np.ndarray:
    out = np.empty(len(r), RIM)
    for name in RIM.names:
        out[name] = r[name]
    return out


def _sorted_phrases(shards: int):
    """Kind 0: repeated intervals; kind 1: rims, first phrases under a core that others share."""

    def step(_, blobs):
        of = lambda flag: np.concatenate([np.zeros(0, PHRASE), *(from_columns(b, PHRASE, 1) for b in blobs if b[0] == flag)])
        repeated, posted, rims = of(0), of(1), of(2)
        known = posted["low"] >= KNOWN
        r = posted[~known]
        first = first_phrases(r)
        yield from _by_document(_intervals(np.concatenate([repeated, r[~first]])), 0, shards)
        r = r[first]
        core = _cores(r)
        _, group, count = np.unique(core, return_inverse=True, return_counts=True)
        shared = (count[group] > 1) | np.isin(core, _cores(posted[known])) if len(r) else np.zeros(0, bool)
        yield from _by_document(_rims(np.concatenate([rims, r[shared]])), 1, shards)

    return step


def _per_document(dtype: np.dtype):
    def step(_, blobs):
        r = np.sort(np.concatenate([np.frombuffer(b, dtype) for b in blobs]))
        at = np.flatnonzero(np.concatenate([[True], r["doc"][1:] != r["doc"][:-1], [True]]))
        yield pa.RecordBatch.from_arrays([pa.array(r["doc"][at[:-1]]), pa.array([r[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["key", "found"])

    return step


def suffix_array(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, new, suffixes): the suffixes of data at `starts` in the order of their first `length` bytes, ties as given;
    whether the common prefix of each with the one before it is shorter than that; and the suffixes, so cut, as given."""
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[starts]) if len(starts) else np.zeros((0, length), np.uint8)
    order = np.argsort(suffixes.view(f"V{length}").ravel(), kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        ranked = suffixes[order]
        new[1:] = (ranked[1:] != ranked[:-1]).any(1)
    return order, new, suffixes


def _stretches(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Strings as intervals, neighbouring ones joined."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = _changes(doc, place - np.arange(len(place)))
    at = np.flatnonzero(new)
    out = np.empty(len(at), INTERVAL)
    out["doc"], out["first"] = doc[at], place[at]
    out["last"] = place[np.append(at[1:], len(place)) - 1] if len(at) else []
    return out


def _strings(batches, length: int, buckets: int):
    """Packed rows: repeated intervals (first byte 0), by document; strings that are first in their task (1), by digest."""
    pieces, starts, docs, places, size, filled = [], [], [], [], 0, 0

    def flush():
        if not size:
            return
        doc, place, start = np.concatenate(docs), np.concatenate(places), np.concatenate(starts)
        corpus = np.lexsort((place, doc))
        doc, place, start = doc[corpus], place[corpus], start[corpus]
        order, new, suffixes = suffix_array(np.concatenate(pieces), start, length)
        gone, kept = order[~new], np.sort(order[new])  # kept in corpus order, whose differences are small
        out = _stretches(doc[gone], place[gone])
        yield from _marked(out, b"\0", _documents(out), buckets)
        r, view = np.empty(len(kept), STRING), memoryview(suffixes.reshape(-1))
        digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[length * k : length * (k + 1)]) for k in kept.tolist()]), "<u8").reshape(-1, 2)
        r["hash"], r["more"] = digests[:, 0], digests[:, 1] & np.uint64(0xFFFFFFFF)
        r["doc"], r["place"] = doc[kept], place[kept]
        yield from _marked(r, b"\1", digests[:, 0], buckets)

    for batch in batches:
        data, offsets = buffers(batch["text"])
        for i, a, found in zip(batch["key"].to_pylist(), offsets[:-1].tolist(), batch["found"].to_pylist(), strict=True):
            rims = np.frombuffer(found, RIM)
            for part in np.array_split(rims, len(rims) // 5000 + 1):
                first, last = part["place"].astype(np.int64) - part["high"], part["place"].astype(np.int64) - part["low"]
                for s, e in zip(first.tolist(), last.tolist(), strict=True):
                    pieces.append(data[a + s : a + e + length])
                many = last - first + 1
                step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                base = filled + np.cumsum(many + length - 1) - (many + length - 1)
                starts.append(np.repeat(base, many) + step)
                places.append(np.repeat(first, many) + step)
                docs.append(np.full(len(step), i, np.int64))
                filled += int((many + length - 1).sum())
                size += len(step)
                if size > FLUSH_STRINGS:
                    yield from flush()
                    pieces, starts, docs, places, size, filled = [], [], [], [], 0, 0
        pieces = [p.copy() if p.base is not None else p for p in pieces]  # not to hold on to the batch
    yield from flush()


def _settled(shards: int):
    def step(_, blobs):
        repeated = [from_columns(b, INTERVAL, 1) for b in blobs if b[0] == 0]
        posted = [from_columns(b, STRING, 1) for b in blobs if b[0] == 1]
        r = np.concatenate([np.zeros(0, STRING), *posted])
        order = np.lexsort((r["place"], r["doc"], r["more"], r["hash"]))
        gone = order[~_changes(r["hash"][order], r["more"][order])]
        yield from _by_document(np.concatenate([*repeated, _stretches(r["doc"][gone], r["place"][gone].astype(np.int64))]), 0, shards)

    return step


def covered(intervals: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the strings that start in the (sorted) intervals."""
    if not len(intervals):
        return []
    s, e = intervals["first"].astype(np.int64), intervals["last"].astype(np.int64) + length
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return list(zip(s[new].tolist(), e[np.append(np.flatnonzero(new)[1:], len(s)) - 1].tolist(), strict=True))


def _of_documents(found: DataFrame, dtype: np.dtype):
    """Marks of the documents that packed records name."""
    keys = lambda batch: [np.unique(np.frombuffer(b, dtype)["doc"]) for b in batch["blob"].to_pylist()]
    return marks(found, keys)


def _only(docs: DataFrame, key: str, bits: np.ndarray) -> DataFrame:
    """The marked rows of docs; they need no more than these to meet what was found in them."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # bounded by marks()

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(is_marked(shared.value, batch[key].to_numpy())))

    return docs.mapInArrow(lean(run), docs.schema)


def repeated_intervals(docs: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """(key, found) for the documents(key, text) that have repeated strings, written; keys are distinct and in corpus order."""
    n = partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(n, int(2 * size / (span + 1) // BUCKET_PHRASES) + 1)
    phrases = docs.mapInArrow(lean(lambda it: _phrases(it, length, span, buckets)), "bucket long, blob binary")
    found = materialize(gathered(phrases, _sorted_phrases(buckets), "kind int, bucket long, blob binary", n))
    rims = found.where("kind = 1").select("bucket", "blob")
    own = _only(docs, "key", _of_documents(rims, RIM)).join(gathered(rims, _per_document(RIM), "key long, found binary", n), "key")
    strings = own.mapInArrow(lean(lambda it: _strings(it, length, buckets)), "bucket long, blob binary")
    singles = gathered(strings, _settled(buckets), "kind int, bucket long, blob binary", n)
    out = materialize(gathered(found.where("kind = 0").unionByName(singles).select("bucket", "blob"), _per_document(INTERVAL), "key long, found binary", n))
    forget(found)
    return out


def _cut(df: DataFrame, id_col: str, text_col: str, length: int, span: int, more: T.StructType, made) -> DataFrame:
    """df without the columns of `more`, and these: made(bytes or None, runs) gives their values for a row."""
    assert span + GRAM <= length and span <= 128
    key, found_in = unused(df, "key"), unused(df, "found")
    whole = keyed(df, id_col, text_col, key)
    found = repeated_intervals(whole.select(F.col(key).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), length, span)
    bits = marks(found, lambda batch: [batch["key"].to_numpy()])
    replaced = {f.name for f in more}
    carried = [f.name for f in df.schema if f.name not in replaced]
    schema = T.StructType([f if f.name not in replaced else more[f.name] for f in df.schema] + [f for f in more if f.name not in df.columns])
    shared = df.sparkSession.sparkContext.broadcast(bits)  # bounded by marks()

    def results(batch, intervals):
        data, offsets = buffers(batch[text_col])
        some = batch[text_col].is_valid().to_pylist()
        values = []
        for a, b, here, f in zip(offsets[:-1].tolist(), offsets[1:].tolist(), some, intervals, strict=True):
            values.append(made(data[a:b].tobytes() if here else None, covered(np.frombuffer(f, INTERVAL), length) if f else []))
        kinds = {f.name: k for f, k in zip(more, zip(*values, strict=True) if values else [[]] * len(more), strict=True)}
        return pa.RecordBatch.from_arrays([batch[f.name] if f.name in carried else pa.array(kinds[f.name], _ARROW[f.dataType.simpleString()]) for f in schema], names=schema.names)

    def joined(batches):
        for batch in batches:
            yield results(batch, batch[found_in].to_pylist())

    def alone(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~is_marked(shared.value, batch[key].to_numpy())))
            yield results(batch, [None] * batch.num_rows)

    some = _only(whole, key, bits).join(found.select(F.col("key").alias(key), F.col("found").alias(found_in)), key, "left")
    return some.mapInArrow(lean(joined), schema).unionByName(whole.mapInArrow(lean(alone), schema))


_ARROW = {"bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary(), "string": pa.string()}


def _kept(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in gone for x in run), len(raw)]
    return b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, span: int = SPAN, digest: bool = False) -> DataFrame:
    """df's columns and n_bytes, runs (start and end of each removed run), kept_bytes or, with digest, kept_sha256."""
    last = "kept_sha256 string" if digest else "kept_bytes binary"

    def made(raw, gone):
        kept = _kept(raw or b"", gone)
        return len(raw or b""), [x for run in gone for x in run], hashlib.sha256(kept).hexdigest() if digest else kept

    return _cut(df, id_col, text_col, length, span, T.StructType.fromDDL(f"n_bytes bigint, runs array<bigint>, {last}"), made)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """df with what is left of its texts; a character that a cut parts goes whole. A null text stays null."""
    made = lambda raw, gone: (None if raw is None else _kept(raw, gone).decode(errors="ignore"),)
    return _cut(df, id_col, text_col, length, span, T.StructType([T.StructField(text_col, T.StringType())]), made)


def op7_parse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the repeated strings of 100 bytes."""
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    removed = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.floor(F.size("runs") / 2).cast("long").alias("n_spans"), "kept_sha256")
