"""Byte-level BPE on Spark: overlapping chunk encoding, and raw-byte decoding.

A long text is cut into chunks that overlap. Each chunk is split into pre-tokens and encoded by itself, in parallel; it may
start inside a pre-token, but from the first pre-token boundary that it shares with the chunk before it the two agree on
everything, as matching looks only forward. There the two are stitched. Should no boundary be shared within the overlap, the
stitching step decodes the pending ids back to text and encodes the joined stretch anew, so the result never depends on the
cut. Decoding concatenates the bytes of the ids.

Rows: a null or empty text has no tokens; null and repeated ids are kept, one result per row; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, partitions, table

#: Characters of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 16384, 512
#: Pre-tokens that a worker remembers.
REMEMBERED = 400_000

# Letters, digits and white space among the characters up to U+017F and the general punctuation; others take the slow path.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t\n\x0b\x0c\r\x20\x85\xa0"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile(r"[^\x00-ſ‐-‧‰-⁞]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def safe_slices(text: str, size: int):
    """Cut a text before single spaces between visible characters, where a pre-token starts whatever comes before."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe(dict):
    """Encoder of a rank file; maps pre-tokens to their ids as little-endian unsigned 32-bit bytes, remembering some."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        self.split = regex.compile(pattern).findall
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})
        self.encode_one = self.core._core_bpe.encode_single_piece if hasattr(self.core._core_bpe, "encode_single_piece") else None

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode_one(piece.encode()) if self.encode_one else self.core.encode_ordinary(piece)
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[piece] = np.array(ids, "<u4").tobytes()
        return out

    def pieces(self, text: str) -> list[str]:
        return self.split(text) if _OTHER.search(text) else _FAST.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed; a long text is cut where a pre-token starts in any case."""
        if len(text) <= 1 << 16:
            return b"".join(map(self.__getitem__, self.pieces(text)))
        return b"".join(b"".join(map(self.__getitem__, self.pieces(x))) for x in safe_slices(text, 1 << 16))

    @property
    def symbols(self) -> list[bytes]:
        if not hasattr(self, "_symbols"):
            r = self.core._mergeable_ranks
            self._symbols = [b""] * (max(r.values()) + 1)
            for b, i in r.items():
                self._symbols[i] = b
        return self._symbols

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.symbols.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


class Digest:
    """Running digests of a document's ids and of the bytes they stand for."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.n, self.ids, self.bytes = bpe, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, packed: bytes) -> None:
        ids = np.frombuffer(packed, "<u4")
        if len(ids):
            self.ids.update((b"," if self.n else b"") + ",".join(map(str, ids.tolist())).encode())
            self.bytes.update(self.bpe.decode(ids))
            self.n += len(ids)


def chunks(text: str, size: int, overlap: int):
    """(number, start, text) of the overlapping chunks."""
    for k, at in enumerate(range(0, max(len(text), 1), size)):
        yield k, text[at : at + size + overlap]


def encode_chunk(bpe: Bpe, text: str, size: int, overlap: int) -> tuple[bytes, list[int], list[int], list[int], list[int]]:
    """Packed ids, and the boundaries (place, ids before it) within the overlaps with the chunk before and the next one."""
    places, counts, at, n, out = [0], [0], 0, 0, []
    for p in bpe.pieces(text):
        b = bpe[p]
        out.append(b)
        at += len(p)
        n += len(b) // 4
        places.append(at)
        counts.append(n)
    head = [(p, c) for p, c in zip(places, counts, strict=True) if p <= overlap]
    tail = [(p, c) for p, c in zip(places[:-1], counts[:-1], strict=True) if p >= size]
    return b"".join(out), [p for p, _ in head], [c for _, c in head], [p - size for p, _ in tail], [c for _, c in tail]


class Stitcher:
    """Joins a document's chunks, given in order, and passes the ids on as soon as they are settled."""

    def __init__(self, bpe: Bpe, size: int, overlap: int, emit):
        self.bpe, self.size, self.overlap, self.emit, self.pending = bpe, size, overlap, emit, None

    def add(self, ids: bytes, head: list[int], head_ids: list[int], tail: list[int], tail_ids: list[int]) -> None:
        if self.pending is None:
            self.pending = (ids, tail, tail_ids)
            return
        before, places, counts = self.pending
        meet = next(((c, d) for p, c in zip(places, counts, strict=True) for q, d in zip(head, head_ids, strict=True) if p == q), None)
        if meet:
            self.emit(before[: 4 * meet[0]])
            self.pending = (ids[4 * meet[1] :], tail, [c - meet[1] for c in tail_ids])
        else:  # encode the joined stretch
            a, b = (self.bpe.decode(np.frombuffer(x, "<u4")).decode() for x in (before, ids))
            text = a + b[self.overlap :]
            out, _, _, places, counts = encode_chunk(self.bpe, text, len(a) - self.overlap + self.size, self.overlap)
            self.pending = (out, places, counts)

    def end(self) -> None:
        if self.pending:
            self.emit(self.pending[0])
        self.pending = None


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "ints": pa.list_(pa.int32())}
    return pa.schema([(a, kinds[b.replace("array<int>", "ints")]) for a, b in (x.split() for x in ddl.split(", "))])


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: id, number of ids, digests of the ids (decimal, comma-joined) and of the decoded bytes."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("uid"))
    long = F.length("text") > size + overlap

    def whole(batches):
        bpe, schema = encoder(path, pattern), _arrow(RESULT)
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                d = Digest(bpe)
                d.add(bpe.encode(text))
                out.append((d.n, d.ids.hexdigest(), d.bytes.hexdigest()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 3, list(schema)[1:], strict=True))], schema=schema)

    cut = "doc_id long, uid long, chunk int, text string"

    def cutting(batches):
        for batch in batches:
            for i, u, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "uid", "text")), strict=True):
                parts = list(chunks(text, size, overlap))
                yield pa.RecordBatch.from_pylist([{"doc_id": i, "uid": u, "chunk": k, "text": x} for k, x in parts], schema=_arrow(cut))

    coded = "doc_id long, uid long, chunk int, ids binary, head array<int>, head_ids array<int>, tail array<int>, tail_ids array<int>"

    def encoding(batches):
        bpe = encoder(path, pattern)
        for batch in batches:
            made = [encode_chunk(bpe, x, size, overlap) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["uid"], batch["chunk"], *(pa.array([m[k] for m in made], f.type) for k, f in enumerate(list(_arrow(coded))[3:]))], schema=_arrow(coded))

    def stitching(batches):
        bpe, schema, now, at, digest = encoder(path, pattern), _arrow(RESULT), None, None, None
        done = lambda: pa.RecordBatch.from_pylist([{"doc_id": now[1], "n_tokens": digest.n, "ids_sha256": digest.ids.hexdigest(), "decoded_sha256": digest.bytes.hexdigest()}], schema=schema)
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now[0] != r["uid"]:
                    if now:
                        at.end()
                        yield done()
                    now, digest = (r["uid"], r["doc_id"]), Digest(bpe)
                    at = Stitcher(bpe, size, overlap, digest.add)
                at.add(r["ids"], r["head"], r["head_ids"], r["tail"], r["tail_ids"])
        if now:
            at.end()
            yield done()

    n = partitions(df.sparkSession)
    parts = docs.where(long).mapInArrow(lean(cutting), cut).repartition(n, "uid", "chunk").mapInArrow(lean(encoding), coded)
    stitched = parts.repartition(n, "uid").sortWithinPartitions("uid", "chunk").mapInArrow(lean(stitching), RESULT)
    return docs.where(~long).select("doc_id", "text").mapInArrow(lean(whole), RESULT).unionByName(stitched)


def op6_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document under the multilingual rank file."""
    import public_tokenizers as P

    return encode_documents(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
