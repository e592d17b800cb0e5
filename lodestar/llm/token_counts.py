"""Token counts as delta-maintained rollups.

Every document is counted once by every tokenizer version, into a table by document. A ledger is a folder of batches. A batch
is a set of signed deltas (documents and tokens by source, language and tokenizer version): an insert adds a document's count,
a delete takes it away, a revision takes the old count away and adds the new one; old counts come from the table by document.

A writer puts a batch's deltas into a folder of its own attempt and then publishes the attempt's name under the batch's, in
one step that fails if there is one already (a rename that does not overwrite; on a local disk a link). So of several writers
of a batch, whenever they come, exactly one commits, an attempt that broke off counts for nothing, and a batch that is
committed is never written again. Totals are the sums of the committed attempts; as sums are additive, compaction may replace
any batches by their sum. The folder must be in a file system whose rename is atomic.

Rows: null sources, languages and versions are groups of their own; null and empty texts have no tokens, null token counts
count as 0; null and repeated document ids are documents each; an empty batch commits an empty set of deltas; groups that sum
to no documents and no tokens are left out; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import REMEMBERED, encoder, safe_slices
from .common import lean, materialize, shared_dir, table

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
COUNTS = "doc_id long, source string, lang string, tokenizer string, tokens long"
#: Rank files of the query's tokenizer versions.
VERSIONS = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


class Lengths(dict):
    """Pre-tokens with their numbers of tokens under all versions, side by side in one integer; remembers some."""

    BITS = 40

    def __init__(self, paths: list[str], pattern: str):
        self.encoders = [encoder(p, pattern) for p in paths]

    def __missing__(self, piece: str) -> int:
        n = sum(len(e.encode_one(piece.encode()) if e.encode_one else e.core.encode_ordinary(piece)) << (self.BITS * k) for k, e in enumerate(self.encoders))
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = n
        return n

    def count(self, text: str) -> list[int]:
        """Numbers of tokens of a text; a long one is cut where a pre-token starts in any case."""
        pieces = self.encoders[0].pieces
        n = sum(sum(map(self.__getitem__, pieces(x))) for x in safe_slices(text, 1 << 16))
        return [n >> (self.BITS * k) & ((1 << self.BITS) - 1) for k in range(len(self.encoders))]


def counted(df: DataFrame, versions: dict[str, str], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """COUNTS of every row under every version (name: rank file); pre-tokens are split once for all."""
    names, paths = list(versions), list(versions.values())

    def run(batches):
        lengths = Lengths(paths, pattern)
        for batch in batches:
            n = np.array([lengths.count(t or "") for t in batch["text"].to_pylist()], np.int64).reshape(-1, len(names))
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(names)))
            yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in ("doc_id", "source", "lang")), pa.array(names * batch.num_rows, pa.string()), pa.array(n.reshape(-1))], names=["doc_id", "source", "lang", "tokenizer", "tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), COUNTS)


def deltas(changes: DataFrame) -> DataFrame:
    """Deltas of changes(source, lang, tokenizer, op, tokens, old_tokens), op insert, delete or revise."""
    op, new, old = F.col("op"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0)
    tokens = F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old).otherwise(0)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class Ledger:
    """Rollups in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark.sparkContext._jvm
        self.at = lambda name: self.jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> dict[str, str]:
        """Batches, and the attempt that committed each."""
        folder = self.at("commits")
        if not self.fs.exists(folder):
            return {}
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(folder))
        return {n: self._read(f"commits/{n}") for n in names if not n.startswith(".")}

    def _read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, batch: str, attempt: str) -> bool:
        """Name the attempt as the batch's; False if it has one."""
        self.fs.mkdirs(self.at("commits"))
        draft, final = self.at(f"commits/.{attempt}"), self.at(f"commits/{batch}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(attempt.encode()))
        stream.close()
        try:
            if self.fs.getScheme() == "file":
                own = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self.jvm.java.nio.file.Files.createLink(own(final), own(draft))
                    return True
                except Exception as e:  # a py4j error wraps the exception of the JVM
                    if "FileAlreadyExistsException" in str(e):
                        return False
                    raise
            return bool(self.fs.rename(draft, final))
        finally:
            self.fs.delete(draft, False)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch once; False if it was committed before, or by another writer meanwhile."""
        if self.fs.exists(self.at(f"commits/{batch}")):
            return False
        attempt = uuid.uuid4().hex
        deltas(changes).write.parquet(f"{self.path}/deltas/{batch}/{attempt}")
        if self._publish(batch, attempt):
            return True
        self.fs.delete(self.at(f"deltas/{batch}/{attempt}"), True)
        return False

    def totals(self) -> DataFrame:
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.path}/deltas/{b}/{a}" for b, a in done.items()))
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


def op8_delta_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: every document under both tokenizers; rated-bad documents deleted; and the counts of toxic
    ones revised to 0. Each batch is offered twice."""
    import public_tokenizers as P

    docs = materialize(counted(table(spark, sf_dir, "documents"), {v.removesuffix(".tiktoken"): P.path(v) for v in VERSIONS}, P.PATTERN))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rated = docs.join(labels, "doc_id")
    none = F.lit(None).cast("long")
    batches = {
        "0001": docs.select(*KEYS, F.lit("insert").alias("op"), "tokens", none.alias("old_tokens")),
        "0002": rated.where("quality = 0").select(*KEYS, F.lit("delete").alias("op"), "tokens", none.alias("old_tokens")),
        "0003": rated.where("quality = 1 and toxic = 1").select(*KEYS, F.lit("revise").alias("op"), F.lit(0).cast("long").alias("tokens"), F.col("tokens").alias("old_tokens")),
    }
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    for _ in range(2):
        for name, changes in batches.items():
            ledger.apply(name, changes)
    return ledger.totals()
