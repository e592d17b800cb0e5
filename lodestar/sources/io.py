"""JSON samples in, result documents and graphs out."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import evidence_graph
from ..operators import paths as path_tables

SAMPLE = T.StructType([T.StructField("context", T.StringType()), T.StructField("claim", T.StringType()), T.StructField("evidence", T.StringType()), T.StructField("label", T.IntegerType())])
FALLBACK = ("The water supply of the district stops from 22:00 today. Repairs end at 05:00 tomorrow.", "The water supply stops from 23:00 today.", None, None)


def read_records(spark: SparkSession, path: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(samples, errors) of the JSON arrays or lines under a path, numbered from 1 in the order of files and of records within
    them; `most` of them. errors(sample_id, error) has the records without context or claim, and those that do not parse."""
    schema = T.StructType([*SAMPLE.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    # records of a file are read by one task, so their numbers within it follow the order
    sizes = {f: n for f, n in (tuple(r) for r in rows.groupBy("file").count().orderBy("file").collect())}  # one row a file
    starts, start = [], 0
    for f, n in sizes.items():
        starts.append((f, start))
        start += n
    base = spark.createDataFrame(starts, "file string, start long")
    nth = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    rows = rows.withColumn("nth", nth).join(F.broadcast(base), "file").withColumn("sample_id", (F.col("start") + F.col("nth")).cast("long"))
    rows = rows.where(F.col("sample_id") <= most) if most else rows
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    error = F.when(F.col("_corrupt").isNotNull(), "invalid record").when(blank("context"), "no context").when(blank("claim"), "no claim")
    rows = rows.withColumn("error", error)
    return rows.where("error is null").select(*SAMPLE.names, "sample_id"), rows.where("error is not null").select("sample_id", "error")


def read_samples(spark: SparkSession, path: str, most: int | None = None, strict: bool = False) -> DataFrame:
    """The samples of read_records; strict: bad records raise instead of being left out."""
    samples, errors = read_records(spark, path, most)
    if strict and (bad := errors.first()):
        raise ValueError(f"sample {bad['sample_id']}: {bad['error']}")
    return samples


def one_sample(spark: SparkSession, context: str | None = None, claim: str | None = None, path: str | None = None) -> DataFrame:
    """A single sample: given in full, the first of a file, or the built-in one."""
    if path:
        return read_samples(spark, path, most=1, strict=True)
    if context is None and claim is None:
        return fallback_sample(spark)
    if not (context or "").strip() or not (claim or "").strip():
        raise ValueError("a sample needs a context and a claim")
    return spark.createDataFrame([(context, claim, None, None)], SAMPLE).withColumn("sample_id", F.lit(1).cast("long"))


def fallback_sample(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([FALLBACK], SAMPLE).withColumn("sample_id", F.lit(1).cast("long"))


def parse_entities(response) -> F.Column:
    """Entities of a model's answer: code fences off, a JSON array of strings, trimmed, distinct; [] where it does not parse."""
    bare = F.trim(F.regexp_replace(response, "```(json)?", ""))
    items = F.coalesce(F.from_json(bare, "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def simple_documents(samples: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per sample: its fields and the evidence sentences by rank."""
    lists = evidence.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("aggregation_rank", "sentence"))), lambda x: x["sentence"]).alias("multi_level_evidence"))
    return samples.join(lists, "sample_id", "left").withColumn("multi_level_evidence", F.coalesce("multi_level_evidence", F.array().cast("array<string>")))


def save_run(documents: DataFrame, path: str, stamp: str | None = None) -> str:
    """Detailed documents appended under `run_ts=<stamp>`, one partition a run; gives the stamp."""
    stamp = stamp or datetime.now(UTC).strftime("%Y%m%d_%H%M%S_%f")
    documents.write.mode("append").json(f"{path}/run_ts={stamp}")
    return stamp


def latest_run(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest run under a path, None if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    runs = sorted(f.getPath().getName() for f in fs.listStatus(where) if f.getPath().getName().startswith("run_ts="))
    return f"{path}/{runs[-1]}" if runs else None


def save_outputs(path: str, graph=None, paths: DataFrame | None = None, documents: DataFrame | None = None, **config) -> list[str]:
    """Write whatever is given under a path: the graph as tables, as XML and as JSON documents, paths as JSON documents and as
    reports to read, result documents. Gives the folders."""
    made = []

    def put(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").json(f"{path}/{name}")
        made.append(f"{path}/{name}")

    if graph is not None:
        save_graph(graph.nodes, graph.edges, f"{path}/graph")
        made.append(f"{path}/graph")
        nodes = graph.nodes.select("sample_id", F.col("node_id").alias("id"), F.col("text").alias("label"), F.col("node_type").alias("type"))
        edges = graph.edges.select("sample_id", F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_type").alias("type"), "weight")
        put(graph_documents(nodes, edges), "graph_xml")
        put(evidence_graph.documents(graph), "graph_json")
    if paths is not None:
        put(path_tables.documents(paths, graph, **config), "paths_json")
        put(path_tables.reports(paths, graph), "paths_report")
    if documents is not None:
        put(documents, "documents")
    return made


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.na.fill("").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.na.fill("").write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


_NODE, _EDGE = "struct<_id:string,_label:string,_type:string>", "struct<_id:string,_source:string,_target:string,_label:string,_weight:double>"
_GEXF = f"_version string, graph struct<_defaultedgetype:string,nodes:struct<node:array<{_NODE}>>,edges:struct<edge:array<{_EDGE}>>>"


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, gexf): each sample's graph as one XML document, from nodes(sample_id, id, label, type) and
    edges(sample_id, source, target, type, weight). A null becomes an empty text, a null weight 1."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    n = nodes.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct(text("id").alias("_id"), text("label").alias("_label"), text("type").alias("_type")))).alias("node"))
    link = F.struct(F.concat_ws("-", text("source"), text("target")).alias("_id"), text("source").alias("_source"), text("target").alias("_target"), text("type").alias("_label"), F.coalesce("weight", F.lit(1.0)).alias("_weight"))
    e = edges.groupBy("sample_id").agg(F.sort_array(F.collect_list(link)).alias("edge"))
    both = n.join(e, "sample_id", "left").withColumn("edge", F.coalesce("edge", F.array().cast(f"array<{_EDGE}>")))
    graph = F.struct(F.lit("undirected").alias("_defaultedgetype"), F.struct("node").alias("nodes"), F.struct("edge").alias("edges"))
    return both.select("sample_id", F.to_xml(F.struct(F.lit("1.2").alias("_version"), graph.alias("graph")), {"rowTag": "gexf", "attributePrefix": "_"}).alias("gexf"))


def parse_graph_documents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graph_documents' rows."""
    g = df.select("sample_id", F.from_xml("gexf", _GEXF, {"rowTag": "gexf", "attributePrefix": "_"}).alias("g"))
    nodes = g.select("sample_id", F.explode("g.graph.nodes.node").alias("x")).select("sample_id", F.col("x._id").alias("id"), F.col("x._label").alias("label"), F.col("x._type").alias("type"))
    edges = g.select("sample_id", F.explode("g.graph.edges.edge").alias("x")).select("sample_id", F.col("x._source").alias("source"), F.col("x._target").alias("target"), F.col("x._label").alias("type"), F.col("x._weight").alias("weight"))
    return nodes, edges
