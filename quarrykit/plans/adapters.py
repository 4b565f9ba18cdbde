"""Views of the test tables in the shape of the index: files, chunks, edges, vectors, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same views for DuckDB.
FILES_SQL = "files AS (SELECT 1 AS project_id, doc_id AS file_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.md' AS rel_path, lang, n_chars AS size, text AS stored_text, sha256(text) AS content_hash FROM documents)"
EDGES_SQL = """edges AS (SELECT 1 AS project_id, l_orderkey * 10 + l_linenumber AS edge_id, l_orderkey AS source_file_id,
  CASE WHEN p_brand < 'Brand#4' THEN l_partkey END AS target_file_id,
  CASE WHEN p_brand >= 'Brand#5' THEN 'unresolved' ELSE l_returnflag END AS kind,
  CASE WHEN l_linenumber = 7 THEN '{{ part }}/' || CAST(l_partkey AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS raw, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
CHUNKS_SQL = "chunks AS (SELECT 1 AS project_id, p_partkey AS chunk_id, p_size AS file_id, p_type AS kind, p_name AS name, p_brand || '.' || p_name AS qualified_name, CAST(p_partkey % 40 AS INTEGER) AS start_line, CAST(p_partkey % 40 + p_size AS INTEGER) AS end_line, CAST(p_retailprice AS INTEGER) AS char_count, p_type || ' ' || p_name AS stored_text FROM part)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of source/lang directories."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(F.lit(1).alias("project_id"), F.col("doc_id").alias("file_id"), path.alias("rel_path"), "lang", F.col("n_chars").alias("size"), F.col("text").alias("stored_text"), F.sha2("text", 256).alias("content_hash"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as references of orders to parts; parts of some brands are no files."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").join(part, F.col("l_partkey") == F.col("p_partkey"))
    key = F.col("l_partkey").cast("string")
    return e.select(
        F.lit(1).alias("project_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"),
        F.col("l_orderkey").alias("source_file_id"),
        F.when(F.col("p_brand") < "Brand#4", F.col("l_partkey")).alias("target_file_id"),
        F.when(F.col("p_brand") >= "Brand#5", "unresolved").otherwise(F.col("l_returnflag")).alias("kind"),
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("{{ part }}/"), key)).otherwise(key).alias("raw"),
        F.col("l_linenumber").alias("line"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as chunks: p_name as the symbol, p_size as the file."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.lit(1).alias("project_id"),
        F.col("p_partkey").alias("chunk_id"),
        F.col("p_size").alias("file_id"),
        F.col("p_type").alias("kind"),
        F.col("p_name").alias("name"),
        F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"),
        (F.col("p_partkey") % 40).cast("int").alias("start_line"),
        (F.col("p_partkey") % 40 + F.col("p_size")).cast("int").alias("end_line"),
        F.round("p_retailprice").cast("int").alias("char_count"),
        F.concat_ws(" ", "p_type", "p_name").alias("stored_text"),
    )


def parts_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.lit(1).alias("project_id"), F.col("p_partkey").alias("file_id"), F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.lit("/"), F.col("p_partkey").cast("string")).alias("rel_path"), F.col("p_type").alias("lang"), F.col("p_size").alias("size"))


PARTS_SQL = "pfiles AS (SELECT 1 AS project_id, p_partkey AS file_id, replace(p_brand, '#', '_') || '/' || CAST(p_partkey AS VARCHAR) AS rel_path, p_type AS lang, p_size AS size FROM part)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("kind"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as log entries."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session"), F.col("role").alias("kind"), F.col("text").alias("summary"))
