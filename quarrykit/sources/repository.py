"""Repository listings, staged files and the index tables."""

from __future__ import annotations

import os
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import paths
from quarrykit.functions.store import stored
from quarrykit.functions.text import chunk_hash, compress, decompress, scrub
from quarrykit.functions.variables import upsert
from quarrykit.operators import edges
from quarrykit.operators.retrieval import hashed_encoder
from quarrykit.sources import chunkers, extractors

IGNORE_FILE = ".gitignore"


def nested_rules(spark: SparkSession, root: str, depth: int = 12) -> list[str]:
    """The rules of all ignore files under ``root``, as rules of the root, outer files first.

    Readers skip hidden files, so these few are listed and read by the driver.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(at).toUri().getPath().rstrip("/")
    out = []
    for level in range(depth):
        found = system.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{'*/' * level}{IGNORE_FILE}"))
        for path in sorted(str(f.getPath().toUri().getPath()) for f in found or ()):
            stream = system.open(jvm.org.apache.hadoop.fs.Path(path))
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            directory = path[len(base) + 1 :].rpartition("/")[0]
            lines = [line.strip() for line in text.splitlines()]
            out += [paths.rerooted(line, directory) if directory else line for line in lines if line and not line.startswith("#")]
    return out


def walk(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """(file_id, rel_path, lang, size, mtime, content, content_hash) of the files of known languages under ``root`` that no rule ignores.

    Ignore files at any depth count, after ``rules`` and before the fixed ones.
    Files that a link leads to outside the root are left out. Files of any size
    that the reader can hold in a row are read.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    base = system.makeQualified(at).toUri().getPath().rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?/+", "/")
    listed = raw.withColumn("rel_path", F.substring(path, len(base) + 2, 1 << 30))
    if system.getScheme() == "file":
        inside = _inside(base)
        listed = listed.where(inside(F.col("rel_path")))
    own = [*rules, *nested_rules(spark, root), *paths.IGNORED]
    files = listed.select("rel_path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))
    kept = paths.ignored(files, spark.createDataFrame(list(enumerate(own)), "ord int, pattern string")).where(~F.col("ignored")).drop("ignored").withColumn("lang", paths.language(F.col("rel_path")))
    return kept.where("lang is not null").withColumn("file_id", F.xxhash64("rel_path"))


def _inside(base: str):
    """Whether a local file below ``base`` really lies there, links followed."""

    @F.pandas_udf("boolean")
    def inside(rel: pd.Series) -> pd.Series:
        root = os.path.realpath(base)
        return rel.map(lambda r: os.path.realpath(os.path.join(base, r)).startswith(root + os.sep))

    return inside


def index(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, raw edges) of files; chunk texts are stored scrubbed and compressed, hashed as stored."""
    chunks = chunkers.chunk(files).withColumn("content_hash", chunk_hash(F.col("text"))).withColumn("stored_text", compress(scrub(F.col("text")))).withColumn("char_count", F.length("text")).drop("text")
    return chunks.withColumn("chunk_id", F.xxhash64("file_id", "ord")), extractors.edges(files)


def build(spark: SparkSession, root: str, project: int, rules: list[str] = (), variables: Column | None = None, encode=hashed_encoder) -> dict[str, DataFrame]:
    """The whole index of a repository: files, chunks, vectors and resolved edges, each with project_id.

    Every table comes from the walk alone, so writing them over a project is a
    rebuild. Role and library directories are those that config files name.
    """
    files = stored(walk(spark, root, rules).withColumn("project_id", F.lit(project).cast("long")))
    chunks, raw = index(files)
    chunks = stored(chunks.withColumn("project_id", F.lit(project).cast("long")))
    vectors = chunks.select("project_id", "chunk_id", encode(decompress(F.col("stored_text"))).alias("embedding"))
    named = raw.join(files.select("file_id", "project_id", "lang", F.col("rel_path").alias("source_rel")).hint("merge"), "file_id").withColumnRenamed("file_id", "source_file_id")
    named = stored(named.withColumn("edge_id", F.xxhash64("source_file_id", "kind", "raw", "symbol", "line")).dropDuplicates(["edge_id"]))
    return {"files": files, "chunks": chunks, "vectors": vectors, "edges": edges.resolve(named, files.select("project_id", "file_id", "rel_path"), variables)}


class Busy(RuntimeError):
    """Somebody else writes the project."""


@contextmanager
def only_writer(spark: SparkSession, path: str, project: int):
    """Holds a project's lock file below ``path`` while its tables are written; raises :class:`Busy` at once if it is held."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_writer-{project}.lock")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.createNewFile(at):
        raise Busy(f"project {project} is being written")
    try:
        yield
    finally:
        system.delete(at, False)


def write(df: DataFrame, path: str, project: str = "project_id") -> None:
    """Replace the projects that ``df`` holds, leaving the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(project).parquet(path)


def upsert_json(spark: SparkSession, held: DataFrame, path: str, project: int, scope: str, now: float) -> DataFrame:
    """``held`` variables with those of a JSON file put in as manual ones."""
    new = variables_json(spark, path).select(F.lit(project).cast("long").alias("project_id"), F.lit(scope).alias("scope"), "name", F.coalesce("value", F.lit("")).alias("value"), F.lit("manual").alias("source"), F.lit(float(now)).alias("created_at"), F.lit(float(now)).alias("updated_at"))
    return upsert(held, new)


def variables_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of a JSON object of variables, values as strings."""
    body = spark.read.text(path, wholetext=True)
    return body.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))


def reslice(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Original bytes of (file_id, start_byte, end_byte) from the files' content."""
    part = F.substring(F.encode("content", "UTF-8"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))
    return spans.join(files.select("file_id", "content"), "file_id").select("file_id", "start_byte", "end_byte", F.decode(part, "UTF-8").alias("text"))
