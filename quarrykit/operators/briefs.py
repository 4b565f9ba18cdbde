"""Directory, file and corpus briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.functions import paths
from quarrykit.functions.text import decompress, first_body_line, first_line
from quarrykit.operators.edges import in_degree

# Kinds that are structure, not symbols.
STRUCTURAL = ("big_parent", "big_subchunk", "module_level", "markdown_section", "yaml_doc", "terraform_config", "locals_block", "helm_values_section", "json_object", "jinja_block")
# Fixed value: directories that a map shows at most.
MAX_DIRS = 200


def is_symbol() -> Column:
    return ~F.col("kind").isin(*STRUCTURAL) & F.coalesce("name", "qualified_name").isNotNull()


def top_symbols(chunks: DataFrame, n: int = 5) -> DataFrame:
    """(file_id, rank, symbol) of the largest symbols of each file."""
    largest = Window.partitionBy("file_id").orderBy(F.desc("char_count"), "start_line", "chunk_id")
    return chunks.where(is_symbol()).withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= n).select("file_id", "rank", F.coalesce("qualified_name", "name").alias("symbol"))


def lines_of_code(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(F.coalesce(F.max("end_line"), F.lit(0)).alias("loc"))


def descriptions(chunks: DataFrame) -> DataFrame:
    """(file_id, description): the first telling line of the first module or section chunk, else of one near the top."""
    said = chunks.withColumn("text", decompress(F.col("stored_text")))
    line = F.when(F.col("kind") == "markdown_section", first_body_line(F.col("text"))).otherwise(first_line(F.col("text")))
    first = F.col("kind").isin("module_level", "markdown_section")
    told = said.withColumn("line", line).where(F.col("line").isNotNull() & (F.col("line") != "") & (first | (F.col("start_line") <= 3)))
    return told.groupBy("file_id").agg(F.min_by("line", F.struct((~first).cast("int"), F.col("start_line"), F.col("chunk_id"))).alias("description"))


def directory_map(files: DataFrame, chunks: DataFrame, edges: DataFrame, depth: int = 1, prefix: str | None = None) -> DataFrame:
    """One row per directory key: file_count, dominant_lang, top_kinds, entrypoint.

    Every input is aggregated to the keys on its own; only those rows are joined.
    """
    held = files if not prefix else files.where((F.col("rel_path") == prefix) | F.col("rel_path").startswith(prefix + "/"))
    held = held.withColumn("dir", paths.bucket(F.col("rel_path"), depth)).select("file_id", "rel_path", "lang", "dir")
    langs = held.groupBy("dir", "lang").agg(F.count("*").alias("n"))
    counts = langs.groupBy("dir").agg(F.sum("n").alias("file_count"), F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("dominant_lang"))
    kinds = chunks.where(is_symbol()).join(held.select("file_id", "dir"), "file_id").groupBy("dir", "kind").agg(F.count("*").alias("n"))
    most = Window.partitionBy("dir").orderBy(F.desc("n"), "kind")
    top = kinds.withColumn("r", F.row_number().over(most)).where("r <= 3").groupBy("dir").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "kind"))), lambda x: x["kind"]), ",").alias("top_kinds"))
    entry = held.join(in_degree(edges).withColumnRenamed("target_file_id", "file_id"), "file_id").groupBy("dir").agg(F.min_by("rel_path", F.struct(-F.col("in_degree"), F.col("rel_path"))).alias("entrypoint"))
    return counts.join(top, "dir", "left").join(entry, "dir", "left").select("dir", "file_count", "dominant_lang", F.coalesce("top_kinds", F.lit("")).alias("top_kinds"), "entrypoint").orderBy("dir")


def capped_map(entries: DataFrame, limit: int = MAX_DIRS) -> DataFrame:
    """The first ``limit`` directories of a map, each with whether others were left out."""
    first = entries.orderBy("dir").limit(limit + 1)
    place = F.row_number().over(Window.orderBy("dir"))  # limit + 1 rows at most
    flagged = first.withColumn("_n", place).withColumn("truncated", F.max("_n").over(Window.partitionBy()) > limit)
    return flagged.where(F.col("_n") <= limit).drop("_n")


def why(files: DataFrame, chunks: DataFrame, edges: DataFrame, rel_path: str, neighbours: int = 3) -> DataFrame:
    """One row about a file: lang, size, loc, description, top symbols, inbound and outbound neighbours."""
    own = files.where(F.col("rel_path") == rel_path)
    here = chunks.join(F.broadcast(own.select("file_id")), "file_id", "left_semi")
    symbols = top_symbols(here).groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]).alias("top_symbols"))

    def around(near: str, far: str, name: str) -> DataFrame:
        touching = edges.where("target_file_id is not null").join(F.broadcast(own.select(F.col("file_id").alias(near))), near, "left_semi")
        named = touching.select(F.col(near).alias("file_id"), F.col(far).alias("other")).distinct().join(files.select(F.col("file_id").alias("other"), "rel_path"), "other")
        return named.groupBy("file_id").agg(F.slice(F.array_sort(F.collect_set("rel_path")), 1, neighbours).alias(name))

    out = own.select("file_id", "rel_path", "lang", "size")
    for part in (lines_of_code(here), descriptions(here), symbols, around("target_file_id", "source_file_id", "inbound"), around("source_file_id", "target_file_id", "outbound")):
        out = out.join(part, "file_id", "left")
    return out


def corpus(files: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per project with the numbers of files, chunks and edges."""
    parts = [d.groupBy("project_id").agg(F.count("*").alias(n)) for d, n in ((files, "files"), (chunks, "chunks"), (edges, "edges"))]
    return parts[0].join(parts[1], "project_id", "left").join(parts[2], "project_id", "left").select("project_id", "files", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("edges", F.lit(0)).alias("edges"))


def top_langs(files: DataFrame, n: int = 5) -> DataFrame:
    return files.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(n)


def siblings(files: DataFrame, rel_path: str, limit: int = 50) -> DataFrame:
    """Other files of the same directory."""
    here = F.lit(rel_path)
    return files.where((paths.dir_name(F.col("rel_path")) == paths.dir_name(here)) & (F.col("rel_path") != here)).select("rel_path").orderBy("rel_path").limit(limit)


def staleness(known: DataFrame, listing: DataFrame, slack: float = 1.0) -> DataFrame:
    """(rel_path, state) of files that are missing, changed or new against (rel_path, mtime)."""
    both = known.select("rel_path", F.col("mtime").alias("stored")).join(listing.select("rel_path", "mtime"), "rel_path", "full_outer")
    state = F.when(F.col("stored").isNull(), "new").when(F.col("mtime").isNull(), "missing").when(F.col("mtime") > F.col("stored") + slack, "changed")
    return both.select("rel_path", state.alias("state")).where("state is not null")
