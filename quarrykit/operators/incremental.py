"""Incremental indexing: snapshot diff, reuse of chunks, rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path, state): new, changed, unchanged or deleted, by content_hash."""
    both = old.select("rel_path", F.col("content_hash").alias("was")).join(new.select("rel_path", F.col("content_hash").alias("is")), "rel_path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(F.col("was") == F.col("is"), "unchanged").otherwise("changed")
    return both.select("rel_path", state.alias("state"))


def chunk_reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, content_hash, old_chunk_id, new_chunk_id): chunks matched as bags, each old one at most once.

    Of equal chunks the latest old id goes first. Unmatched old rows are
    orphans, unmatched new ones are to be embedded.
    """
    def counted(df: DataFrame, name: str, descending: bool) -> DataFrame:
        order = F.desc("chunk_id") if descending else F.asc("chunk_id")
        return df.select("file_id", "content_hash", F.col("chunk_id").alias(name), F.row_number().over(Window.partitionBy("file_id", "content_hash").orderBy(order)).alias("nth"))

    return counted(old, "old_chunk_id", True).join(counted(new, "new_chunk_id", False), ["file_id", "content_hash", "nth"], "full_outer").drop("nth")


def update(held_files: DataFrame, held_chunks: DataFrame, files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, states) after an update: what a rebuild gives, but equal chunks keep their ids.

    ``files`` and ``chunks`` are the walk of today with ids that are the same
    on every run. Files are told apart by content_hash; those unchanged keep
    their row and take the new mtime. Chunks of new or changed files that equal
    an old one of the file take its id (and so its vector), others get one of
    their own, as theirs may be an old chunk's; ``states`` has each path's state, and the chunks' column ``fresh`` says what must be embedded.
    """
    states = file_diff(held_files, files)
    same = states.where("state = 'unchanged'").select("rel_path")
    kept = updated(held_files.join(same, "rel_path", "left_semi"), files.select("rel_path", "mtime"), ["rel_path"])
    out_files = kept.unionByName(files.join(same, "rel_path", "left_anti").select(*held_files.columns))
    still = kept.select("file_id")
    old, new = held_chunks.join(still, "file_id", "left_anti"), chunks.join(still, "file_id", "left_anti")
    pairs = chunk_reuse(old, new).where("old_chunk_id is not null and new_chunk_id is not null").select(F.col("new_chunk_id").alias("chunk_id"), "old_chunk_id")
    matched = new.join(pairs, "chunk_id", "left").withColumn("fresh", F.col("old_chunk_id").isNull()).withColumn("chunk_id", F.coalesce("old_chunk_id", F.xxhash64("file_id", "content_hash", "chunk_id")))
    out_chunks = held_chunks.join(still, "file_id", "left_semi").withColumn("fresh", F.lit(False)).unionByName(matched.select(*held_chunks.columns, "fresh"))
    return out_files, out_chunks, states


def updated(held: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """``held`` with the non-null columns of ``values`` put in by key."""
    extra = [c for c in values.columns if c not in key]
    renamed = values.select(*key, *(F.col(c).alias(f"_{c}") for c in extra))
    out = held.join(renamed, key, "left")
    return out.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in extra else F.col(c) for c in held.columns))


def without(held: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    """``held`` without the rows whose key is in ``ids``."""
    return held.join(ids.select(*key).distinct(), key, "left_anti")


def stable_ids(df: DataFrame, *parts: str) -> DataFrame:
    """An id from the parts alone, the same on every run and without a global order."""
    return df.withColumn("id", F.xxhash64(*parts))


def needs_rebuild(meta: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(rebuild): whether a stored stamp differs; a missing one does not count."""
    table = meta.sparkSession.createDataFrame(sorted(expected.items()), "key string, expected string")
    return meta.join(F.broadcast(table), "key").agg(F.coalesce(F.bool_or(F.col("value") != F.col("expected")), F.lit(False)).alias("rebuild"))


def big_split(chunks: DataFrame, limit: int = 1500) -> DataFrame:
    """Chunks of (chunk_id, stored_text) as (chunk_id, part, text): greedy windows of whole lines of at most ``limit`` characters.

    A longer single line is a window of its own; a text within the limit is one window.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc, line):
        fits = acc["open"].isNotNull() & (F.length(acc["open"]) + 1 + F.length(line) <= limit)
        return F.struct(F.when(fits | acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, F.concat(acc["open"], F.lit("\n"), line)).otherwise(line).alias("open"))

    windows = F.aggregate(F.split("stored_text", "\n"), start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    cut = F.when(F.length("stored_text") <= limit, F.array("stored_text")).otherwise(windows)
    return chunks.select("chunk_id", F.posexplode(cut).alias("part", "text"))


def big_parents(chunks: DataFrame, limit: int = 1500) -> DataFrame:
    """(chunk_id, summary, subchunk_count) of chunks that were split."""
    parts = big_split(chunks.where(F.length("stored_text") > limit), limit)
    listed = parts.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("part", F.substring("text", 1, 100).alias("head")))).alias("parts"))
    told = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("  [part "), p["part"].cast("string"), F.lit("] "), p["head"], F.lit("…"))), "\n")
    first = F.split(F.get(F.col("parts"), F.lit(0))["head"], "\n")
    return listed.where(F.size("parts") > 1).select("chunk_id", F.concat_ws("\n", F.get(first, F.lit(0)), told).alias("summary"), F.size("parts").alias("subchunk_count"))
