"""Projects: registration, selection, counts, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.text import normalized_remote


class AmbiguousProject(ValueError):
    """A name that several projects bear; their roots are the arguments after the name."""


def registered(projects: DataFrame, roots: DataFrame, now: float) -> DataFrame:
    """``projects`` (project_id, name, root_path, git_remote, remote_key, created_at) with a row for each new root.

    ``roots`` holds (name, root_path, git_remote). A root is known by its
    normalised remote, or by its path where it has none; equal new ones count
    once, under their first path.
    """
    keyed = lambda df: df.withColumn("_key", F.coalesce(F.concat(F.lit("r:"), F.col("remote_key")), F.concat(F.lit("p:"), F.col("root_path"))))
    new = keyed(roots.withColumn("remote_key", normalized_remote(F.col("git_remote"))))
    new = new.groupBy("_key").agg(F.min_by(F.struct("name", "root_path", "git_remote", "remote_key"), "root_path").alias("r")).select("_key", "r.*")
    new = new.join(keyed(projects).select("_key"), "_key", "left_anti")
    fresh = new.select(F.xxhash64("_key").alias("project_id"), "name", "root_path", "git_remote", "remote_key", F.lit(float(now)).alias("created_at"))
    return projects.select(*fresh.columns).unionByName(fresh)


def selected(projects: DataFrame, selector: str) -> DataFrame:
    """The project of an absolute path or a name, at most one row; a name of several raises :class:`AmbiguousProject`."""
    if selector.startswith("/"):
        return projects.where(F.col("root_path") == selector)
    own = projects.where(F.col("name") == selector)
    roots = sorted(r["root_path"] for r in own.select("root_path").limit(100).collect())
    if len(roots) > 1:
        raise AmbiguousProject(selector, *roots)
    return own


def next_free_name(projects: DataFrame, base: str) -> str:
    """``base_n`` with the least n from 2 on that no project bears."""
    number = F.regexp_extract("name", "_([1-9][0-9]{0,8})$", 1)
    held = projects.where(F.col("name") == F.concat(F.lit(base + "_"), number)).select(number.cast("long").alias("n")).where("n >= 2").distinct()
    # The first number whose successor is free, or 2 itself.
    gap = held.join(held.select((F.col("n") - 1).alias("n")), "n", "left_anti").agg(F.min("n")).first()[0]
    return f"{base}_{2 if held.where('n = 2').isEmpty() else gap + 1}"


def counts(projects: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(project_id, name, file_count, chunk_count), computed where another engine would store them."""
    out = projects.select("project_id", "name")
    for df, name in ((files, "file_count"), (chunks, "chunk_count")):
        out = out.join(df.groupBy("project_id").agg(F.count("*").alias(name)), "project_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def without_project(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    """Every table without the rows of a project; tables of rows that hang on chunks lose theirs too."""
    out = {}
    gone = tables["chunks"].where(F.col("project_id") == project_id).select("chunk_id") if "chunks" in tables else None
    for name, df in tables.items():
        if "project_id" in df.columns:
            out[name] = df.where(F.col("project_id") != project_id)
        else:
            out[name] = df.join(gone, "chunk_id", "left_anti") if gone is not None and "chunk_id" in df.columns else df
    return out
