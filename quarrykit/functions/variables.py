"""Template variables: markers, names, substitution, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a variable looks like in each syntax.
SYNTAX = {"jinja": r"\{\{-?\s*([a-zA-Z_]\w*)(?:\s*\|[^}]+?)?\s*-?\}\}", "terraform": r"\$\{var\.([a-zA-Z_]\w*)\}"}


def has_markers(text: Column) -> Column:
    return F.contains(text, F.lit("{{")) | F.contains(text, F.lit("${var."))


def names(text: Column, syntax: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(SYNTAX[syntax]), F.lit(1)))


def substitute(text: Column, values: Column, syntax: str) -> Column:
    """struct(text, complete): known variables replaced; complete if every one was known."""
    pattern = F.lit(SYNTAX[syntax])
    # The text is cut at its markers and each is looked up once, so a value that holds a marker stays as it is.
    gaps = F.split(text, SYNTAX[syntax], -1)
    marks = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"), F.regexp_extract_all(text, pattern, F.lit(1)).alias("name"))
    done = F.transform(marks, lambda m: F.coalesce(F.try_element_at(values, m["name"]), m["whole"]))
    out = F.array_join(F.zip_with(gaps, done, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit("")))), "")
    return F.struct(out.alias("text"), F.forall(names(text, syntax), lambda n: F.map_contains_key(values, n)).alias("complete"))


def in_scope(variables: DataFrame, scope: str) -> DataFrame:
    """(project_id, name, value): the scope's own variables over those of ``all``."""
    own = variables.where(F.col("scope").isin("all", scope))
    first = Window.partitionBy("project_id", "name").orderBy((F.col("scope") == "all").cast("int"))
    return own.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("project_id", "name", "value")


def upsert(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both sides (project_id, scope, name, value, source, created_at, updated_at) merged by key.

    An automatic value never replaces a manual one; otherwise the newest counts.
    The first creation time stays.
    """
    every = held.unionByName(incoming)
    key = ["project_id", "scope", "name"]
    best = F.max_by(F.struct("value", "source", "updated_at"), F.struct((F.col("source") == "manual").cast("int"), F.col("updated_at"), F.col("value")))
    return every.groupBy(*key).agg(best.alias("_b"), F.min("created_at").alias("created_at")).select(*key, "_b.value", "_b.source", "created_at", "_b.updated_at")


def unset(held: DataFrame, scope: str | None = None, name: str | None = None, automatic: bool = False) -> DataFrame:
    """``held`` without the variables of a scope and name; ``automatic`` spares manual ones. At least one must be given."""
    if scope is None and name is None and not automatic:
        raise ValueError("name what to unset")
    gone = F.lit(True)
    for column, value in (("scope", scope), ("name", name)):
        gone = gone if value is None else gone & (F.col(column) == value)
    return held.where(~F.coalesce(gone & (F.col("source") != "manual") if automatic else gone, F.lit(False)))


def without_stale(held: DataFrame, seen: DataFrame) -> DataFrame:
    """``held`` without automatic variables that ``seen`` (project_id, scope, name) lacks."""
    key = ["project_id", "scope", "name"]
    return held.where("source = 'manual'").unionByName(held.where("source <> 'manual'").join(seen.select(*key).distinct(), key, "left_semi"))
