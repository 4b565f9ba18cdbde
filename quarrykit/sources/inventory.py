"""Ansible settings: ansible.cfg sections and inventory variables, from files (project_id, rel_path, content)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import paths

# The header of an encrypted file, and what a variable's name looks like.
VAULT, NAME = "$ANSIBLE_VAULT", "^[a-zA-Z_][a-zA-Z0-9_]*$"
#: Directories below which no settings are looked for.
DEPTH = 6


def settings(files: DataFrame) -> DataFrame:
    """(project_id, cfg_dir, key, value) of the ``[defaults]`` sections of every ansible.cfg; of repeated keys the last counts."""
    path = F.col("rel_path")
    own = files.where((paths.base_name(path) == "ansible.cfg") & (F.size(F.split(path, "/")) <= DEPTH + 1))
    section = F.regexp_extract("content", r"(?ms)^\[defaults\][ \t]*$(.*?)(?=^\[|\z)", 1)
    lines = own.select("project_id", paths.dir_name(path).alias("cfg_dir"), F.posexplode(F.split(section, "\n")).alias("n", "line"))
    pair = r"^([^\s=:#;\[][^=:]*?)[ \t]*[=:][ \t]*(.*?)[ \t\r]*$"
    named = lines.where(F.col("line").rlike(pair)).select("project_id", "cfg_dir", "n", F.lower(F.regexp_extract("line", pair, 1)).alias("key"), F.regexp_extract("line", pair, 2).alias("value"))
    return named.groupBy("project_id", "cfg_dir", "key").agg(F.max_by("value", "n").alias("value"))


def search_paths(config: DataFrame, key: str, default: str) -> DataFrame:
    """(project_id, place, dir) of a colon-separated setting of all config files, seen from the root, each once in order; the default after them."""
    own = config.where(F.col("key") == key).select("project_id", "cfg_dir", F.posexplode(F.split("value", ":")).alias("n", "part"))
    joined = F.concat_ws("/", F.nullif(F.col("cfg_dir"), F.lit("")), F.nullif(F.regexp_replace(F.trim("part"), r"^[./]+", ""), F.lit("")))
    every = own.select("project_id", F.struct(F.lit(0).alias("late"), "cfg_dir", "n").alias("place"), joined.alias("dir"))
    fallback = config.select("project_id", "cfg_dir").distinct().select("project_id", F.struct(F.lit(1).alias("late"), "cfg_dir", F.lit(0).alias("n")).alias("place"), F.concat_ws("/", F.nullif(F.col("cfg_dir"), F.lit("")), F.lit(default)).alias("dir"))
    return distinct_in_order(every.unionByName(fallback).where("dir <> ''"), ["project_id"], "dir", "place")


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each value of a key once, at its first place."""
    return rows.groupBy(*keys, value).agg(F.min(order).alias(order))


def layer(path: Column, inventory: Column) -> Column:
    """Precedence of a variables file, null for other files: group variables of the inventory, of playbooks, then host variables of either.

    ``inventory`` says whether the file lies below an inventory directory.
    """
    file = path.rlike(r"\.ya?ml$")
    group = path.rlike(r"(^|/)group_vars/all(\.ya?ml|/.+)$")
    host = path.rlike(r"(^|/)host_vars/.+$")
    return F.when(file & group, F.when(inventory, 0).otherwise(1)).when(file & host, F.when(inventory, 2).otherwise(3))


def _text(value: object) -> str | None:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value) if isinstance(value, str | int | float) else None


def scalars(text: str | None) -> list[tuple[str, str]]:
    """Top-level names and scalar values, as text, of a file's first document; nothing of encrypted, broken or other files."""
    if not text or text.lstrip().startswith(VAULT):
        return []
    try:
        first = next(iter(yaml.safe_load_all(text)), None)
    except yaml.YAMLError:
        return []
    return [(k, v) for k, x in first.items() if isinstance(k, str) and (v := _text(x)) is not None] if isinstance(first, dict) else []


def variables(files: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """(project_id, source, name, value) of inventory files: the highest layer counts, in a layer the last path; ``source`` is group_vars or host_vars.

    Roots are the project itself, the directories of its config files, and the
    inventories that those name.
    """
    path = F.col("rel_path")
    dirs = files.select("project_id").distinct().select("project_id", F.lit("").alias("dir"), F.lit(False).alias("inv"))
    if config is not None:
        cfg = config.select("project_id", F.col("cfg_dir").alias("dir"), F.lit(False).alias("inv")).distinct()
        inv = config.where("key = 'inventory'").select("project_id", F.concat_ws("/", F.nullif(F.col("cfg_dir"), F.lit("")), F.regexp_replace(F.trim(F.substring_index("value", ":", 1)), r"^[./]+|/+$", "")).alias("dir"), F.lit(True).alias("inv"))
        dirs = dirs.unionByName(cfg).unionByName(inv).distinct()
    base = F.regexp_extract("rel_path", r"^(?:(.*)/)?(?:group_vars|host_vars)/", 1)
    own = files.where(path.rlike(r"(^|/)(group_vars|host_vars)/")).select("project_id", "rel_path", "content", base.alias("dir")).join(dirs, ["project_id", "dir"])
    placed = own.withColumn("layer", layer(path, F.col("inv"))).where("layer is not null").groupBy("project_id", "rel_path", "content").agg(F.max("layer").alias("layer"))
    schema = pa.schema([("project_id", pa.int64()), ("layer", pa.int32()), ("rel_path", pa.string()), ("name", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"project_id": r["project_id"], "layer": r["layer"], "rel_path": r["rel_path"], "name": k, "value": v} for r in batch.to_pylist() for k, v in scalars(r["content"])]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    read = placed.select(F.col("project_id").cast("long").alias("project_id"), F.col("layer").cast("int").alias("layer"), "rel_path", "content").mapInArrow(run, "project_id long, layer int, rel_path string, name string, value string")
    source = F.when(F.col("layer") < 2, "group_vars").otherwise("host_vars")
    return read.where(F.col("name").rlike(NAME)).groupBy("project_id", source.alias("source"), "name").agg(F.max_by("value", F.struct("layer", "rel_path")).alias("value"))
