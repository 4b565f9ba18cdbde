"""Chunkers: files (file_id, content, …) to chunks (file_id, ord, kind, name, start_line, end_line, text).

Markdown, Dockerfile, Jinja and project files are split by column functions
within each row, without a shuffle. Languages with a grammar go through the
scanners of :mod:`quarrykit.sources.parsers`, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import paths
from quarrykit.functions.store import dealt
from quarrykit.sources import parsers

CHUNK = "file_id long, ord int, kind string, name string, qualified_name string, start_line int, end_line int, text string"


def _sections(files: DataFrame, heading: str, kind: str, name: Column, preamble: bool) -> DataFrame:
    """Slices of lines, each beginning at a line that matches ``heading``; ``name`` sees the slice's first line as ``head``."""
    lines = F.split("content", "\n")
    marks = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("lines", i).rlike(heading))
    before = F.trim(F.array_join(F.slice(F.col("lines"), F.lit(1), F.coalesce(F.get(F.col("marks"), F.lit(0)), F.size("lines") + 1) - 1), "\n"))
    lead = F.coalesce(F.get(F.col("marks"), F.lit(0)), F.lit(0)) != 1
    opening = lead & ((before != "") | (F.size("marks") == 0)) if preamble else F.lit(False)
    starts = F.when(opening, F.concat(F.array(F.lit(1)), F.col("marks"))).otherwise(F.col("marks"))
    df = files.select("file_id", lines.alias("lines")).withColumn("marks", marks)
    df = df.withColumn("starts", starts).withColumn("first", F.when(opening, 0).otherwise(1))

    def sections(x: Column) -> Column:
        """The slices of a row; only they leave it, so no section carries all lines."""
        end = lambda i: F.coalesce(F.get(x["starts"], i + 1) - 1, F.size(x["lines"]))
        return F.transform(x["starts"], lambda s, i: F.struct(s.alias("start_line"), end(i).alias("end_line"), F.element_at(x["lines"], s).alias("head"), F.array_join(F.slice(x["lines"], s, end(i) - s + 1), "\n").alias("text")))

    cut = F.get(F.transform(F.array(F.struct("lines", "starts")), sections), F.lit(0))
    df = df.select("file_id", "first", F.posexplode(cut).alias("pos", "s")).select("file_id", "first", "pos", "s.*")
    return df.select("file_id", (F.col("pos") + F.col("first")).alias("ord"), F.lit(kind).alias("kind"), name.alias("name"), name.alias("qualified_name"), "start_line", "end_line", "text")


def markdown(files: DataFrame) -> DataFrame:
    """A chunk per H1 or H2; text before the first is chunk 0; deeper headings stay inside."""
    title = F.nullif(F.regexp_extract("head", r"^#{1,2}[ \t]+(.*?)[ \t]*$", 1), F.lit(""))
    return _sections(files, r"^#{1,2}[ \t].*$", "markdown_section", title, True)


def dockerfile(files: DataFrame) -> DataFrame:
    """A chunk per stage; unnamed ones are ``stage_i``; text before the first FROM is dropped."""
    alias = F.regexp_extract("head", r"(?i)^FROM\s+.*?\s+AS\s+(\S+)", 1)
    return _sections(files, r"(?i)^FROM\s", "dockerfile_stage", F.when(alias != "", alias).otherwise(F.concat(F.lit("stage_"), F.col("pos").cast("string"))), False)


_JINJA = r"\{%-?\s*(block|macro|call|filter)\s+([A-Za-z_]\w*)[^%]*%\}[\s\S]*?\{%-?\s*end\1[^%]*%\}"


def jinja(files: DataFrame) -> DataFrame:
    """A chunk per closed block, macro, call or filter; the whole file without any."""
    own = F.regexp_extract_all("content", F.lit(_JINJA), F.lit(0))
    whole = F.size(own) == 0
    df = files.select("file_id", "content", F.posexplode(F.when(whole, F.array("content")).otherwise(own)).alias("ord", "text"), whole.alias("whole"))
    kind = F.concat(F.lit("jinja_"), F.regexp_extract("text", _JINJA, 1))
    name = F.nullif(F.regexp_extract("text", _JINJA, 2), F.lit(""))
    start = F.size(F.split(F.substring("content", F.lit(1), F.position("text", "content") - 1), "\n"))
    return df.select("file_id", "ord", F.when(F.col("whole"), "jinja_block").otherwise(kind).alias("kind"), F.when(~F.col("whole"), name).alias("name"), F.when(~F.col("whole"), name).alias("qualified_name"), start.alias("start_line"), (start + F.size(F.split("text", "\n")) - 1).alias("end_line"), "text")


def msbuild(files: DataFrame) -> DataFrame:
    """The whole file, named by its stem."""
    stem = F.regexp_replace(paths.base_name(F.col("rel_path")), r"\.[^.]*$", "")
    return files.select("file_id", F.lit(0).alias("ord"), F.lit("msbuild_project").alias("kind"), stem.alias("name"), stem.alias("qualified_name"), F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.col("content").alias("text"))


def parsed(files: DataFrame) -> DataFrame:
    """Chunks of the languages with a scanner; a file that can't be parsed gives its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for k, c in enumerate(parsers.chunks(r["lang"], r["rel_path"], r["content"] or "")):
                    out.append({"file_id": r["file_id"], "ord": k, "kind": c.kind, "name": c.name, "qualified_name": c.qualified_name, "start_line": c.start_line, "end_line": c.end_line, "text": c.text})
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return dealt(files.select("file_id", "lang", "rel_path", "content"), "file_id").mapInArrow(run, CHUNK)


_SCHEMA = pa.schema([("file_id", pa.int64()), ("ord", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string())])


def chunk(files: DataFrame) -> DataFrame:
    """All chunks of (file_id, rel_path, lang, content) by language."""
    native = {"markdown": markdown, "dockerfile": dockerfile, "jinja": jinja, "msbuild": msbuild}
    out = parsed(files.where(~F.col("lang").isin(*native)))
    for lang, f in native.items():
        out = out.unionByName(f(files.where(F.col("lang") == lang)))
    return out
