"""Staged log lines: parsing, exactly-once ingest, outbox with dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrykit.functions.text import scrub

LINE = "short string, long string, session_id string, tags string"


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value, …) with the fields of a staged entry and ``ok``: an object whose short and long texts are not blank."""
    entry = F.from_json("value", LINE, {"mode": "PERMISSIVE"})
    out = lines.withColumn("_e", F.when(F.try_parse_json("value").isNotNull(), entry))
    fields = [F.col(f"_e.{c}").alias(c) for c in ("short", "long", "session_id", "tags")]
    ok = F.coalesce((F.trim("_e.short") != "") & (F.trim("_e.long") != ""), F.lit(False))
    return out.select(*lines.columns, *fields, ok.alias("ok"))


def ingest(spark: SparkSession, staged: str, history: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Read every staged file once into ``history`` (scrubbed) and malformed lines into ``rejected``, then stop.

    The checkpoint remembers which files are done, so each is taken exactly
    once; batches are written under their number, so a repeated batch replaces
    itself. One bad line or file doesn't block others.
    """
    lines = spark.readStream.format("text").load(staged)

    def write(batch: DataFrame, number: int) -> None:
        rows = parsed(batch)
        kept = rows.where("ok").select(scrub(F.col("short")).alias("short_summary"), scrub(F.col("long")).alias("long_summary"), "session_id", "tags")
        kept.write.mode("overwrite").parquet(f"{history}/batch={number}")
        rows.where("not ok").select("value").write.mode("overwrite").parquet(f"{rejected}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(outbox: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """(deliverable, dead letters) of outbox lines (event_id, value): each event once, unknown kinds and broken lines apart."""
    entry = F.from_json("value", "kind string, ts double, root string, payload string")
    rows = outbox.dropDuplicates(["event_id"]).withColumn("e", F.when(F.try_parse_json("value").isNotNull(), entry))
    good = F.coalesce(F.col("e.kind").isin(kinds) & F.col("e.payload").isNotNull(), F.lit(False))
    return rows.where(good).select("event_id", "e.*"), rows.where(~good).select("event_id", "value")
