"""Answer cache as a table: validity, replacement, sweep, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: seconds that an answer stays valid.
TTL = 3600.0


def valid(entries: DataFrame, head: str, stamp: float, now: float | Column) -> DataFrame:
    """Entries (query_hash, head_sha, index_stamp, result_json, created_at, expires_at) that may still answer: same commit, same index, not expired."""
    now = F.lit(now) if not isinstance(now, Column) else now
    return entries.where((F.col("head_sha") == head) & (F.col("index_stamp") == stamp) & (F.col("expires_at") > now))


def lookup(asked: DataFrame, entries: DataFrame, head: str, stamp: float, now: float | Column) -> DataFrame:
    """(query_hash, hit, result_json) of each asked hash; a poisoned answer is a miss."""
    held = valid(entries, head, stamp, now).where(F.try_parse_json("result_json").isNotNull()).select("query_hash", "result_json")
    return asked.select("query_hash").join(held, "query_hash", "left").select("query_hash", F.col("result_json").isNotNull().alias("hit"), "result_json")


def put(entries: DataFrame, answers: DataFrame, head: str, stamp: float, now: float) -> DataFrame:
    """``entries`` with ``answers`` (query_hash, result_json) put in; a key (query_hash, head_sha) is replaced with its stamp and time."""
    new = answers.select("query_hash", F.lit(head).alias("head_sha"), F.lit(float(stamp)).alias("index_stamp"), "result_json", F.lit(float(now)).alias("created_at"), F.lit(float(now) + TTL).alias("expires_at"))
    return entries.join(new.select("query_hash", "head_sha"), ["query_hash", "head_sha"], "left_anti").select(*new.columns).unionByName(new)


def swept(entries: DataFrame, now: float | Column) -> DataFrame:
    """Entries that have not expired."""
    return entries.where(F.col("expires_at") >= (F.lit(now) if not isinstance(now, Column) else now))


def statistics(looked_up: DataFrame) -> DataFrame:
    """(hits, misses, bytes, hit_rate) of a :func:`lookup`; the rate of nothing is 0."""
    hits, n = F.count_if("hit"), F.count("*")
    return looked_up.agg(hits.alias("hits"), (n - hits).alias("misses"), F.coalesce(F.sum(F.octet_length("result_json")), F.lit(0)).cast("long").alias("bytes"), F.when(n > 0, F.round(hits / n, 6)).otherwise(0.0).alias("hit_rate"))
