"""Helpers that several operators share."""

from __future__ import annotations

import pickle
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.functions.store import shared_dir

#: A document word, on lower-cased UTF-8 bytes: digits, a-z and every non-ASCII character.
_WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_FOLD = bytes(_WORD_BYTES[c] for c in _LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: A-Z lower-cased, runs of digits, letters and non-ASCII characters. Null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


#: Whether Spark removes the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors.

    With ``release`` the shuffle files behind it go when the write ends, not
    when the driver's JVM happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast of ``value`` with its class, so that workers need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(held: Broadcast) -> object:
    """The value of :func:`shared`, unpickled once in each worker."""
    if getattr(held, "_opened", None) is None:
        held._opened = pickle.loads(held.value)
    return held._opened


def numbered(df: DataFrame, keys: list[str], order: list[Column], salt: Column, salts: int, name: str) -> DataFrame:
    """Adds a gapless 0-based number within ``keys``.

    Rows of one key are spread over ``salts`` parts; each part is numbered by
    itself and shifted by the sizes of the parts before it, so that no task
    holds all rows of a hot key.
    """
    df = df.withColumn("_salt", F.pmod(salt, F.lit(int(salts))).cast("int"))
    parts = df.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    df = df.withColumn("_in", F.row_number().over(inner))
    return df.join(parts, [*keys, "_salt"]).withColumn(name, (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_salt", "_before", "_in")
