"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Several rotations, each learned to align its signs with the data, give a long
binary code. Codes are split into substrings, each with a table of its values
and the rows that hold them. Two codes within a Hamming radius agree in some
substring to within the radius's share (pigeonhole), so probing each table
within its share reaches every code within the radius. Whole codes are compared
for the rows so reached, and vectors are read, for the inner product, for those
within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import opened, settle, shared

#: Vectors that rotations and radius are learned from.
SAMPLE = 10_000
#: Bits of a code; a substring is a word of 64.
BITS = 256
#: Shares of the sample's true neighbours that the first radius and the wider one take in.
COVER, WIDE = 0.95, 0.999
#: Rows of an index part, and queries that are broadcast at a time.
ROWS_A_PART, QUERIES_A_BLOCK = 8_192, 16_384
_STEP, _PAIRS = 64, 1 << 16


def _rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """A rotation of the principal axes that brings the rows near the corners of a cube."""
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return axes @ r


class Codes:
    """Learned rotations, and the Hamming radius that takes in true neighbours."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        d = sample.shape[1]
        self.bits = BITS
        x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
        self.planes = np.hstack([_rotation(x, s) for s in range(-(-BITS // d))])[:, :BITS]
        codes = self.encode(sample)
        queries = np.arange(0, len(sample), max(1, len(sample) // 1000))
        far = []
        for i in queries.tolist():
            scores = sample @ sample[i]
            scores[i] = -np.inf
            near = np.argpartition(-scores, min(k, len(scores) - 1))[:k]
            far.append(np.bitwise_count(codes[near[near != i]] ^ codes[i]).sum(axis=1))
        held = np.concatenate(far) if far else np.zeros(0)
        self.radius, self.wide = (int(np.quantile(held, c)) for c in (COVER, WIDE)) if len(held) else (BITS, BITS)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 64-bit words."""
        return np.packbits(x @ self.planes >= 0, axis=1).view(np.uint64)


class MultiIndex:
    """Some rows' codes with a table for each substring: its sorted values, and which of them each row holds."""

    def __init__(self, codes: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.codes = codes
        self.tables = [np.unique(codes[:, j], return_inverse=True) for j in range(codes.shape[1])] if tables is None else tables

    def probed(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """Boolean (query, row): the rows that hold a substring within the radius's share of the query's.

        The shares sum to the radius less all substrings but one: a code that
        exceeds each of them is beyond the radius.
        """
        share, rest = divmod(radius, len(self.tables))
        found = np.zeros((len(queries), len(self.codes)), bool)
        for j, (values, held) in enumerate(self.tables):
            limit = share if j <= rest else share - 1
            if limit >= 0:
                found |= (np.bitwise_count(queries[:, j, None] ^ values[None, :]) <= limit)[:, held]
        return found

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs whose codes lie within ``radius``; whole codes are compared for probed rows only."""
        q, row = np.nonzero(self.probed(queries, radius))
        distance = np.zeros(len(q), np.uint16)
        for w in range(self.codes.shape[1]):
            distance += np.bitwise_count(queries[q, w] ^ self.codes[row, w])
        near = distance <= radius
        return q[near], row[near]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
#: An index part: ids, vectors and codes of its rows, and each substring's values and the value of each row, as bytes.
_PART = "ids binary, vectors binary, codes binary, values array<binary>, held array<binary>"
_PART_SCHEMA = pa.schema([("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("values", pa.list_(pa.binary())), ("held", pa.list_(pa.binary()))])


def _build(codes) -> callable:
    def run(rows: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _PART_SCHEMA.empty_table()
        x = _matrix(rows["embedding"])
        own = opened(codes).encode(x)
        tables = MultiIndex(own).tables
        return pa.table([[rows["vec_id"].to_numpy().tobytes()], [x.tobytes()], [own.tobytes()], [[v.tobytes() for v, _ in tables]], [[h.astype(np.int32).tobytes() for _, h in tables]]], schema=_PART_SCHEMA)

    return run


def _search(asked, probes, radius: int, k: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = opened(asked)
        probe = opened(probes)
        for batch in batches:
            for part in range(batch.num_rows):
                own, x, codes = (np.frombuffer(batch.column(i)[part].as_py(), t) for i, t in ((0, np.int64), (1, np.float64), (2, np.uint64)))
                x = x.reshape(len(own), -1)
                values, held = batch.column(3)[part].as_py(), batch.column(4)[part].as_py()
                index = MultiIndex(codes.reshape(len(own), -1), [(np.frombuffer(v, np.uint64), np.frombuffer(h, np.int32)) for v, h in zip(values, held, strict=True)])
                yield one(ids, q, probe, own, x, index)

    def one(ids, q, probe, own, x, index) -> pa.RecordBatch:
        out: tuple[list, list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        for start in range(0, len(q), _STEP):
            asks, rows = index.within(probe[start : start + _STEP], radius)
            asks += start
            other = ids[asks] != own[rows]
            asks, rows = asks[other], rows[other]
            for block in range(0, len(asks), _PAIRS):  # vectors are read for what lies within the radius only
                a, r = asks[block : block + _PAIRS], rows[block : block + _PAIRS]
                out[0].append(a)
                out[1].append(r)
                out[2].append((x[r] * q[a]).sum(axis=1))
        a, r, score = (np.concatenate(c) for c in out)
        order = np.lexsort((own[r], -score, a))
        a, r, score = a[order], r[order], score[order]
        begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
        best = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a)))) < k
        return pa.RecordBatch.from_arrays([pa.array(ids[a[best]]), pa.array(own[r[best]]), pa.array(score[best])], schema=_OUT)

    return run


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part: of the commonest length, finite, not zero, vec_id not null."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x != 0)")
    top = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (top["n"] if top else 0))


def search(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` nearest of each query by inner product: query_id, rank, vec_id, score.

    Queries are the vectors whose vec_id is divisible by ``every``, candidates
    all others but rows of the query's own vec_id. A repeated vec_id is queried
    once, with its first vector in array order, and each of its rows is a
    candidate. Vectors that are null, zero, not finite or of an uncommon length
    take no part; ties go to the smaller vec_id; a query with fewer than ``k``
    candidates gets them all; further columns are ignored; an empty table gives
    no rows.

    The index is written once, in parts of a fixed number of rows; blocks of a
    fixed number of queries are broadcast and read it where it lies. A query
    that finds fewer than ``k`` within the radius is asked again with a wider
    one, in the end with that of all codes.
    """
    spark = vectors.sparkSession
    rows = settle(sound(vectors))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding")
    model = Codes(_matrix(sample.toArrow()["embedding"]), k)
    parts = -(-n // ROWS_A_PART)
    dealt = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    index = settle(dealt.groupBy("_part").applyInArrow(_build(shared(spark, model)), _PART))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    asked = settle(asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(-(-n // (QUERIES_A_BLOCK * every))))))
    blocks = [r[0] for r in asked.select("_block").distinct().collect()]
    found = None
    for radius in sorted({model.radius, model.wide, BITS}):
        here = []
        for block in blocks:  # a bounded block of queries at a time
            held = asked.where(F.col("_block") == block).orderBy("query_id").toArrow()
            if held.num_rows:
                q = _matrix(held["embedding"])
                here.append(index.mapInArrow(_search(shared(spark, (held["query_id"].to_numpy(), q)), shared(spark, model.encode(q)), radius, k), "query_id long, vec_id long, score double"))
        if not here:
            break
        union = here[0]
        for more in here[1:]:
            union = union.unionAll(more)
        union = settle(_best(union, k))
        full = union.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
        done = union if radius == BITS else union.join(full, "query_id", "left_semi")
        found = done if found is None else found.unionAll(done)
        asked = settle(asked.join(full, "query_id", "left_anti"))
    return (union if found is None else found).select("query_id", "rank", "vec_id", "score")


def _best(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
