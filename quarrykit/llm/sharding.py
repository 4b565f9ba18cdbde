"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts by default) are sorted by size, largest first; each enters
the open bin with the least remaining capacity that still holds it, found in a
balanced tree. Groups of one size class are interchangeable for the packing, so
the driver packs the histogram of size classes (a bounded table) and executors
look up each group's bin by its number within the class.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, settle

#: Sizes below 2**BITS are their own class; larger ones are rounded up to BITS leading bits.
BITS = 12
#: Rows that one numbering task takes.
ROWS_A_PART = 65_536


class _Tree:
    """A treap of (remaining capacity, bin), for the smallest entry at or above a size."""

    __slots__ = ("root", "rng")

    def __init__(self) -> None:
        self.root, self.rng = None, random.Random(7)

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def add(self, key: tuple[int, int]) -> None:
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self.rng.random(), None, None]), right)

    def pop_at_least(self, size: int) -> tuple[int, int] | None:
        left, right = self._split(self.root, (size, -1))
        found = right
        while found is not None and found[2] is not None:
            found = found[2]
        if found is None:
            self.root = left
            return None
        _, rest = self._split(right, (found[0][0], found[0][1] + 1))
        self.root = self._merge(left, rest)
        return found[0]


def best_fit_decreasing(classes: list[tuple[int, int]], capacity: int) -> tuple[dict[int, list[tuple[int, int]]], int]:
    """Pack ``classes`` of (size, count) into bins of ``capacity``.

    Returns, by size, the runs (first number in the class, bin), and the number
    of bins. A size above ``capacity`` gets a bin of its own for each group.
    The same as packing group by group: the tightest bin stays the tightest
    while equal sizes enter it.
    """
    tree, runs, bins = _Tree(), {}, 0
    for size, count in sorted(classes, reverse=True):
        placed, own = 0, runs.setdefault(size, [])
        while placed < count:
            found = tree.pop_at_least(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            n = min(count - placed, found[0] // size)
            own.append((placed, found[1]))
            placed += n
            if found[0] - n * size:
                tree.add((found[0] - n * size, found[1]))
    return runs, bins


def pack_into(classes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """The tightest packing found into ``shards`` bins at most.

    Groups above the mean of what is left get bins of their own, largest first;
    for the rest, capacity starts at the mean of the bins left and grows until all fit.
    """
    left, own, runs = sorted(classes, reverse=True), 0, {}
    total = sum(s * n for s, n in left)
    # A class goes as a whole: without one of its groups the mean is lower still. One bin at least stays.
    while left and left[0][0] * (shards - own) > total:
        size, count = left.pop(0)
        runs[size] = [(i, own + i) for i in range(count)]
        own, total = own + count, total - size * count
    base, slack = max(1, -(-total // (shards - own))), 0
    while True:
        rest, bins = best_fit_decreasing(left, base + slack)
        if bins <= shards - own:
            return runs | {size: [(first, own + b) for first, b in r] for size, r in rest.items()}
        slack = max(1, slack * 2)


def shard(docs: DataFrame, shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    ``shards`` bins of nearly equal bytes, or, with ``capacity``, as few bins of
    that many bytes as best fit finds. Equal texts share a shard. Size is UTF-8
    bytes plus 1; a null text counts as empty and shares its group. A group
    larger than the capacity, or than the mean of what larger ones leave to the
    other shards, is not divided: it gets a bin of its own. Repeated
    rows each take a slot; an empty table gives no rows; other columns are
    ignored. Slots are numbered by parts of a hash of doc_id and text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_key")))
    groups = rows.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    shift = f"cast(greatest(0, length(bin(_bytes)) - {BITS}) as int)"
    groups = groups.withColumn("_class", F.expr(f"shiftleft(shiftright(_bytes + shiftleft(1L, {shift}) - 1, {shift}), {shift})"))
    # At most 2**BITS plus 2**(BITS-1) classes for each doubling of the size.
    classes = [(r["_class"], r["n"], r["rows"]) for r in groups.groupBy("_class").agg(F.count("*").alias("n"), F.sum("_rows").alias("rows")).collect()]
    sizes = [(c, n) for c, n, _ in classes]
    runs = best_fit_decreasing(sizes, capacity)[0] if capacity else pack_into(sizes, shards)
    n_groups, n_rows = sum(n for _, n, _ in classes), sum(r for *_, r in classes)
    table = docs.sparkSession.createDataFrame([(c, [a for a, _ in own], [b for _, b in own]) for c, own in runs.items()], "_class long, _from array<long>, _bin array<int>")
    groups = numbered(groups, ["_class"], [F.col("_key")], F.xxhash64("_key"), -(-n_groups // ROWS_A_PART) or 1, "_nth")
    groups = groups.join(F.broadcast(table), "_class")  # bounded by the number of classes and bins
    groups = groups.select("_key", F.expr("element_at(_bin, size(filter(_from, f -> f <= _nth)))").alias("shard"))
    placed = rows.join(groups, "_key").drop("_key")
    return numbered(placed, ["shard"], [F.col("doc_id"), F.col("text_crc32")], F.xxhash64("doc_id", "text_crc32"), -(-n_rows // ROWS_A_PART) or 1, "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
