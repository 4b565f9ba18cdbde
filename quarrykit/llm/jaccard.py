"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Each document's set of five-word shingles gets a signature of several trees of
hashes. A tree is a prefix trie, held as its sorted labels: neighbours in that
order give every trie node as a run, and the prefix that two documents match is
the least that neighbours between them share. A document starts from the whole
label and its prefix is shortened, hash by hash, until a partner of the least
similarity that a set of its size can have at the threshold is met with the
target recall. So short texts stop at long prefixes, or need no partner at all,
and the others go as far down as the threshold asks. Documents that share a
node that both have come down to are candidates, and candidates are verified on
their whole shingle sets, block by block, so that large groups are neither
expanded into pairs nor held in one task.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, words_of
from .components import components

WORDS, THRESHOLD, TARGET = 5, 0.8, 0.999
TREES, DEPTH = 32, 10
#: Bytes of a label: two for each hash.
_LABEL = 2 * DEPTH
#: Documents of a verification block.
BLOCK = 256
_COLUMNS = 8192
_P = np.uint64(0x9E3779B97F4A7C15)


def depth_for(similarity: float, target: float = TARGET, trees: int = TREES, longest: int = DEPTH) -> int:
    """The longest prefix at which pairs of ``similarity`` meet in some tree with probability ``target``."""
    for depth in range(longest, 1, -1):
        if 1 - (1 - similarity**depth) ** trees >= target:
            return depth
    return 1


@cache
def least_similarity(size: int, threshold: float) -> float | None:
    """The least similarity at or above ``threshold`` that a set of ``size`` can have to another set; None if no other set reaches it."""
    if size > 64:
        return threshold  # as good as reached
    found = None
    for other in range(max(1, ceil(size * threshold - 1e-9)), int(size / threshold + 1e-9) + 1):
        for shared in range(1, min(size, other) + 1):
            union = size + other - shared
            if shared < union and shared >= threshold * union - 1e-9:
                found = min(found or 1.0, shared / union)
    return found


@cache
def need(size: int, threshold: float, target: float = TARGET) -> int:
    """How long a prefix a set of ``size`` must match to find its partners with the target recall; DEPTH + 1 if it has none."""
    least = least_similarity(size, threshold) if size else None
    return DEPTH + 1 if least is None else depth_for(least, target)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a text of fewer words is one shingle; none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n_own = min(n, len(words))
    out = h[: len(h) - n_own + 1].copy()
    for k in range(1, n_own):
        out *= _P
        out += h[k : len(h) - n_own + 1 + k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(own: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a shingle set."""
    least = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), 128):
        np.minimum(least, (own[start : start + 128, None] * by).min(axis=0), out=least)
    return least


def _node_of(own: np.ndarray, text: str | None, doc_id: int | None) -> int:
    """A number of the shingle set; wordless texts count as their own text, null and empty ones as their doc_id."""
    data = b"s" + own.tobytes() if len(own) else (b"t" + text.encode("utf-8", "surrogatepass") if text else b"d%r" % doc_id)
    return xxhash.xxh3_128_intdigest(data) % (1 << 63)


def _signatures(n: int, threshold: float, target: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers(DEPTH * TREES)
        for batch in batches:
            nodes, needs, labels = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                own = shingles(text, n)
                nodes.append(_node_of(own, text, doc_id))
                needs.append(need(min(len(own), 65), threshold, target))
                labels.append((signature(own, by) >> np.uint64(20)).astype(">u2").tobytes() if needs[-1] <= DEPTH else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "node": pa.array(nodes, pa.int64()), "need": pa.array(needs, pa.int32()), "labels": pa.array(labels, pa.binary())})

    return run


class Walk:
    """Runs of a sorted trie, read in order: at each depth, documents that have come down to it are linked to the one before in their node."""

    def __init__(self, lowest: int) -> None:
        self.depths = range(lowest, DEPTH + 1)
        self.first = self.last = None
        self.head: dict[int, int | None] = {}  # first document of the run that the part begins with
        self.tail: dict[int, int | None] = dict.fromkeys(self.depths)  # last one of the run that it ends with
        self.whole = dict.fromkeys(self.depths, True)  # whether it is one run

    @staticmethod
    def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes that the labels of two rows of keys (tree, label) share from the start; -1 in different trees."""
        same = (a[:, 1::2] == b[:, 1::2]) & (a[:, 2::2] == b[:, 2::2])
        lengths = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
        return np.where(a[:, 0] == b[:, 0], lengths, -1)

    def read(self, keys: np.ndarray, nodes: np.ndarray, needs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links that the next rows (in order) add."""
        start = self.last is None
        if start:
            self.first = keys[0]
        lcp = np.concatenate(([-1] if start else self.matched(self.last[None], keys[:1]), self.matched(keys[:-1], keys[1:])))
        u, v = [], []
        for d in self.depths:
            run = np.cumsum(lcp < d)
            on = run[0] == 0  # goes on with the run before
            at = np.flatnonzero(needs <= d)
            near = run[at][1:] == run[at][:-1]
            u.append(nodes[at][:-1][near])
            v.append(nodes[at][1:][near])
            opening = at[:1][run[at[:1]] == run[0]]
            if len(opening) and on and self.tail[d] is not None:
                u.append(np.array([self.tail[d]]))
                v.append(nodes[opening])
            if len(opening) and (start or (self.whole[d] and on)):
                self.head.setdefault(d, int(nodes[opening[0]]))
            self.whole[d] &= (run[-1] == run[0]) and (start or on)
            closing = at[-1:][run[at[-1:]] == run[-1]]
            if len(closing):
                self.tail[d] = int(nodes[closing[0]])
            elif run[-1] != run[0] or not on:
                self.tail[d] = None
        self.last = keys[-1]
        u, v = np.concatenate(u), np.concatenate(v)
        return np.unique(np.stack([u, v], axis=1), axis=0).T if len(u) else (u, v)


def borders(walks: list[Walk]) -> list[tuple[int, int]]:
    """The links between parts that follow each other: from the last document of a run to the first one that goes on with it."""
    links, last, tail = [], None, {}
    for w in walks:
        lcp = -1 if last is None else int(Walk.matched(last[None], w.first[None])[0])
        for d in w.depths:
            if lcp >= d and tail[d] is not None and w.head.get(d) is not None:
                links.append((tail[d], w.head[d]))
            spanned = w.whole[d] and lcp >= d and w.tail[d] is None
            tail[d] = tail[d] if spanned else w.tail[d]
        last = w.last
    return links


def _walked(lowest: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(lowest)
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("part", pa.binary())])
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, 1 + _LABEL)
                u, v = walk.read(keys, batch.column(1).to_numpy(), batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.binary())], schema=schema)
        if walk.last is not None:
            yield pa.RecordBatch.from_pydict({"u": [None], "v": [None], "part": [pickle.dumps((walk.first, walk.last, walk.head, walk.tail, walk.whole))]}, schema=schema)

    return run


def forest(nodes: DataFrame, lowest: int) -> DataFrame:
    """Candidate links (u, v) of ``nodes`` (node, need, labels): those that share a trie node are connected by them.

    All tries are one table sorted by (tree, label, node), dealt out by range,
    so that a prefix which many share is spread over tasks. Each part also gives
    the runs at its borders: one row a part, joined on the driver.
    """
    spark = nodes.sparkSession
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    keys = nodes.where(F.col("need") <= DEPTH).select("node", "need", "labels", tree.alias("tree"))
    keys = keys.select(F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(labels, tree * {_LABEL} + 1, {_LABEL})")).alias("key"), "node", F.col("need").cast("int").alias("need"))
    ordered = keys.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    found = settle(ordered.mapInArrow(_walked(lowest), "u long, v long, part binary"))
    parts = []
    for r in found.where("part is not null").select("part").collect():
        walk = Walk(lowest)
        walk.first, walk.last, walk.head, walk.tail, walk.whole = pickle.loads(r["part"])
        parts.append(walk)
    parts.sort(key=lambda w: (w.first.tobytes(), w.last.tobytes()))
    across = borders(parts)
    return found.where("part is null").select("u", "v").union(spark.createDataFrame(across, "u long, v long")).distinct()


def _sets(n: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            kept = [(node, own) for node, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for own in [shingles(text, n)] if _node_of(own, text, doc_id) == node]
            yield pa.RecordBatch.from_pydict({"node": pa.array([k for k, _ in kept], pa.int64()), "own": pa.array([x.tobytes() for _, x in kept], pa.binary())})

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``, from incidence matrices of the shared shingles."""
    va, vb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return out
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])

    def columns(v, r):
        at = np.minimum(np.searchsorted(both, v), len(both) - 1)
        own = both[at] == v
        return at[own], r[own]

    (ca, ra), (cb, rb) = columns(va, ra), columns(vb, rb)
    for start in range(0, len(both), _COLUMNS):
        width = min(_COLUMNS, len(both) - start)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        own = (ca >= start) & (ca < start + width)
        x[ra[own], ca[own] - start] = 1
        own = (cb >= start) & (cb < start + width)
        y[rb[own], cb[own] - start] = 1
        out += x @ y.T
    return out


_VERIFIED = "node long, root long, links long, classes long"


def _verify(threshold: float) -> callable:
    schema = pa.schema([(k, pa.int64()) for k in ("node", "root", "links", "classes")])

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        nodes, first = np.unique(table["node"].to_numpy(), return_index=True)
        sets = [np.frombuffer(table["own"][int(i)].as_py(), np.uint64) for i in first]
        copies, group, block = (table[c].to_numpy()[first] for c in ("copies", "group", "block"))
        i, j = int(table["i"][0].as_py()), int(table["j"][0].as_py())
        # One block against itself, or block i against block j; blocks of a bundle hold several small groups.
        a = np.arange(len(nodes)) if i == j else np.flatnonzero(block == i)
        b = a if i == j else np.flatnonzero(block == j)
        root = np.arange(len(nodes))
        links, classes = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        parts = []
        for sa in range(0, len(a), BLOCK):
            for sb in range(0, len(b), BLOCK):
                pa_, pb_ = a[sa : sa + BLOCK], b[sb : sb + BLOCK]
                shared = overlaps([sets[k] for k in pa_], [sets[k] for k in pb_]).astype(np.float64)
                na, nb = np.array([len(sets[k]) for k in pa_]), np.array([len(sets[k]) for k in pb_])
                union = na[:, None] + nb[None, :] - shared
                close = (shared >= threshold * union - 1e-9) & (group[pa_][:, None] == group[pb_][None, :]) & (pa_[:, None] != pb_[None, :])
                x, y = np.nonzero(close)
                np.add.at(links, pa_[x], copies[pb_[y]])
                np.add.at(classes, pa_[x], 1)
                if i != j:
                    np.add.at(links, pb_[y], copies[pa_[x]])
                    np.add.at(classes, pb_[y], 1)
                parts.append((pa_[x], pb_[y]))
        u, v = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int))
        while True:  # least label over links, until none changes
            old = root.copy()
            np.minimum.at(root, u, root[v])
            np.minimum.at(root, v, root[u])
            root = root[root]
            if (root == old).all():
                break
        return pa.table([nodes, nodes[root], links, classes], schema=schema)

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, target: float = TARGET) -> DataFrame:
    """One row per document row: doc_id, class_id, set_id, n_links.

    ``set_id`` is the least doc_id with the same shingle set, ``class_id`` the
    least doc_id reachable over links, ``n_links`` the number of other document
    rows whose sets have a Jaccard similarity of ``threshold`` or more. Texts of
    fewer than ``n`` words are one shingle. Texts without words link to equal
    texts only; a null or empty text only to rows of its own doc_id. Repeated
    rows link to each other; an empty table gives no rows; further columns are
    ignored.

    Pairs of exactly the threshold share a node that both came down to with
    probability ``target`` or more, closer ones with a higher one; what meets is
    verified exactly. Documents with one shingle set are one node, so copies cost
    nothing; a group of candidates is verified in blocks of fixed size.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = settle(docs.mapInArrow(_signatures(n, threshold, target), "doc_id long, node long, need int, labels binary"))
    nodes = settle(rows.groupBy("node").agg(F.min("doc_id").alias("set_id"), F.count("*").alias("copies"), F.min("need").alias("need"), F.first("labels").alias("labels")))
    groups = settle(components(forest(nodes, depth_for(threshold, target))).withColumnRenamed("root", "group"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= BLOCK).agg(F.sum("n")).first()[0] or 0
    bundles = max(1, -(-small // BLOCK))
    placed = groups.join(sizes, "group").withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("bundle", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(bundles))).otherwise(F.col("group")))
    placed = placed.withColumn("big", F.col("blocks") > 1)
    # The texts of one document per candidate node.
    wanted = placed.join(nodes.select("node", "set_id", "copies"), "node")
    picked = docs.join(wanted.select("node", F.col("set_id").alias("doc_id")), "doc_id").select("node", "doc_id", "text")
    sets = picked.mapInArrow(_sets(n), "node long, own binary").join(wanted.drop("set_id", "n"), "node")
    paired = sets.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "k"), "j": F.greatest("block", "k")})
    verified = settle(paired.select("node", "own", "copies", "group", "block", "big", "bundle", "i", "j").groupBy("big", "bundle", "i", "j").applyInArrow(_verify(threshold), _VERIFIED))
    linked = verified.groupBy("node").agg(F.sum("links").alias("links"), F.sum("classes").alias("classes"))
    roots = components(verified.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    labelled = nodes.select("node", "set_id", "copies").join(linked, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = settle(labelled.select("node", "set_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")))
    least = labelled.groupBy("root").agg(F.min("set_id").alias("class_id"))
    return rows.select("doc_id", "node").join(labelled.join(least, "root").drop("root"), "node").select("doc_id", "class_id", "set_id", "n_links")


def distinct(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, target: float = TARGET) -> DataFrame:
    """``docs`` with the documents whose doc_id is the least of their class, in the same columns.

    Rows that repeat a doc_id are kept or dropped together; rows of a null
    doc_id stay. Null and empty texts, and texts without words that no other
    row repeats, stay; ties go to the smaller doc_id; an empty table gives no
    rows; columns of any name are kept.
    """
    gone = join(docs, threshold, n, target).where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct("*").alias("_row"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
