"""Dedup of repeated 100-byte strings by merging Burrows-Wheeler transforms of shards.

The suffixes that can matter are dealt out by content: each 100-byte window has
a minimizer, equal windows have equal ones, and only windows whose minimizer
occurs again go on, in pieces of neighbouring windows. Equal pieces are folded.
What is left of a part is cut into shards; the transform of each is built by
itself, and the transforms are merged by iterative interleave refinement: a
pass deals the interleave out by the symbols in front of the suffixes, so that
after h passes it is sorted by h symbols, and suffixes that part in a pass give
their common prefix; those that have parted from both neighbours are dealt out
no more. No suffixes are sorted again. Runs of suffixes with a
common prefix of 100 bytes are the repeated windows; all but the first place of
each run is removed. Symbols are 4 exact bytes in their order, so 25 passes do
and nothing rests on hashes being different.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

LENGTH, SYMBOL, GRAM = 100, 4, 24
#: Pieces of a merge part.
PIECES_A_PART = 12_000
#: A minimizer with more pieces is split by a second one.
HOT = 20_000
#: Pieces that a task remembers, so that copies leave it decided.
SEEN = 100_000
#: Bytes of a shard, and about those of one merge (more only where one key has more distinct pieces).
SHARD_BYTES, MERGE_BYTES = 1 << 18, 1 << 22
_TABLE = np.random.default_rng(3).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_C = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_C), n, 1 << 64))


def _grams(b: np.ndarray) -> np.ndarray:
    """Hashes of all 24-byte strings, by doubling."""
    h, held = _TABLE[b], {}
    for step in (1, 2, 4, 8):
        h = h[:-step] * _power(step) + h[step:]
        held[2 * step] = h
    return held[16][: len(b) - GRAM + 1] * _power(8) + held[8][16:]


def _slid(h: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        h = of(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return of(h[:-rest], h[rest:]) if rest else h


def _mixed(b: np.ndarray, mix: int) -> np.ndarray:
    h = _grams(b) * _MIX[mix]
    h ^= h >> np.uint64(31)
    h *= _MIX[0]
    return h


def minimizers(b: np.ndarray, mix: int = 0) -> np.ndarray:
    """For each 100-byte window its least mixed 24-gram hash."""
    return _slid(_mixed(b, mix), LENGTH - GRAM + 1, np.minimum) if len(b) >= LENGTH else np.zeros(0, np.uint64)


def occurrences(b: np.ndarray) -> np.ndarray:
    """The hash at each place that is the least of some window."""
    if len(b) < LENGTH:
        return np.zeros(0, np.uint64)
    h, width = _mixed(b, 0), LENGTH - GRAM + 1
    m = _slid(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return h[_slid(np.concatenate((edge, m, edge)), width, np.maximum) == h]


def _runs(m: np.ndarray) -> np.ndarray:
    """Starts of the runs of one value."""
    return np.concatenate(([0], np.flatnonzero(m[1:] != m[:-1]) + 1)) if len(m) else np.zeros(0, np.int64)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass") if text else b"", np.uint8)


_PIECE = pa.schema([("m", pa.int64()), ("tie", pa.int64())])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            ms, ties = [], []
            for tie, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = occurrences(_bytes(text.as_py()))
                ms.append(m.view(np.int64))
                ties.append(np.full(len(m), tie, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ms, ties)], schema=_PIECE)


_CUT = "bucket int, key long, doc_id long, tie long, start int, len int, piece binary"
_CUT_SCHEMA = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("piece", pa.binary())])


def _cut(buckets: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                if len(seen) > SEEN:
                    seen.clear()
                yield one(whole.slice(at, 1000), seen)

    def one(batch: pa.RecordBatch, seen: dict) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for doc_id, tie, text, marks in sorted(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True), key=lambda r: r[:2]):
            b = _bytes(text)
            data = b.tobytes()
            m = minimizers(b)
            begins = _runs(m)
            ends = np.append(begins[1:], len(m))
            second = None
            held = {x["m"]: x["hot"] for x in marks}
            values = m[begins].view(np.int64)
            own = np.flatnonzero(np.isin(values, np.fromiter(held, np.int64, len(held))))
            for k in own.tolist():
                start, value = int(begins[k]), int(values[k])
                parts = [(start, int(ends[k]), value)]
                if held[value]:
                    if second is None:
                        second = minimizers(b, 1)
                    cuts = (_runs(second[start : ends[k]]) + start).tolist()
                    parts = [(a, z, value ^ int(second[a : a + 1].view(np.int64)[0])) for a, z in zip(cuts, [*cuts[1:], int(ends[k])], strict=True)]
                for a, z, key in parts:
                    piece, place = data[a : z - 1 + LENGTH], (doc_id, tie, a)
                    first = seen.get(piece)
                    again = first is not None and first < place
                    if not again:
                        seen[piece] = place
                    # A piece that this task met at an earlier place is decided, so it may go anywhere.
                    bucket = (tie if again else key ^ (key >> 33)) % buckets
                    for column, v in zip(out, (bucket, key, doc_id, tie, a, z - a, None if again else piece), strict=True):
                        column.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _CUT_SCHEMA, strict=True)], schema=_CUT_SCHEMA)

    return run


class Transform:
    """The Burrows-Wheeler transform of a shard: its suffixes in order, and the symbol in front of each.

    A symbol is ``SYMBOL`` bytes, numbered in the order of the part's alphabet;
    0 stands in front of the first suffixes of a piece. A suffix is the row of
    its symbols, ended by a sign below all of them, and is ordered by its first
    ``length`` bytes; equal ones keep the order of their places.
    """

    def __init__(self, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray, first: int, length: int) -> None:
        n = len(symbols)
        local = np.arange(n, dtype=np.int32) - np.repeat(begins, sizes).astype(np.int32)
        rest = np.repeat(sizes, sizes).astype(np.int32) - 1 - local
        # Ranks are places in the order, counted from 1; 0 is beyond the piece. Suffixes that are alone in their rank are done.
        rank, known = symbols.astype(np.int64), SYMBOL
        order = np.empty(n, np.int64)
        open_, places = np.arange(n), np.arange(n)
        while True:
            step = min(known, length - known)
            inside = (rest.take(open_) >= step) & (step > 0)
            after = rank.take(np.minimum(open_ + step, n - 1)) * inside
            by, parted = _paired(rank.take(open_), after)
            open_ = open_.take(by)
            order[places] = open_
            if known == SYMBOL:
                rank = np.empty(n, np.int64)
            rank[open_] = np.maximum.accumulate((places + 1) * parted)
            known += step
            many = ~(parted & np.append(parted[1:], True))
            open_, places = open_.compress(many), places.compress(many)
            if known >= length or not len(open_):
                break
        self.places = (order + first).astype(np.int32)
        front = np.zeros(n, symbols.dtype)
        front[SYMBOL:] = symbols[: max(0, n - SYMBOL)]
        front[local < SYMBOL] = 0
        self.front = front[order]


def _paired(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order of the pairs, whether each differs from the one before). Where pair and place fit a word, words are sorted: that is several times faster."""
    n = len(first)
    bits = int(max(first.max(), second.max())).bit_length()
    low = n.bit_length()
    if 2 * bits + low < 64:
        word = (((first.astype(np.int64) << bits) | second) << low) | np.arange(n)
        word.sort()
        order, pair = word & ((1 << low) - 1), word >> low
    else:
        pair = (first.astype(np.int64) << 32) | second
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
    return order, np.concatenate(([True], pair[1:] != pair[:-1]))


def _stable(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of small integers, 16 bits at a time."""
    if most < 1 << 16:
        return np.argsort(keys.astype(np.uint16), kind="stable")
    low = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((keys[low] >> 16).astype(np.uint16), kind="stable")]


def interleave(shards: list[Transform], alphabet: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Merge the transforms: (places in the merged order, common prefix of each with the one before, ``length`` at most).

    The interleave, which says what suffix comes next, starts as one shard
    after the other. A pass deals it out by the symbols in front: sorted by h
    symbols it becomes sorted by h + 1, and suffixes that part for the first
    time share h symbols. No suffix is compared with another. One that has
    parted from both neighbours has its place, so a pass deals out only what
    leads to the others.
    """
    # What each suffix is led to from by which symbol in front; suffixes are numbered shard by shard in their order there.
    orders = [_stable(t.front, alphabet) for t in shards]
    begins = np.cumsum([0, *(len(o) for o in orders)])
    follows = np.concatenate([(o + b).astype(np.int32) for o, b in zip(orders, begins, strict=False)])
    symbol = np.concatenate([t.front.take(o) for t, o in zip(shards, orders, strict=True)])
    n = len(follows)
    merged = np.empty(n, np.int32)
    common = np.full(n, length, np.int32)
    common[0] = 0
    block = np.zeros(n, np.int32)  # of each suffix: where those begin that share h symbols with it
    suffix = places = np.arange(n, dtype=np.int32)
    for h in range(length // SYMBOL):
        by, parted = _paired(symbol, block.take(follows))
        suffix, follows, symbol = suffix.take(by), follows.take(by), symbol.take(by)
        parted |= symbol == 0
        merged[places] = suffix
        block[suffix] = np.maximum.accumulate(places * parted)
        new = places.compress(parted)
        common[new.compress(common.take(new) == length)] = h * SYMBOL
        many = ~(parted & np.append(parted[1:], True))
        suffix, follows, symbol, places = (c.compress(many) for c in (suffix, follows, symbol, places))
        if not len(places):
            break
    return np.concatenate([t.places for t in shards])[merged], common


def merge(pieces: list[bytes], length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Whether each window of ``length`` bytes of the concatenated pieces occurs in an earlier place, as a mask over positions.

    ``pieces`` stand in the order of their places and have ``SYMBOL`` bytes or
    more; ``length`` is a multiple of ``SYMBOL``. Windows don't cross pieces.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    again = np.zeros(int(sizes.sum()), bool)
    if not len(again):
        return again
    # One more suffix a piece, the empty one, so that every suffix but a piece's first ones has a symbol in front.
    cat = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    held, begins = sizes + 1, np.cumsum(sizes + 1) - sizes - 1
    word = np.zeros(len(cat), np.uint32)
    for k in range(SYMBOL):
        word[: len(cat) - k] |= cat[k:].astype(np.uint32) << np.uint32(8 * (SYMBOL - 1 - k))
    rest = np.repeat(begins + sizes, held) - np.arange(len(cat))
    order, parted = _paired(word, np.zeros(1, np.int64))
    symbols = np.empty(len(cat), np.int32)
    symbols[order] = numbers = np.cumsum(parted, dtype=np.int32)
    alphabet = int(numbers[-1])
    symbols[rest < SYMBOL] = 0
    shards, first = [], 0
    while first < len(pieces):
        last = max(first + 1, int(np.searchsorted(begins, begins[first] + shard_bytes)))
        a, z = int(begins[first]), int(begins[last]) if last < len(pieces) else len(cat)
        shards.append(Transform(symbols[a:z], begins[first:last] - a, held[first:last], a, length))
        first = last
    places, common = interleave(shards, alphabet + 1, length)
    # Suffixes that share ``length`` bytes stand together; all but the first place of each run came before.
    runs = np.flatnonzero(common < length)
    leader = np.repeat(np.minimum.reduceat(places, runs), np.diff(np.append(runs, len(places))))
    late = places[places != leader]
    again[late - np.searchsorted(begins, late, side="right") + 1] = True
    return again


def _alone(piece: bytes) -> bool:
    """Whether no window occurs twice within a piece: what all its windows hold would occur again."""
    n = len(piece) - LENGTH + 1
    return n <= LENGTH - GRAM + 1 and piece.find(piece[n - 1 : LENGTH], n) < 0


_SPAN = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])


def _repeats(table: pa.Table) -> pa.Table:
    keys, docs, ties, starts, lens = (table[c].to_numpy() for c in ("key", "doc_id", "tie", "start", "len"))
    ends = starts + lens - 1 + LENGTH
    whole = table["piece"].is_null().to_numpy(zero_copy_only=False)
    order = np.flatnonzero(~whole)
    order = order[np.lexsort((starts[order], ties[order], docs[order]))]
    column = table["piece"].combine_chunks()
    pieces: list[bytes] = []
    owners: list[int] = []
    firsts: dict[bytes, int] = {}
    for i in order.tolist():
        piece = column[i].as_py()
        j = firsts.setdefault(piece, i)
        if j == i:
            pieces.append(piece)
            owners.append(i)
        elif (docs[i], ties[i], starts[i]) != (docs[j], ties[j], starts[j]):  # rows that repeat a document are one
            whole[i] = True
    known = [(np.flatnonzero(whole), starts[whole], ends[whole])]
    # Windows of different keys differ, so a piece alone under its key repeats nothing unless within itself.
    own, counts = np.unique(keys[owners], return_counts=True) if owners else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    many = np.isin(keys[owners], own[counts > 1])
    left = [k for k in range(len(pieces)) if many[k] or not _alone(pieces[k])]
    left.sort(key=lambda k: keys[owners[k]])  # stable: places stay in order under one key
    for part in _parts(left, keys[owners], [len(p) for p in pieces]):
        again = merge([pieces[k] for k in part])
        sizes = np.array([len(pieces[k]) for k in part], np.int64)
        begin = np.cumsum(sizes) - sizes
        edge = np.diff(np.concatenate(([0], again.view(np.int8), [0])))  # windows end before their piece does, so runs don't join
        a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.searchsorted(begin, a, side="right") - 1
        row = np.array(owners, np.int64)[np.array(part, np.int64)[at]]
        shift = starts[row] - begin[at]
        known.append((row, a + shift, z - 1 + LENGTH + shift))
    rows, a, z = (np.concatenate([k[i] for k in known]).astype(np.int64) for i in range(3))
    return pa.table([docs[rows], ties[rows], a.astype(np.int32), z.astype(np.int32)], schema=_SPAN)


def _parts(left: list[int], keys: np.ndarray, sizes: list[int]) -> Iterator[list[int]]:
    """Runs of ``left`` (sorted by key) of about ``MERGE_BYTES``, keys kept whole."""
    part, held = [], 0
    for k in left:
        if part and held > MERGE_BYTES and keys[k] != keys[part[-1]]:
            yield part
            part, held = [], 0
        part.append(k)
        held += sizes[k]
    if part:
        yield part


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _finish(texts: bool) -> callable:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = _bytes(text.as_py()).tobytes()
                joined: list[list[int]] = []
                for a, z in sorted((x["from"], x["to"]) for x in spans.as_py() or ()):
                    z = min(z, len(data))
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], z)
                    elif a < z:
                        joined.append([a, z])
                edges = [0, *(x for s in joined for x in s), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                for column, v in zip(out, (doc_id, len(data), len(data) - len(kept), len(joined), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte goes if a 100-byte string of its document that covers it also starts
    earlier: in a document of a smaller doc_id, or before in the same one.
    Strings are judged on the input. ``kept`` is the rest as text (bytes of cut
    characters left out), null unless ``texts``. Null and empty texts, and those
    of fewer than 100 bytes, lose nothing. Rows that repeat a doc_id with the
    same text are one document; with different texts they are documents of
    their own, ordered by a hash of the text. Rows of a null doc_id lose nothing
    and don't count as earlier. An empty table gives no rows; other columns are
    ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("tie"))
    known = docs.where("doc_id is not null and octet_length(text) >= 100")
    places = known.select("tie", "text").mapInArrow(_places, "m long, tie long")
    again = settle(places.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m", "n", (F.col("n") > HOT).alias("hot")), release=True)
    total = again.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // PIECES_A_PART))
    # What repeats in a row, by the row's hash; of rows that share a hash each gets the marks of all, which only cuts more.
    marks = places.join(again.select("m", "hot"), "m").groupBy(F.col("tie").alias("_tie")).agg(F.collect_set(F.struct("m", "hot")).alias("marks"))
    marked = known.join(marks, F.col("tie") == F.col("_tie")).select("doc_id", "tie", "text", "marks")
    spans = marked.mapInArrow(_cut(buckets), _CUT).groupBy("bucket").applyInArrow(_repeats, "doc_id long, tie long, from int, to int")
    spans = settle(spans.groupBy(F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie")).agg(F.collect_list(F.struct("from", "to")).alias("spans")), release=True)
    whole = docs.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(_finish(texts), _RESULT)
