"""Benchmark decontamination by a generalised suffix automaton of test items.

The automaton reads every document's words as a stream and keeps the longest
suffix that occurs in some item. Where that length reaches the window, the
words of the match are hit; the automaton's state tells which items hold the
window that ends there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened, settle, shared, words_of

#: Item words that one automaton (and so one broadcast) holds; more items are read in several blocks.
BLOCK_WORDS = 500_000
#: Slots of the word-pair filter.
_PAIR_BITS = 20
_A, _B = 2654435761, 40503

_LOWER_TEXT = {c: c + 32 for c in range(0x41, 0x5B)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Generalised suffix automaton over item words, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 8) -> None:
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.at: dict[int, set[str]] = {}  # state of a full window -> items
        self.short: dict[int, dict[int, set[str]]] = {}  # length of a short item -> its state -> items
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        for i, ws in coded:
            state = n = 0
            for w in ws:
                state, n = self.step(state, n, w)
                if n >= window:
                    self.at.setdefault(self.ancestor(state, window), set()).add(i)
            if len(ws) < window:
                self.short.setdefault(len(ws), {}).setdefault(self.ancestor(state, len(ws)), set()).add(i)
        self.least = min([window, *self.short]) if coded else 0
        pairs = np.array([(a, b) for _, ws in coded for a, b in zip(ws, ws[1:], strict=False)], np.int64).reshape(-1, 2)
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        self.pairs[self._slot(pairs[:, 0], pairs[:, 1])] = True

    @staticmethod
    def _slot(a, b):
        return (a * _A + b * _B + (a >> 7)) & ((1 << _PAIR_BITS) - 1)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w], p = clone, self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another item already has it
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        cur, p = self._new(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w], p = cur, self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return cur

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """The state and matching length after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        to = self.next[state].get(w)
        return (0, 0) if to is None else (to, n + 1)

    def ancestor(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of the match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Maximal hit spans (first, last word), items with an occurring window, longest match."""
        spans: list[list[int]] = []
        items: set[str] = set()
        longest, n_words = 0, len(words)
        if n_words < self.least or not self.least:
            return [], items, 0
        ids = np.fromiter((self.vocab.get(w, -1) for w in words), np.int64, n_words)
        # A window of m words is m - 1 consecutive known pairs; the automaton need only read such runs.
        known = ids >= 0
        joined = known[1:] & known[:-1]
        joined &= self.pairs[self._slot(ids[:-1], ids[1:])]
        edge = np.diff(np.concatenate(([0], joined.view(np.int8), [0])))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if self.least == 1:  # single words are windows too
            alone = known.copy()
            alone[:-1] &= ~joined
            alone[1:] &= ~joined
            one = np.flatnonzero(alone)
            begins, ends = np.concatenate((begins, one)), np.concatenate((ends, one))
            order = np.argsort(begins, kind="stable")
            begins, ends = begins[order], ends[order]
        keep = ends - begins + 1 >= self.least
        for first, last in zip(begins[keep].tolist(), ends[keep].tolist(), strict=True):
            state = n = 0
            for at, w in enumerate(ids[first : last + 1].tolist(), first):
                state, n = self.step(state, n, w)
                hit = 0
                if n >= self.window:
                    hit = n
                    items |= self.at[self.ancestor(state, self.window)]
                for size, by in self.short.items():
                    if n >= size and (who := by.get(self.ancestor(state, size))):
                        items |= who
                        hit = max(hit, size)
                if hit:
                    longest = max(longest, hit)
                    start = at - hit + 1
                    while spans and spans[-1][1] >= start - 1:
                        start = min(start, spans.pop()[0])
                    spans.append([start, at])
        return [tuple(s) for s in spans], items, longest


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_FOUND = (("_n_words", pa.int64()), ("_longest", pa.int32()), ("_spans", _SPANS), ("_items", pa.list_(pa.string())))
_FOUND_DDL = "_row {row}, _text string, _n_words long, _longest int, _spans array<struct<first:int,last:int>>, _items array<string>"


def union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the words in either list of spans."""
    out: list[list[int]] = []
    for first, last in sorted([*a, *b]):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(s) for s in out]


def _found(automaton) -> callable:
    """Adds the matches of one block of items to those that a row already carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(automaton)
        for batch in batches:
            before = [batch.column(i).to_pylist() for i in range(2, 6)] if batch.num_columns > 2 else None
            out: tuple[list, ...] = ([], [], [], [])
            for row, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                spans, items, longest = known.matches(words)
                if before:
                    spans = union(spans, [(s["first"], s["last"]) for s in before[2][row]])
                    items, longest = items.union(before[3][row]), max(longest, before[1][row])
                for column, v in zip(out, (len(words), longest, [{"first": a, "last": b} for a, b in spans], sorted(items)), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, (_, t) in zip(out, _FOUND, strict=True))], names=["_row", "_text", *(n for n, _ in _FOUND)])

    return run


def _matched(rows: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """``rows`` (_row, _text) with _n_words, _longest, _spans and _items over all items.

    Each block of items is one pass over the rows, which carry what the blocks
    before have found; between blocks the rows are written, so that no worker
    holds two automata. Rows stay rows whatever their ids.
    """
    spark = rows.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (block_words * 4)))  # a word and its gap take two bytes or more, here four on average
    schema = _FOUND_DDL.format(row=rows.schema["_row"].dataType.simpleString())
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        held = [(r["item_id"], words_of(r["text"])) for r in part.collect()]
        automaton = shared(spark, SuffixAutomaton(sorted(held), window))
        rows = rows.mapInArrow(_found(automaton), schema)
        rows = settle(rows) if k + 1 < blocks else rows
    return rows


def match_items(docs: DataFrame, benchmark: DataFrame, window: int = 8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row: doc_id, n_words, longest, spans, items.

    ``spans`` are the maximal runs of hit words (first and last, 0-based),
    ``items`` the sorted item_ids with an occurring window, ``longest`` the
    longest match in words. A document or item without words (null, empty,
    punctuation only) matches nothing; repeated item rows count once; repeated
    documents, and rows of a null doc_id, each get a row; with no items no word
    is hit; further columns of either table are ignored; an empty table gives
    no rows. Items of more than ``block_words`` words in all are read block by
    block with the same result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_row"), F.col("text").alias("_text"))
    found = _matched(rows, benchmark, window, block_words)
    return found.select(F.col("_row").alias("doc_id"), *(F.col(n).alias(n[1:]) for n, _ in _FOUND))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2) -> DataFrame:
    """The digest of :func:`match_items`: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return match_items(docs, benchmark, window).select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"))


def _cut(drop_words: int, drop_share: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep, chars = [], [], []
            for text, n_words, longest, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                hit = sum(s["last"] - s["first"] + 1 for s in spans)
                keep.append(not spans or (longest < drop_words and hit < drop_share * n_words))
                if spans and keep[-1]:
                    bounds = [m.span() for m in _WORD.finditer(text.translate(_LOWER_TEXT))]
                    for s in reversed(spans):
                        text = text[: bounds[s["first"]][0]] + text[bounds[s["last"]][1] :]
                texts.append(text)
                chars.append(len(text) if spans and keep[-1] else None)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(chars, pa.int64())], names=["_row", "_text", "_cut"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 8, drop_words: int = 13, drop_share: float = 0.2, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without benchmark text, in the same columns.

    A document goes when a match reaches ``drop_words`` words or the hit words
    of all items reach ``drop_share`` of it; from the others shorter hit spans
    are cut out (``n_chars``, where present, follows the text). Documents
    without a hit stay as they are, also those with null or empty text; each
    row is judged by itself, so repeated rows stay or go together and ids may
    repeat or be null; an empty table gives no rows, and no items cut nothing.
    Every block of items has read a document before it is judged.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("_none")]
    rows = docs.select(F.struct(*others).alias("_row"), F.col("text").alias("_text"))
    out = _matched(rows, benchmark, window, block_words).mapInArrow(_cut(drop_words, drop_share), f"_row {rows.schema['_row'].dataType.simpleString()}, _text string, _cut long")
    changed = {"text": F.col("_text"), "n_chars": F.coalesce(F.col("_cut"), F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    fields = [(changed[f.name] if changed.get(f.name) is not None else F.col(f"_row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema.fields]
    return out.select(*fields)
