"""Toxicity: a lexicon trie walked with Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learned from labelled rows: words that the toxic ones have and
the others lack. Every token of a document within one edit of a term counts as
a misspelling of it, unless clean rows know the token as a word of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import opened, settle, shared, words_of

#: Labelled rows that lexicon and weights are learned from.
TRAIN_ROWS = 20_000
#: A hit inside quotation counts so much.
QUOTED = 0.25
#: Code points from which a term tolerates an edit.
FUZZY_LENGTH = 4
#: Log odds from which a word is telling.
TELLING = 2.5
_WINDOW = 6
_SPLIT = bytes(0x20 if c < 0x21 or c == 0x7F or chr(c) in '.,;:!?()[]{}"|/<>=' else c for c in range(256))
_EDGE = b"*@$#&%'-_+~^`\\"
_TOKEN = re.compile("[^\\x00-\\x20\\x7F.,;:!?()\\[\\]{}\"|/<>=]+")
_CLEAN = re.compile("^[*@$#&%'\\-_+~^`\\\\“”„«»‘’]+|[*@$#&%'\\-_+~^`\\\\“”„«»‘’]+$")
#: Words that report what somebody else said.
REPORTING = frozenset("said says called quoted quote wrote term word slur insult dit appelle cite mot sagte nannte zitat wort dijo llama cita palabra".split())
_OPEN_CLOSE = (("“", "”"), ("«", "»"), ("„", "“"), ("„", "”"))
#: Tokens that a worker remembers at most, and only while its task runs.
_CACHE = 200_000


def tokens_of(text: str) -> list[bytes]:
    """Lower-cased tokens; signs inside a token stay, those at its edges go."""
    return [w for t in text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split() if (w := t.strip(_EDGE))]


class Lexicon:
    """Terms in a trie, matched exactly or within one edit."""

    def __init__(self, terms: dict[str, float], tolerant: set[str], barred: frozenset[bytes] = frozenset()) -> None:
        self.terms, self.tolerant, self.trie = terms, tolerant, {}
        self.barred = barred  # tokens that are no misspellings
        self.heads: set[bytes] = set()
        self.tails: set[bytes] = set()
        self.cuts: set[tuple[int, int]] = set()
        for term in tolerant:
            node = self.trie
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = term
            half = len(term) // 2
            head, tail = term[:half].encode(), term[half:].encode()
            self.heads.add(head)
            self.tails.add(tail)
        self.head_sizes, self.tail_sizes = sorted({len(h) for h in self.heads}), sorted({len(t) for t in self.tails})
        self.exact = {t.encode("utf-8", "surrogatepass"): t for t in terms}
        self.sizes = {n + d for n in map(len, tolerant) for d in (-1, 0, 1)}
        self.plain: set[bytes] = set()  # tokens known not to match
        self.known: dict[bytes, list[tuple[str, int]]] = {}

    def near(self, token: str) -> list[tuple[str, int]]:
        """Terms within one edit: the token's Levenshtein automaton runs down the trie, dead states cut branches."""
        found, width = [], len(token)
        stack = [(self.trie, tuple(range(width + 1)))]
        while stack:
            node, row = stack.pop()
            for ch, below in node.items():
                if ch == "":
                    if row[-1] <= 1:
                        found.append((below, row[-1]))
                    continue
                now = [row[0] + 1]
                for j in range(width):
                    now.append(min(now[j] + 1, row[j + 1] + 1, row[j] + (token[j] != ch)))
                if min(now) <= 1:
                    stack.append((below, tuple(now)))
        return sorted(found)

    def forget(self) -> None:
        """Give back what the tokens read so far take; workers outlive their tasks."""
        self.plain, self.known = set(), {}

    def match(self, token: bytes) -> list[tuple[str, int]]:
        """(term, edits) of a token; an exact term matches only itself."""
        if token in self.plain:
            return []
        hit = self.known.get(token)
        if hit is not None:
            return hit
        hit = []
        if token in self.exact:
            hit = [(self.exact[token], 0)]
        # One edit leaves the first or the second half of a term as it was.
        elif token not in self.barred and (any(token[:n] in self.heads for n in self.head_sizes) or any(token[-n:] in self.tails for n in self.tail_sizes)):
            word = token.decode("utf-8", "replace")
            if len(word) in self.sizes:
                hit = self.near(word)
        if hit:
            if len(self.known) > _CACHE:
                self.known.clear()
            self.known[token] = hit
        else:
            if len(self.plain) > _CACHE:
                self.plain.clear()
            self.plain.add(token)
        return hit

    def quoted(self, text: str, start: int, end: int) -> bool:
        """Whether the words around say that somebody else is quoted: quotation marks of the line, or a reporting word near by."""
        left, right = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        before, after = text[max(left, start - 400) : start], text[end : min(len(text) if right < 0 else right, end + 400)]
        if before.count('"') % 2 and '"' in after:
            return True
        for a, b in _OPEN_CLOSE:
            if before.rfind(a) > before.rfind(b) and b in after:
                return True
        around = re.findall(r"\w+", before.lower())[-_WINDOW:] + re.findall(r"\w+", after.lower())[:2]
        return any(w in REPORTING for w in around)

    def evidence(self, text: str | None) -> tuple[float, float, float, list[tuple[str, int, int, int, bool]]]:
        """Context-weighted log odds of distinct exact terms, of misspelt ones, log hits, and the hits (term, edits, start, end, quoted)."""
        if not text:
            return 0.0, 0.0, 0.0, []
        new = set(tokens_of(text)).difference(self.plain)
        if not any(self.match(t) for t in new):
            return 0.0, 0.0, 0.0, []
        hits, exact, fuzzy, total = [], {}, {}, 0.0
        low = text.lower()
        same = len(low) == len(text)
        for m in _TOKEN.finditer(low):
            word = _CLEAN.sub("", m[0])
            for term, edits in self.match(word.encode("utf-8", "surrogatepass")):
                weight = QUOTED if (quoted := self.quoted(text if same else low, *m.span())) else 1.0
                into = fuzzy if edits else exact
                into[term] = max(into.get(term, 0.0), weight * self.terms[term])
                total += weight
                hits.append((term, edits, *m.span(), quoted))
        return sum(exact.values()), sum(v for t, v in fuzzy.items() if t not in exact), math.log1p(total), hits


def _sketch(words: list[bytes]) -> list[int]:
    """Four minima over hashes of word 5-grams: texts that share one are taken as copies of each other."""
    grams = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    import xxhash

    return [min(xxhash.xxh3_64_intdigest(g, seed=s) for g in grams) >> 1 for s in range(4)]


_LEARNING = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("toxic", pa.int32()), ("sketch", pa.list_(pa.int64()))])


def _learning_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_sketch(words_of(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], schema=_LEARNING)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by[label].update(set(tokens_of(text)))
        words = sorted(set(by[0]) | set(by[1]))
        yield pa.RecordBatch.from_pydict({"word": [w.decode("utf-8", "replace") for w in words], "clean": [by[0][w] for w in words], "toxic": [by[1][w] for w in words]}, schema=pa.schema([("word", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))


def _features(lexicon) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(lexicon)
        for batch in batches:
            out = {k: [] for k in ("toxic", "exact", "fuzzy", "hits")}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                exact, fuzzy, total, _ = known.evidence(text)
                for k, v in (("toxic", label), ("exact", exact), ("fuzzy", fuzzy), ("hits", total)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("toxic", pa.int32()), ("exact", pa.float64()), ("fuzzy", pa.float64()), ("hits", pa.float64())]))
        known.forget()

    return run


def _neighbours(lexicon) -> callable:
    """Of words with their counts, those that would count as misspellings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(lexicon)
        for batch in batches:
            words = [_CLEAN.sub("", w) for w in batch.column(0).to_pylist()]
            near = pa.array([any(edits for _, edits in known.match(w.encode("utf-8", "surrogatepass"))) for w in words], pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *batch.columns[1:]], names=["word", "clean", "toxic"]).filter(near)
        known.forget()

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Weights (bias last) by Newton's method; the bias is not penalised, weights stay at or above 0."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Lexicon and weights of the score."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray) -> None:
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str | None) -> float:
        exact, fuzzy, total, _ = self.lexicon.evidence(text)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.weights, (exact, fuzzy, total, 1.0))))))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from the labelled rows (``labels.toxic`` 0 or 1; of contradicting labels the larger counts).

    At most ``rows`` of them are used, picked by a hash of doc_id; of texts
    that share a five-word sketch only the first is, so that copies don't make
    their own words telling. Null texts, labels without a row and null labels
    teach nothing; ties go to the smaller doc_id; columns of other names are
    ignored; without rows of both labels every text gets one score.
    """
    spark = docs.sparkSession
    label = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = label.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic")), "doc_id").limit(rows)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    # The one read of the documents; everything below reads these few rows.
    train = settle(labelled.select("doc_id", "text", "toxic").mapInArrow(_learning_rows, "doc_id long, text string, toxic int, sketch array<long>"))
    held = sorted((r["doc_id"], tuple(r["sketch"])) for r in train.select("doc_id", "sketch").collect())
    seen: set[tuple[int, int]] = set()
    first = []
    for doc_id, sketch in held:
        own = set(enumerate(sketch))
        if not own & seen:
            first.append((doc_id,))
        seen |= own
    train = train.join(F.broadcast(spark.createDataFrame(first, "doc_id long")), "doc_id").select("text", "toxic")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model(Lexicon({}, set()), np.array([0.0, 0.0, 0.0, 4.0 if n1 else -4.0]))
    words = settle(train.mapInArrow(_counts, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    sure = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = words.where("toxic >= 5").withColumn("odds", odds).withColumn("sure", sure).where((F.col("sure") >= 3.1) & (F.col("odds") >= TELLING)).collect()  # words of at most TRAIN_ROWS rows
    terms = {r["word"]: r["odds"] for r in found}
    tolerant = {t for t in terms if len(t) >= FUZZY_LENGTH}
    # Words one edit from a term that clean rows hold, unless the toxic ones hold them so much more often.
    near = words.mapInArrow(_neighbours(shared(spark, Lexicon(terms, tolerant))), "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    barred = near.where((F.col("clean") > 0) & (odds < TELLING)).select("word").collect()
    lexicon = Lexicon(terms, tolerant, frozenset(r["word"].encode("utf-8", "surrogatepass") for r in barred))
    rows_ = train.mapInArrow(_features(shared(spark, lexicon)), "toxic int, exact double, fuzzy double, hits double").collect()
    x = np.array([(r["exact"], r["fuzzy"], r["hits"]) for r in rows_])
    y = np.array([float(r["toxic"]) for r in rows_])
    weights = logistic(x, y)
    # Misspellings are rare in training: an edit costs a third of a term's weight unless they prove to tell more.
    weights[1] = max(weights[1], weights[0] * 2 / 3)
    return Model(lexicon, weights)


def _scores(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(model)
        for batch in batches:
            scores = [known.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())})
        known.lexicon.forget()

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: doc_id, score, predicted.

    Only the whole text counts. Null and empty texts get the score of a text
    without hits; equal texts get equal scores; other columns are ignored; an
    empty table gives no rows.
    """
    held = shared(docs.sparkSession, model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scores(held), "doc_id long, score double, predicted int")


def _kept(model, at: int, names: list[str]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array([known.score(t.as_py()) < 0.5 for t in batch.column(at)], pa.bool_()))
        known.lexicon.forget()

    return run


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more, in the same columns.

    Each row is judged by its whole text, so repeated rows stay or go together;
    null and empty texts score as a text without hits; an empty table gives no
    rows; columns of any name are kept.
    """
    held = shared(docs.sparkSession, model)
    return docs.mapInArrow(_kept(held, docs.columns.index("text"), docs.columns), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0
