"""Language identification in two steps: family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import opened, shared

#: Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "indic": "hi bn ur mr gu pa ne si".split(),
    "turkic": "tr az kk uz tk ky tt".split(),
    "semitic": "ar he mt am".split(),
    "uralic": "fi et hu".split(),
    "sinitic": "zh yue wuu".split(),
}
#: Labelled rows that the classifiers are fitted on, over all languages together.
TRAIN_ROWS = 2400
#: Hashed byte pairs and triples, as powers of two.
_PAIR_BITS, _TRIPLE_BITS = 11, 13
_PAIRS, _TRIPLES = 1 << _PAIR_BITS, 1 << _TRIPLE_BITS
WIDTH = _PAIRS + _TRIPLES
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")
UNDEFINED = "und"


def family_of(lang: str) -> str:
    return next((f for f, own in FAMILIES.items() if lang.lower().split("-")[0] in own), f"={lang}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples of the whole lower-cased text, at length 1."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    pair = b[:-1] * np.uint32(256) + b[1:]
    out = np.empty(WIDTH)
    out[:_PAIRS] = np.bincount((pair * np.uint32(2654435761)) >> np.uint32(32 - _PAIR_BITS), minlength=_PAIRS)
    triple = pair[:-1] * np.uint32(256) + b[2:]
    out[_PAIRS:] = np.bincount((triple * np.uint32(2654435761)) >> np.uint32(32 - _TRIPLE_BITS), minlength=_TRIPLES)
    out[(32 * 256 + 32) * 2654435761 % (1 << 32) >> 32 - _PAIR_BITS] = 0  # runs of blanks
    out[_PAIRS + ((32 * 65536 + 32 * 256 + 32) * 2654435761 % (1 << 32) >> 32 - _TRIPLE_BITS)] = 0
    np.sqrt(out, out)
    norm = np.sqrt(out @ out)
    return (out / norm if norm else out).astype(np.float32)


#: A training row: places and values of the features that are not 0.
Sparse = tuple[np.ndarray, np.ndarray]


def linear_svm(x: list[Sparse], y: np.ndarray, c: float = 10.0, epochs: int = 30) -> np.ndarray:
    """Dual coordinate descent for the squared hinge loss; the last weight is the bias. ``y`` is -1 or 1."""
    w, a = np.zeros(WIDTH + 1), np.zeros(len(x))
    cost = c * len(y) / (2 * np.maximum(1, np.where(y > 0, (y > 0).sum(), (y < 0).sum())))
    diagonal = 1 / (2 * cost)
    q = np.array([float(v @ v) + 1 for _, v in x]) + diagonal
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            at, value = x[i]
            g = y[i] * (value @ w[at] + w[-1]) - 1 + diagonal[i] * a[i]
            to = max(0.0, a[i] - g / q[i])
            if to != a[i]:
                w[at] += (to - a[i]) * y[i] * value
                w[-1] += (to - a[i]) * y[i]
                moved = max(moved, abs(to - a[i]))
                a[i] = to
        if moved < 1e-4:
            break
    return w


class Votes:
    """One-versus-one linear SVMs over some classes."""

    def __init__(self, x: list[Sparse], labels: list[str]) -> None:
        self.classes = sorted(set(labels))
        at = np.array([self.classes.index(v) for v in labels])
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.w = np.zeros((WIDTH + 1, len(self.pairs)), np.float32)
        for k, (a, b) in enumerate(self.pairs):
            own = np.flatnonzero((at == a) | (at == b))
            self.w[:, k] = linear_svm([x[i] for i in own], np.where(at[own] == a, 1.0, -1.0))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The winning class of each row and its mean support, 0 to 1."""
        if len(self.classes) == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.w[:-1] + self.w[-1]
        support = 1 / (1 + np.exp(-4 * np.clip(margin.astype(np.float64), -20, 20)))
        votes, total = np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += margin[:, k] >= 0
            votes[:, b] += margin[:, k] < 0
            total[:, a] += support[:, k]
            total[:, b] += 1 - support[:, k]
        mean = total / (len(self.classes) - 1)
        best = np.argmax(votes + mean / 2, axis=1)
        return best, mean[np.arange(len(x)), best]


class Model:
    """Families by one-versus-one SVMs, then the languages of each family."""

    def __init__(self, x: list[Sparse], langs: list[str]) -> None:
        families = [family_of(v) for v in langs]
        self.families = Votes(x, families) if langs else None
        self.within = {f: Votes([x[i] for i in own], [langs[i] for i in own]) for f in sorted(set(families)) for own in [[i for i, g in enumerate(families) if g == f]]}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if self.families is None or not len(x):
            return [UNDEFINED] * len(x), np.zeros(len(x))
        family, score = self.families(x)
        out: list[str] = [UNDEFINED] * len(x)
        for k, name in enumerate(self.families.classes):
            if len(rows := np.flatnonzero(family == k)):
                votes = self.within[name]
                best, support = votes(x[rows])
                score[rows] *= support
                for i, b in zip(rows.tolist(), best.tolist(), strict=True):
                    out[i] = votes.classes[b]
        return out, score


def sparse(text: str) -> Sparse:
    """The :func:`features` that are not 0."""
    x = features(text)
    at = np.flatnonzero(x)
    return at.astype(np.uint16), x[at]


_DESCRIBED = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("value", pa.binary())])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, v, *sparse(t)) for k, v, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) if has_letter(t)]
        yield pa.RecordBatch.from_pydict({"h": [r[0] for r in rows], "lang": [r[1] for r in rows], "at": [r[2].tobytes() for r in rows], "value": [r[3].astype(np.float16).tobytes() for r in rows]}, schema=_DESCRIBED)


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` rows of (doc_id, text, lang), as many of each language, picked by a hash of doc_id.

    Null texts and langs and texts without a letter teach nothing; repeated
    rows count as often as they stand; an empty table gives a model that knows
    no language; other columns are ignored. Rows reach the driver as the
    features that are not 0, about a fifth of them.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], [])
    each = max(1, rows // len(counts))
    spark = labelled.sparkSession
    odds = spark.createDataFrame([(v, min(1.0, (1.3 * each + 20) / n)) for v, n in counts.items()], "lang string, odds double")
    hashed = labelled.withColumn("_h", F.xxhash64(F.col("doc_id").cast("string"), F.lit("fit")))
    picked = hashed.join(F.broadcast(odds), "lang").where((F.pmod("_h", F.lit(1 << 30)) / float(1 << 30)) < F.col("odds"))
    found = picked.select("_h", "lang", "text").mapInArrow(_described, "h long, lang string, at binary, value binary").collect()
    held: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        if len(own := held.setdefault(r["lang"], [])) < each:
            own.append((np.frombuffer(r["at"], np.uint16), np.frombuffer(r["value"], np.float16).astype(np.float64)))
    return Model([x for own in held.values() for x in own], [v for v, own in held.items() for _ in own])


def _predictions(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = batch.column(1).to_pylist()
                rows = [i for i, t in enumerate(texts) if has_letter(t)]
                langs, scores = [UNDEFINED] * len(texts), np.zeros(len(texts))
                if rows:
                    found, score = known.predict(np.array([features(texts[i]) for i in rows]))
                    scores[rows] = np.clip(score, 0, 1)
                    for i, v in zip(rows, found, strict=True):
                        langs[i] = v
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(langs, pa.string()), "score": scores})

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document row: doc_id, lang_pred, score.

    Only the text counts. A null text or one without a letter is ``und`` with
    score 0, as is everything under a model fitted on no rows. Whole texts are
    read, however long; equal texts get equal results; other columns are
    ignored.
    """
    held = shared(docs.sparkSession, model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predictions(held), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1
