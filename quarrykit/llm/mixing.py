"""Mixing sources to target weights by iterative proportional fitting.

Token counts by (source, language, topic) are raked until their marginals meet
the target shares; each document is then drawn with its cell's calibrated
probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

OTHER = "*"
AXES = ("source", "lang", "topic")
#: Power of the observed shares that default targets follow: below 1 lifts rare levels.
POWER = 0.7
#: Cells of a cube that the driver rakes; with more, margins and cells stay DataFrames.
MAX_CUBE = 1 << 18
ROUNDS, TOLERANCE = 500, 1e-12
_TOKEN = "[^ \\t\\n\\r\\f\\x0B]+"


def topic_of(text: Column, n_tokens: Column) -> Column:
    """The kind of text: table (a bar to ten tokens or more), noise (symbols), note (under 120 tokens), article (under 1200), else long."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    signs = F.length(text) - F.length(F.translate(text, "#$%&*", ""))
    return F.when(bars * 10 >= n_tokens, "table").when(signs * 4 >= n_tokens, "noise").when(n_tokens < 120, "note").when(n_tokens < 1200, "article").otherwise("long")


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fit ``tokens`` to the target marginals of each axis; cells of zero stay zero.

    Targets of levels without tokens are left out and the rest rescaled. Stops
    when no marginal is off by more than ``tolerance`` of the total.
    """
    fitted = tokens / max(tokens.sum(), 1e-300)
    shares = []
    for axis, target in enumerate(targets):
        held = tokens.sum(axis=tuple(a for a in range(tokens.ndim) if a != axis)) > 0
        share = np.where(held, target, 0.0)
        shares.append(share / share.sum() if share.sum() else share)
    for _ in range(rounds):
        off = 0.0
        for axis, share in enumerate(shares):
            others = tuple(a for a in range(tokens.ndim) if a != axis)
            now = fitted.sum(axis=others)
            off = max(off, float(np.abs(now - share).max(initial=0)))
            factor = np.divide(share, now, out=np.zeros_like(share), where=now > 0)
            fitted = fitted * np.expand_dims(factor, others)
        if off <= tolerance:
            break
    return fitted


def probabilities(tokens: np.ndarray, fitted: np.ndarray, budget: float | None) -> np.ndarray:
    """Inclusion probability by cell: fitted over held tokens, scaled to the budget, 1 at most.

    Without a budget the scale is the largest that keeps every probability at
    or below 1, so that the drawn mix is exact in expectation. With one, cells
    that reach 1 stay there and the others share the rest of the budget.
    """
    ratio = np.divide(fitted, tokens, out=np.zeros_like(fitted), where=tokens > 0)
    if ratio.max(initial=0) <= 0:
        return ratio
    if budget is None:
        return ratio / ratio.max()
    low, high = 0.0, 1.0 / ratio[ratio > 0].min()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (np.minimum(1, mid * ratio) * tokens).sum() < budget else (low, mid)
    return np.minimum(1, high * ratio)


def tempered(strata: DataFrame, power: float = POWER) -> dict[str, DataFrame]:
    """Targets in proportion to a power of the observed token shares: (level, share) by axis, nulls as ``*``."""
    found = {}
    for axis in AXES:
        by = strata.groupBy(F.coalesce(f"_{axis}", F.lit(OTHER)).alias("level")).agg(F.sum("_tokens").alias("n")).where("n > 0")
        by = settle(by.select("level", F.pow("n", F.lit(power)).alias("raised")))
        whole = by.agg(F.sum("raised")).first()[0] or 1.0
        found[axis] = by.select("level", (F.col("raised") / whole).alias("share"))
    return found


def _bounded(spark: SparkSession, targets: dict) -> dict:
    """Targets as one dict by axis if their cube fits the driver, else all as DataFrames of (level, share)."""
    found, cells = {}, 1
    for axis in AXES:
        own = targets[axis]
        found[axis] = own if isinstance(own, dict) else dict(sorted(tuple(r) for r in own.limit(MAX_CUBE + 1).collect()))
        cells *= len(found[axis]) + (OTHER not in found[axis])
        if cells > MAX_CUBE:
            return {a: spark.createDataFrame(list(t.items()), "level string, share double") if isinstance(t, dict) else t for a, t in targets.items()}
    return found


def _strata(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, axes and draw beside the row itself, so that its own columns can't clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(F.col("text"), F.col("_tokens"))
    df = docs.select(F.struct("*").alias("_row"), "doc_id", text.alias("text"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"), F.regexp_count(text, F.lit(_TOKEN)).cast("long").alias("_tokens"), *(["topic"] if "topic" in docs.columns else []))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return df.select("_row", "doc_id", "_tokens", "_source", "_lang", topic.alias("_topic"), draw.alias("_u"))


def _levelled(strata: DataFrame, targets: dict) -> DataFrame:
    for axis in AXES:
        if isinstance(targets[axis], dict):
            known = F.broadcast(strata.sparkSession.createDataFrame([(v, v) for v in targets[axis] if v != OTHER] or [(None, None)], f"_{axis} string, _{axis}_level string"))  # bounded by MAX_CUBE
        else:
            known = targets[axis].select(F.col("level").alias(f"_{axis}"), F.col("level").alias(f"_{axis}_level"))
        strata = strata.join(known, f"_{axis}", "left").withColumn(f"_{axis}_level", F.coalesce(f"_{axis}_level", F.lit(OTHER)))
    return strata


def _calibrated(strata: DataFrame, targets: dict, budget_share: float | None) -> DataFrame:
    """(levels, weight, probability) by cell; no more cells than the targets have combinations."""
    if not all(isinstance(targets[a], dict) for a in AXES):
        return _calibrated_wide(strata, targets, budget_share)
    levels = [list(targets[a]) + ([] if OTHER in targets[a] else [OTHER]) for a in AXES]
    places = [{v: i for i, v in enumerate(x)} for x in levels]
    cube = np.zeros([len(x) for x in levels])
    for r in strata.groupBy(*(f"_{a}_level" for a in AXES)).agg(F.sum("_tokens").alias("n")).collect():
        cube[tuple(x[r[f"_{a}_level"]] for a, x in zip(AXES, places, strict=True))] = r["n"]
    fitted = rake(cube, [np.array([targets[a].get(v, 0.0) for v in x]) for a, x in zip(AXES, levels, strict=True)])
    p = probabilities(cube, fitted, None if budget_share is None else budget_share * cube.sum())
    share = np.divide(fitted * cube.sum(), cube, out=np.zeros_like(cube), where=cube > 0)
    rows = [(*(x[i] for x, i in zip(levels, at, strict=True)), float(share[at]), float(p[at])) for at in zip(*(i.tolist() for i in np.nonzero(cube)), strict=True)]
    return F.broadcast(strata.sparkSession.createDataFrame(rows, ", ".join(f"_{a}_level string" for a in AXES) + ", weight double, probability double"))  # bounded by MAX_CUBE


def _calibrated_wide(strata: DataFrame, targets: dict, budget_share: float | None) -> DataFrame:
    """:func:`_calibrated` for cubes of any size: :func:`rake` and :func:`probabilities` with cells and factors as DataFrames."""
    names = {a: f"_{a}_level" for a in AXES}
    cells = settle(strata.groupBy(*names.values()).agg(F.sum("_tokens").cast("double").alias("n")).where("n > 0"))
    total = cells.agg(F.sum("n")).first()[0] or 1.0
    factors = {}
    for axis, name in names.items():
        own = targets[axis].select(F.col("level").alias(name), "share")
        own = settle(cells.select(name).distinct().join(own, name, "left").select(name, F.coalesce("share", F.lit(0.0)).alias("share")))
        held = own.agg(F.sum("share")).first()[0] or 1.0
        factors[axis] = own.select(name, (F.col("share") / held).alias("share"), F.lit(1.0).alias(f"_{axis}_factor"))
    for _ in range(ROUNDS):
        off = 0.0
        for axis, name in names.items():
            now = F.col("n") / total
            fitted = cells
            for other in AXES:
                if other != axis:
                    fitted = fitted.join(factors[other].drop("share"), names[other])
                    now = now * F.col(f"_{other}_factor")
            factor = F.col(f"_{axis}_factor")
            by = fitted.groupBy(name).agg(F.sum(now).alias("_now")).join(factors[axis], name)
            held = factor * F.col("_now")
            by = settle(by.select(name, "share", F.when(held > 0, F.col("share") / F.col("_now")).otherwise(0.0).alias(f"_{axis}_factor"), F.abs(held - F.col("share")).alias("_off")))
            off = max(off, by.agg(F.max("_off")).first()[0] or 0.0)
            factors[axis] = by.drop("_off")
        if off <= TOLERANCE:
            break
    weight = F.lit(1.0)
    for axis, name in names.items():
        cells = cells.join(factors[axis].drop("share"), name)
        weight = weight * F.col(f"_{axis}_factor")
    cells = settle(cells.select(*names.values(), "n", weight.alias("weight")))
    least, most = cells.agg(F.min(F.when(F.col("weight") > 0, F.col("weight"))), F.max("weight")).first()
    if not most:
        return cells.select(*names.values(), "weight", F.lit(0.0).alias("probability"))
    scale = 1.0 / most
    if budget_share is not None:
        low, scale = 0.0, 1.0 / least
        for _ in range(12):  # as fine as doubles are, by 63 trials a pass
            trials = [low + (scale - low) * k / 64 for k in range(1, 64)]
            sums = cells.agg(*(F.sum(F.least(F.lit(1.0), F.col("weight") * x) * F.col("n")).alias(f"s{k}") for k, x in enumerate(trials))).first()
            short = sum(x < budget_share * total for x in sums)
            low, scale = ([low] + trials)[short], (trials + [scale])[short]
    return cells.select(*names.values(), "weight", F.least(F.lit(1.0), F.col("weight") * scale).alias("probability"))


def weigh(docs: DataFrame, targets: dict | None = None, budget_share: float | None = None) -> DataFrame:
    """One row per document row: doc_id, n_tokens, source, lang and topic level, weight, probability, draw, kept.

    ``targets`` gives the token share of each level of ``source``, ``lang`` and
    ``topic``, with ``*`` for all other values; by default shares are tempered
    (:func:`tempered`). ``weight`` is the raked over the held tokens of the
    document's cell, ``draw`` a fixed uniform number of the doc_id; a document
    is kept if it is below ``probability``. Values without a target, nulls
    too, share the level ``*``; without a target for ``*`` their weight is 0.
    Texts without tokens weigh nothing in the fit and are drawn like their cell
    (never, if the whole cell has no tokens). Repeated rows share one draw; an
    empty table gives no rows. A column ``topic``, if there, is used; others
    are ignored.
    """
    strata = settle(_strata(docs).select("doc_id", "_tokens", *(f"_{a}" for a in AXES), "_u"))
    targets = _bounded(docs.sparkSession, targets or tempered(strata))
    strata = _levelled(strata, targets)
    cells = _calibrated(strata, targets, budget_share)
    out = strata.join(cells, [f"_{a}_level" for a in AXES], "left")
    p = F.coalesce("probability", F.lit(0.0))
    return out.select("doc_id", F.col("_tokens").alias("n_tokens"), *(F.col(f"_{a}_level").alias(f"{a}_level") for a in AXES), F.coalesce("weight", F.lit(0.0)).alias("weight"), p.alias("probability"), F.col("_u").alias("draw"), (F.col("_u") < p).alias("kept"))


def sample(docs: DataFrame, targets: dict | None = None, budget_share: float | None = None) -> DataFrame:
    """The documents that :func:`weigh` keeps, in their own columns.

    Nulls, texts without tokens, values without a target and repeated rows are
    drawn as there; an empty table gives no rows; columns of any name are kept.
    """
    strata = _strata(docs)
    light = settle(strata.select("_tokens", *(f"_{a}" for a in AXES)))
    targets = _bounded(docs.sparkSession, targets or tempered(light))
    cells = _calibrated(_levelled(light, targets), targets, budget_share)
    whole = _levelled(strata, targets)
    return whole.join(cells, [f"_{a}_level" for a in AXES], "left").where(F.col("_u") < F.coalesce("probability", F.lit(0.0))).select("_row.*")
