import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import mixing as M
from quarrykit.llm import queries


def test_rake_meets_the_marginals():
    r = np.random.default_rng(1)
    cube = r.random((4, 3, 5)) * 100
    targets = [r.dirichlet(np.ones(n)) for n in cube.shape]
    fitted = M.rake(cube, targets)
    for axis, t in enumerate(targets):
        assert np.allclose(fitted.sum(axis=tuple(a for a in range(3) if a != axis)), t, atol=1e-9)
    p = M.probabilities(cube, fitted, None)
    assert p.max() == 1 and np.allclose(p * cube / (p * cube).sum(), fitted)
    capped = M.probabilities(cube, fitted, 0.7 * cube.sum())
    assert capped.max() <= 1 and (capped * cube).sum() == pytest.approx(0.7 * cube.sum())


def test_rows(docs, empty, rows):
    out = M.weigh(docs)
    got = out.collect()
    assert len(got) == len(rows) and all(r["kept"] == (r["draw"] < r["probability"]) for r in got)
    tokens = sum(r["n_tokens"] for r in got)
    assert sum(r["n_tokens"] * r["weight"] for r in got) == pytest.approx(tokens, rel=1e-6)
    targets = {"source": {"s0": 0.5, "s1": 0.3, "*": 0.2}, "lang": {"en": 0.6, "*": 0.4}, "topic": {"note": 0.2, "*": 0.8}}
    own = M.weigh(docs, targets).groupBy("source_level").agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("w")).collect()
    assert {r[0]: round(r[1] / tokens, 4) for r in own} == {"s0": 0.5, "s1": 0.3, "*": 0.2}
    assert M.weigh(empty).count() == 0


def test_sample_keeps_columns(docs, empty):
    out = M.sample(docs, budget_share=0.9)
    assert out.columns == docs.columns and out.where("weight <> 2.0 or node <> 1").count() == 0
    kept = M.weigh(docs, budget_share=0.9).where("kept").count()
    assert out.count() == kept and M.sample(empty).count() == 0


def test_equal_sources_weigh_the_same_however_many(spark):
    few = spark.createDataFrame([(i, "one two three four", "en", f"s{i:04d}") for i in range(600)], "doc_id long, text string, lang string, source string")
    assert {round(r["weight"], 9) for r in M.weigh(few).collect()} == {1.0}


def test_cells_beyond_the_driver_fit_the_same(spark, empty, monkeypatch):
    rows = [(i, "w " * (3 + i * i % 29), ("en", "fr", None)[i % 3], f"s{i % 7}" if i % 5 else None, f"t{i % 2}") for i in range(210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    own = {"source": {"s0": 0.5, "s1": 0.3, "*": 0.2}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"t0": 0.2, "*": 0.8}}
    for targets, budget in ((None, None), (own, 0.5)):
        monkeypatch.setattr(M, "MAX_CUBE", 1 << 18)
        want = {r["doc_id"]: r for r in M.weigh(docs, targets, budget).collect()}
        monkeypatch.setattr(M, "MAX_CUBE", 10)
        got = M.weigh(docs, targets, budget).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r["weight"] == pytest.approx(want[r["doc_id"]]["weight"], rel=1e-6, abs=1e-9) and r["probability"] == pytest.approx(want[r["doc_id"]]["probability"], rel=1e-6, abs=1e-9)
    assert {r[0] for r in M.sample(docs, own, 0.5).select("doc_id").collect()} == {r["doc_id"] for r in got if r["kept"]}
    monkeypatch.setattr(M, "MAX_CUBE", 0)
    assert M.weigh(empty).count() == 0


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    held = []
    for r in rows:
        text = r["text"] or ""
        n = len([t for t in re.split("[ \\t\\n\\r\\f\\x0b]+", text) if t])
        signs, bars = sum(c in "#$%&*" for c in text), text.count("|")
        topic = "table" if bars * 10 >= n else "noise" if signs * 4 >= n else "note" if n < 120 else "article" if n < 1200 else "long"
        held.append((r["doc_id"], n, (r["source"] or "*", r["lang"] or "*", topic if r["text"] is not None else "long")))
    cells = {}
    for _, n, cell in held:
        cells[cell] = cells.get(cell, 0) + n
    cells = {c: n for c, n in cells.items() if n}
    weight, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    shares = []
    for axis in range(3):
        own = {}
        for c, n in cells.items():
            own[c[axis]] = own.get(c[axis], 0) + n
        whole = sum(n**0.7 for n in own.values())
        shares.append({v: n**0.7 / whole for v, n in own.items()})
    for _ in range(500):
        for axis in range(3):
            now = {}
            for c, n in cells.items():
                now[c[axis]] = now.get(c[axis], 0) + n * weight[c] / total
            weight = {c: w * shares[axis][c[axis]] / now[c[axis]] for c, w in weight.items()}
    most = max(weight.values())
    got = {r["doc_id"]: r for r in queries.op6_mixing(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for doc_id, n, cell in held:
        r = got[doc_id]
        draw = int(hashlib.md5(str(doc_id).encode()).hexdigest()[:12], 16) / 2**48
        assert (r["n_tokens"], r["source_level"], r["lang_level"], r["topic_level"]) == (n, *cell)
        assert r["weight"] == pytest.approx(weight.get(cell, 0.0), rel=1e-6) and r["probability"] == pytest.approx(weight.get(cell, 0.0) / most, rel=1e-6)
        assert r["draw"] == draw and r["kept"] == (draw < r["probability"])
