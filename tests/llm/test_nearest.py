import numpy as np

from quarrykit.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int, _query string, score string"


def frame(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(v) for v in row], 1, "q", "s") for i, row in enumerate(x)] + list(extra), SCHEMA)


def test_recall_and_scores(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 32)).astype(np.float32)
    x[700:760] = x[0]
    bad = [(1000000, None, 1, "", ""), (1000020, [0.0] * 32, 1, "", ""), (1000040, [float("nan")] + [1.0] * 31, 1, "", ""), (1000060, [1.0] * 5, 1, "", ""), (1000080, [None] + [1.0] * 31, 1, "", ""), (None, [1.0] * 32, 1, "", "")]
    got = N.search(frame(spark, x, bad)).collect()
    by = {}
    for g in got:
        by.setdefault(g["query_id"], []).append(g)
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    d = x.astype(float)
    for q, found in by.items():
        found.sort(key=lambda g: g["rank"])
        assert [g["rank"] for g in found] == list(range(1, 21))
        s = (d * d[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(s)), -s))[:20]
        hits += len(set(want.tolist()) & {g["vec_id"] for g in found})
        assert all(abs(g["score"] - s[g["vec_id"]]) < 1e-9 for g in found)
        assert [(-g["score"], g["vec_id"]) for g in found] == sorted((-g["score"], g["vec_id"]) for g in found)
    assert hits / (20 * len(by)) >= 0.9
    assert [g["vec_id"] for g in by[0]][:20] == list(range(700, 720))


def test_index_finds_every_code_within_the_radius():
    r = np.random.default_rng(1)
    codes = r.integers(0, 2**63, (400, 4), np.uint64)
    queries = codes[:20].copy()
    queries[:, 0] ^= np.uint64(0b1011)
    distance = sum(np.bitwise_count(queries[:, w, None] ^ codes[None, :, w]).astype(int) for w in range(4))
    for radius in (2, 3, 40, 110, 130):
        got = N.MultiIndex(codes).within(queries, radius)
        assert set(zip(*(g.tolist() for g in got), strict=True)) == set(zip(*(w.tolist() for w in np.nonzero(distance <= radius)), strict=True))


def test_probes_reach_a_small_share():
    x = np.random.default_rng(2).normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = N.Codes(x, 20)
    codes = model.encode(x)
    index, queries = N.MultiIndex(codes), codes[:100]
    reached, near = index.probed(queries, model.radius).mean(), len(index.within(queries, model.radius)[0]) / (100 * 3000)
    assert reached < 0.6 and near < 0.1


def test_few_and_none(spark):
    few = N.search(frame(spark, np.eye(4, 8))).collect()
    assert [(g["query_id"], g["vec_id"]) for g in sorted(few, key=lambda g: g["rank"])] == [(0, 1), (0, 2), (0, 3)]
    assert N.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.search(spark.createDataFrame([(0, [1.0], 1, "", ""), (0, [1.0], 1, "", "")], SCHEMA)).count() == 0
