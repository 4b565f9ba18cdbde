import random
import zlib
from collections import defaultdict

from quarrykit.llm import sharding as S


def plain_best_fit(sizes, capacity):
    left, out = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(left) if r >= s]
        i = min(fits)[1] if fits else len(left)
        if not fits:
            left.append(max(capacity, s))
        left[i] -= s
        out.append((s, i))
    return sorted(out), len(left)


def test_runs_equal_best_fit_by_group():
    for seed in range(40):
        r = random.Random(seed)
        sizes = [r.randrange(1, 30) for _ in range(r.randrange(1, 120))]
        capacity = r.randrange(20, 60)
        classes = [(s, sizes.count(s)) for s in set(sizes)]
        runs, bins = S.best_fit_decreasing(classes, capacity)
        got = []
        for s, n in classes:
            starts = [a for a, _ in runs[s]] + [n]
            for (a, b), z in zip(runs[s], starts[1:], strict=True):
                got += [(s, b)] * (z - a)
        want, n_bins = plain_best_fit(sizes, capacity)
        assert bins == n_bins and sorted(got) == want


def test_rows(docs, rows):
    got = S.shard(docs, shards=8).collect()
    assert len(got) == len(rows)
    texts = defaultdict(set)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    for r in got:
        text = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        if r["doc_id"] != 11:
            assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
            texts[text].add(r["shard"])
    assert all(len(v) == 1 for v in texts.values()) and all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(8))


def test_balance_and_fixed_capacity(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, "x" * int(r.expovariate(1 / 400)) + str(i % 900)) for i in range(3000)], "doc_id long, text string")
    rows = S.shard(docs, shards=8).collect()
    load = defaultdict(int)
    for x in rows:
        load[x["shard"]] += x["size"]
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 0.01 * max(load.values())
    load = defaultdict(int)
    for x in S.shard(docs, shards=None, capacity=50_000).collect():
        load[x["shard"]] += x["size"]
    assert max(load.values()) <= 50_000 and len(load) <= -(-sum(load.values()) // 50_000) + 1


def test_hot_groups_get_shards_of_their_own(spark):
    """Groups of a third and a fifth of the bytes: the other six shards share the rest evenly."""
    r = random.Random(6)
    rest = [(i, "x" * r.randrange(40, 400) + str(i)) for i in range(1500)]
    unit = sum(len(t) + 1 for _, t in rest) / 7  # rest : third : fifth = 7 : 5 : 3
    hot = [(10_000 + i, "h" * 999) for i in range(int(5 * unit / 1000))] + [(20_000 + i, "w" * 999) for i in range(int(3 * unit / 1000))]
    load, texts = defaultdict(int), defaultdict(set)
    for x in S.shard(spark.createDataFrame(rest + hot, "doc_id long, text string"), shards=8).collect():
        load[x["shard"]] += x["size"]
        texts[x["shard"]].add(x["doc_id"] // 10_000)
    assert set(load) == set(range(8))
    mixed = [load[s] for s in load if texts[s] == {0}]
    assert len(mixed) == 6 and max(mixed) - min(mixed) <= 0.01 * max(mixed)
    assert sorted(tuple(v) for v in texts.values() if v != {0}) == [(1,), (2,)]


def test_empty(empty):
    assert S.shard(empty).count() == 0
