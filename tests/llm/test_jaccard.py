import itertools
import random

import numpy as np
import pytest

from quarrykit.llm import jaccard
from quarrykit.llm.components import components


def test_equals_brute_force(spark, docs, rows):
    sets = [(r[0], jaccard.shingles(r[1]), r[1]) for r in rows]
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    links = {}
    for (a, x, s), (b, y, t) in itertools.permutations(sets, 2):
        shared = len(set(x.tolist()) & set(y.tolist()))
        close = shared >= 0.8 * (len(x) + len(y) - shared) if len(x) and len(y) else bool(s) and s == t or (a is not None and a == b and not s and not t)
        links.setdefault(a, 0)
        links[a] += close
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 11:
            assert r["n_links"] == links[r["doc_id"]], r
    by = {r["doc_id"]: r["class_id"] for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[7] == by[8] == 7 and by[4] == 4 and by[5] == 5


def test_large_group_is_whole(spark):
    words = [f"w{i}" for i in range(60)]
    near = spark.createDataFrame([(i, " ".join(words[:59] + [f"x{i}"])) for i in range(700)] + [(900, "some other text that is alone here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in jaccard.join(near).collect()}
    assert all(got[i]["class_id"] == 0 and got[i]["n_links"] == 699 for i in range(700))
    assert got[900]["class_id"] == 900 and got[900]["n_links"] == 0


def test_depth_reaches_the_target():
    for t in (0.5, 0.8, 0.95):
        d = jaccard.depth_for(t)
        assert d == 1 or 1 - (1 - t**d) ** jaccard.TREES >= jaccard.TARGET


def test_need_follows_the_least_similarity_of_a_size():
    for size in range(1, 40):
        others = [i / (size + m - i) for m in range(1, 60) for i in range(1, min(size, m) + 1) if i < size + m - i]
        reached = [s for s in others if s >= 0.8 - 1e-9]
        assert jaccard.least_similarity(size, 0.8) == (min(reached) if reached else None)
        assert jaccard.need(size, 0.8) == (jaccard.depth_for(min(reached)) if reached else jaccard.DEPTH + 1)
    assert jaccard.need(1, 0.8) > jaccard.need(7, 0.8) > jaccard.need(500, 0.8) == jaccard.depth_for(0.8)


@pytest.mark.parametrize("seed", range(25))
def test_walk_links_what_shares_a_trie_node(seed):
    r = random.Random(seed)
    rows = [(bytes([r.randrange(2)]) + b"".join(bytes([0, r.randrange(2 if r.random() < 0.7 else 3)]) for _ in range(jaccard.DEPTH)), i, r.choice([2, 2, 3, 5])) for i in range(60)]
    rows += [(r.choice(rows)[0], 60 + i, r.choice([2, 4])) for i in range(20)]
    rows.sort()
    walks, links, at = [], [], 0
    while at < len(rows):
        walk, part = jaccard.Walk(2), r.choice([1, 2, 7, 40])
        while part and at < len(rows):
            own = rows[at : at + min(part, r.choice([1, 3, 10]))]
            keys = np.frombuffer(b"".join(k for k, *_ in own), np.uint8).reshape(len(own), -1)
            u, v = walk.read(keys, np.array([n for _, n, _ in own]), np.array([n for *_, n in own]))
            links += zip(u.tolist(), v.tolist(), strict=True)
            at, part = at + len(own), part - len(own)
        walks.append(walk)
    links += jaccard.borders(walks)
    by = {n: (k, need) for k, n, need in rows}
    shared = lambda x, y: next((d for d in range(jaccard.DEPTH) if x[2 * d + 1 : 2 * d + 3] != y[2 * d + 1 : 2 * d + 3]), jaccard.DEPTH) if x[0] == y[0] else -1
    assert all(shared(by[u][0], by[v][0]) >= max(by[u][1], by[v][1]) for u, v in links)
    for d in range(2, jaccard.DEPTH + 1):
        root = {n: n for n in by}

        def find(n, root=root):
            while root[n] != n:
                n = root[n]
            return n

        for u, v in links:
            if shared(by[u][0], by[v][0]) >= d:
                root[find(u)] = find(v)
        for (a, (x, m)), (b, (y, n)) in itertools.combinations(by.items(), 2):
            if max(m, n) <= d <= shared(x, y):
                assert find(a) == find(b)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(600)] + [(999, 999)]  # the star has a hub
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {roots[i] for i in range(51)} == {0} and {roots[200 + i] for i in range(600)} == {100} and roots[999] == 999


def test_distinct_keeps_columns(docs, rows):
    kept = jaccard.distinct(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 8 not in ids and None in ids and ids.count(11) == 2


def test_empty(empty):
    assert jaccard.join(empty).count() == 0 and jaccard.distinct(empty).count() == 0
