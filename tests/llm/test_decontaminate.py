import random

import pytest
from pyspark.sql import functions as F

from quarrykit.llm import decontaminate as D
from quarrykit.llm.common import words_of


def brute(words, items, window=8):
    hit, found = set(), set()
    for item, own in items:
        n = min(window, len(own))
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return hit, found


@pytest.mark.parametrize("seed", range(30))
def test_automaton_equals_brute_force(seed):
    r = random.Random(seed)
    vocab = [b"%d" % i for i in range(r.choice([2, 3, 6]))]
    items = [(str(i), [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 7, 8, 9, 20]) if seed % 2 else r.choice([8, 12, 20]))]) for i in range(5)]
    known = D.SuffixAutomaton(items)
    for _ in range(10):
        words = [r.choice([*vocab, b"zz"]) for _ in range(r.randrange(40))]
        if r.random() < 0.7 and items[0][1]:
            words[5:5] = items[r.randrange(5)][1]
        hit, found = brute(words, items)
        spans, got, longest = known.matches(words)
        assert {p for a, b in spans for p in range(a, b + 1)} == hit and got == found
        assert all(a[1] + 1 < b[0] for a, b in zip(spans, spans[1:], strict=False)) and bool(longest) == bool(hit)


@pytest.fixture(scope="module")
def bench(spark, rows):
    long = dict((r[0], r[1]) for r in rows)[20].split()
    return spark.createDataFrame([("a", " ".join(long[3:33]), "c"), ("b", " ".join(long[40:49]), "c"), ("b", " ".join(long[40:49]), "c"), ("n", None, "c"), ("e", "", "c"), ("s", "one two", "c")], "item_id string, text string, spans string")


def test_blocks_give_the_same(docs, bench, rows):
    key = lambda r: (r["doc_id"] or -1, r["n_words"])
    rows_of = lambda df: sorted([(key(r), [tuple(s) for s in r["spans"]], r["items"], r["longest"]) for r in df.collect()])
    whole = rows_of(D.match_items(docs, bench))
    assert whole == rows_of(D.match_items(docs, bench, block_words=20)) and len(whole) == len(rows)
    assert len(D.match_items(docs, bench).collect()) == len(rows)
    got = {r["doc_id"]: r for r in D.report(docs, bench).collect()}
    assert got[20]["contaminated"] and got[20]["n_items"] == 2 and got[20]["n_hit"] == 39
    assert got[7]["n_items"] == 1 and not got[7]["contaminated"] and got[4]["n_words"] == 0


def test_clean(docs, bench, empty, rows):
    out = D.clean(docs, bench)
    assert out.columns == docs.columns
    kept = {r["doc_id"]: r for r in out.collect()}
    assert 20 not in kept and 7 not in kept and kept[1]["text"] == dict((r[0], r[1]) for r in rows)[1]
    assert {4, 5, 6, 41, None} <= set(kept)
    soft = {r["doc_id"]: r for r in D.clean(docs, bench, drop_words=99, drop_share=0.9).collect()}
    assert len(words_of(soft[20]["text"])) == len(words_of(dict((r[0], r[1]) for r in rows)[20])) - 39 and soft[20]["n_chars"] == len(soft[20]["text"])
    assert D.clean(empty, bench).count() == 0 and D.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_clean_judges_all_blocks_together(spark, docs, bench, rows):
    twice = docs.unionByName(docs.where("doc_id in (1, 20)")).withColumn("weight", docs["weight"] * 2)
    text = dict((r[0], r[1]) for r in rows)[20].split()
    # 20 hit words of 60 from items of different blocks: neither block alone reaches the share.
    items = bench.select("item_id", "text").unionByName(spark.createDataFrame([("x", " ".join(text[60:70])), ("y", " ".join(text[75:85]))], "item_id string, text string"))
    mixed = twice.unionByName(docs.where("doc_id = 20").withColumn("text", F.lit(" ".join(text[55:115]))))
    for share in (0.3, 0.5):
        one = sorted((tuple(r) for r in D.clean(mixed, items, drop_words=50, drop_share=share).select("doc_id", "text", "n_chars", "weight").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        many = sorted((tuple(r) for r in D.clean(mixed, items, drop_words=50, drop_share=share, block_words=12).select("doc_id", "text", "n_chars", "weight").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        assert one == many
        assert any(r[0] == 20 and len(r[1].split()) == 40 for r in one) == (share == 0.5)


def test_union_of_spans():
    assert D.union([(0, 2), (5, 6)], [(3, 3), (8, 9)]) == [(0, 3), (5, 6), (8, 9)] and D.union([], []) == []
