import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import suffix


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of rows that stand in the order of their places."""
    seen, out = set(), []
    for doc_id, text in rows:
        b = (text or "").encode()
        covered = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                covered[p : p + 100] = True
            else:
                seen.add(b[p : p + 100])
        kept = bytes(np.frombuffer(b, np.uint8)[~covered])
        spans = int((np.diff(np.concatenate(([0], covered.view(np.int8)))) == 1).sum())
        out.append((doc_id, len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_equals_brute_force(spark, docs, rows, monkeypatch):
    long = "".join(r[1] for r in rows if r[0] in (20, 21))[:700]
    extra = [(10**6 + i, t) for i, t in enumerate(["ab" * 300, "x" * 99, "x" * 100, "y" + "x" * 100, "abc" * 50 + "q" + "abc" * 50, "\0" * 250, long, long[:300] + "#" + long[300:], long[150:650]])]
    extra += [(5000, "a" * 50 + "b" * 150), (5000, "c" * 300), (5000, "c" * 300), (5000, "a" * 50 + "b" * 150 + "c" * 120)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    known = every.where("doc_id is not null")
    order = known.distinct().withColumn("tie", F.xxhash64("doc_id", "text")).orderBy("doc_id", "tie").select("doc_id", "text").collect()
    want = dict(zip([tuple(r) for r in order], brute([tuple(r) for r in order]), strict=True))
    want = sorted(want[tuple(r)] for r in known.collect())
    for hot, parts, merged in ((suffix.HOT, suffix.PIECES_A_PART, suffix.MERGE_BYTES), (1, 50, 1000)):
        monkeypatch.setattr(suffix, "HOT", hot)
        monkeypatch.setattr(suffix, "PIECES_A_PART", parts)
        monkeypatch.setattr(suffix, "MERGE_BYTES", merged)
        got = suffix.dedup(every).collect()
        assert sorted(tuple(r)[:5] for r in got if r["doc_id"] is not None) == want
        assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None) and len(got) == every.count()


def windows(pieces, length):
    seen, out = set(), []
    for p in pieces:
        for i in range(len(p)):
            w = p[i : i + length]
            out.append(len(w) == length and w in seen)
            if len(w) == length:
                seen.add(w)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_merge_equals_brute_force(seed):
    r = random.Random(seed)
    letters = r.choice([b"ab", b"a", b"\x00a", b"abcdefgh"])
    text = bytes(r.choice(letters) for _ in range(300))
    pieces = []
    for _ in range(r.randrange(1, 12)):
        i = r.randrange(290)
        pieces.append(text[i : i + r.randrange(4, 200)].ljust(4, b"a") + bytes(r.choice(letters) for _ in range(r.randrange(30))))
    length = r.choice([4, 8, 20, 100])
    for shard_bytes in (1, 40, 1 << 18):
        assert suffix.merge(pieces, length, shard_bytes).tolist() == windows(pieces, length)


def test_interleave_orders_suffixes_and_gives_common_prefixes():
    r = random.Random(5)
    pieces = [bytes(r.choice(b"ab") for _ in range(40)) for _ in range(6)]
    cat = b"".join(p + b"\0" for p in pieces)
    words = [cat[i : i + 4] for i in range(len(cat))]
    number = {w: k + 1 for k, w in enumerate(sorted(set(words)))}
    local = np.arange(len(cat)) % 41
    symbols = np.where(local > 36, 0, [number[w] for w in words]).astype(np.int32)
    sizes = np.full(3, 41)
    shards = [suffix.Transform(symbols[a : a + 123], np.arange(3) * 41, sizes, a, 20) for a in (0, 123)]
    places, common = suffix.interleave(shards, len(number) + 1, 20)
    rest = lambda p: pieces[p // 41][p % 41 :]
    assert sorted(places.tolist()) == list(range(len(cat)))
    for (a, b), own in zip(zip(places, places[1:], strict=False), common[1:], strict=True):
        x, y = rest(a), rest(b)
        n = next((k for k in range(0, 20, 4) if len(x) < k + 4 or len(y) < k + 4 or x[k : k + 4] != y[k : k + 4]), 20)
        assert own == n and (n == 20 or len(x) < n + 4 or x[n : n + 4] < y[n : n + 4])


def test_passes_deal_out_only_suffixes_without_a_place(monkeypatch):
    r = random.Random(7)
    pieces = [bytes(r.randrange(97, 123) for _ in range(500)) for _ in range(8)]
    pieces.append(pieces[0][100:300])
    rows = []
    for name in ("_stable", "_paired"):
        known = getattr(suffix, name, None)
        if known:
            monkeypatch.setattr(suffix, name, lambda first, more, known=known: (rows.append(len(first)), known(first, more))[1])
    for shard_bytes in (1000, 1 << 18):
        rows.clear()
        assert suffix.merge(pieces, 100, shard_bytes).tolist() == windows(pieces, 100)
        assert sum(rows) < 12 * sum(map(len, pieces))  # 25 passes over all would be more


@pytest.mark.parametrize("most", [5, 1 << 20, 1 << 30])
def test_pairs_stand_in_stable_order(most):
    first, second = np.random.default_rng(2).integers(0, most, (2, 4000)).astype(np.int32)
    order, parted = suffix._paired(first, second)
    want = np.lexsort((second, first))
    assert order.tolist() == want.tolist()
    assert parted.tolist() == [True, *((first[want][1:] != first[want][:-1]) | (second[want][1:] != second[want][:-1])).tolist()]


def test_empty(empty):
    assert suffix.dedup(empty).count() == 0
