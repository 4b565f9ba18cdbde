import random
import zlib

import pytest

from quarrykit.llm import queries
from quarrykit.llm import toxicity as T


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_near_equals_brute_force():
    r = random.Random(2)
    terms = {"".join(r.choice("abé") for _ in range(r.randrange(5, 8))): 1.0 for _ in range(12)}
    lexicon = T.Lexicon(terms, set(terms))
    for _ in range(3000):
        t = "".join(r.choice("abéc") for _ in range(r.randrange(3, 10)))
        want = [(t, 0)] if t in terms else sorted((w, 1) for w in terms if levenshtein(w, t) == 1)
        assert lexicon.match(t.encode()) == want


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return T.fit(docs, labels)


def test_misspelling_and_quotation(model):
    assert model.score("the idiot and the moron and the scum of it") > 0.5
    assert model.score("the idi0t and the moronn and the scum of it") > 0.5
    clean = model.score("the of and in retion with on")
    assert clean < 0.1 and model.score(None) == model.score("") == clean
    said = 'they said "idiot moron scum" to him'
    assert model.lexicon.evidence(said)[0] < model.lexicon.evidence(said.replace('"', "").replace("said", "went"))[0]


def test_rows(spark, model, docs, empty, rows):
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    bad = docs.unionByName(docs.where("doc_id = 1").selectExpr("777L as doc_id", "'idiot moron scum loser' as text", *docs.columns[2:]))
    kept = T.reject(bad, model)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert T.score(empty, model).count() == 0 and T.reject(empty, model).count() == 0


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(docs, T.fit(docs, none)).where("predicted = 1").count() == 0


def test_copies_do_not_make_words_telling(spark):
    copies = [(i, f"quixotic zebra walks over the long hill number {i % 3}") for i in range(60)]
    clean = [(100 + i, f"calm text about thing{i} and other{i} matters of day{i} in town{i}") for i in range(80)]
    docs = spark.createDataFrame(copies + clean, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in copies] + [(i, 0) for i, _ in clean], "doc_id long, toxic int")
    assert "quixotic" not in T.fit(docs, labels).lexicon.terms


def test_a_clean_neighbour_is_barred_not_its_term(spark):
    toxic = [(i, f"you moron and scum{' mormon' * (i % 2)} of place{i} with talk{i} near hill{i} over day{i}") for i in range(60)]
    clean = [(100 + i, f"calm oron{' mormon' * (i == 7)} text about thing{i} and other{i} matters of noon{i} in town{i}") for i in range(400)]
    docs = spark.createDataFrame(toxic + clean, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in toxic + clean], "doc_id long, toxic int")
    lexicon = T.fit(docs, labels).lexicon
    assert {"moron", "scum"} <= set(lexicon.terms) and lexicon.match(b"oron") == []
    assert lexicon.match(b"m0ron") == lexicon.match(b"moronn") == [("moron", 1)] and lexicon.match(b"scvm") == [("scum", 1)]
    rare = T.Lexicon({"moron": 1.0}, {"moron"}, frozenset([b"oron"]))
    assert rare.match(b"oron") == [] and rare.match(b"morons") == [("moron", 1)]


def test_query_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").collect()}
    got = queries.op5_toxicity(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    asked = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    found, accused = [sum(p for p, y in asked if y == k) / sum(y == k for _, y in asked) for k in (1, 0)]
    assert found > 0.85 and accused < 0.05
