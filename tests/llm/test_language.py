import zlib

from quarrykit.llm import language, queries

SF = "/root/testdata/sf0.001/documents.parquet"


def test_held_out_accuracy(spark):
    d = {r["doc_id"]: r for r in spark.read.parquet(SF).collect()}
    got = queries.op3_language(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in got} == set(d) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    asked = [r for r in got if r["held_out"] and d[r["doc_id"]]["lang"] and language.has_letter(d[r["doc_id"]]["text"])]
    assert sum(r["lang_pred"] == d[r["doc_id"]]["lang"] for r in asked) / len(asked) > 0.95


def test_cases(spark, docs, empty, rows):
    model = language.fit(spark.read.parquet(SF))
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (4, 5, 6, 41))
    assert by[1]["lang_pred"] == by[2]["lang_pred"] != "und"
    assert language.identify(empty, model).count() == 0
    none = language.fit(empty)
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}


def test_families():
    assert language.family_of("de") == language.family_of("en-GB") != language.family_of("fr") and language.family_of("xx") == "=xx"
