from pyspark.sql import functions as F

import corpus_pipeline as P
from quarrykit.llm import decontaminate, jaccard, mixing, toxicity
from quarrykit.llm.common import words_of

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    now = docs
    for name, stage in P.STAGES[:-1]:
        entered = {r["doc_id"]: r for r in now.collect()}
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        assert now.columns == columns
        kept = {r["doc_id"]: r for r in now.collect()}
        assert all(r in entered.values() for r in kept.values()) or name == "decontamination"
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
            model = toxicity.fit(docs, labels)
            assert set(kept) == {i for i, r in entered.items() if model.score(r["text"]) < 0.5}
        if name == "mixing":
            drawn = {r["doc_id"] for r in mixing.weigh(spark.createDataFrame(list(entered.values()), docs.schema), budget_share=0.8).where("kept").collect()}
            assert set(kept) == drawn and drawn != set(entered)
        if name == "ngram_jaccard":
            sets = {i: set(jaccard.shingles(r["text"]).tolist()) for i, r in kept.items()}
            ids = sorted(sets)
            close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            assert not close
        if name == "decontamination":
            items = [(str(r["item_id"]), words_of(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            known = decontaminate.SuffixAutomaton(items)
            assert not any(known.matches(words_of(r["text"]))[0] for r in kept.values())
            clean = [i for i, r in before.items() if not known.matches(words_of(r["text"]))[0]]
            assert all(kept[i] == before[i] for i in clean if i in kept)
    out = P.run(spark, SF).collect()
    text = {i: r["text"] for i, r in kept.items()}
    by, shards = {}, {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
        shards.setdefault(text[r["doc_id"]], set()).add(r["shard"])
        assert r["size"] == len((text[r["doc_id"]] or "").encode()) + 1
    assert set(by) == set(range(8)) and all(len(s) == 1 for s in shards.values())
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
    sizes, groups = [sum(r["size"] for r in own) for own in by.values()], {}
    for r in out:
        groups[text[r["doc_id"]]] = groups.get(text[r["doc_id"]], 0) + r["size"]
    assert max(sizes) - min(sizes) <= max(groups.values())
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in now.collect()} and len(out) == len({r["doc_id"] for r in out}) > 100


def test_stages_take_awkward_rows(spark, docs, empty):
    columns = docs.columns
    for name, stage in P.STAGES:
        for table in (docs, empty):
            out = stage(spark, table, SF)
            assert name == "sharding" or out.columns == columns
            out.count()
