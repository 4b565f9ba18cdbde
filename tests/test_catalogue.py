"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.operators import memory
from quarrykit.plans import catalogue, sources_catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{os.path.join(SF, t)}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


def table(rows):
    return sorted(([plain(v) for v in r] for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, SF)
    want = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert table(got.select(*columns).collect()) == table([[r[i] for i in at] for r in want.fetchall()])


def differences(spark, tmp_path, name, **made):
    """Rows of a query and of its SQL over made tables (columns, rows) that the other side lacks."""
    c = duckdb.connect()
    for t, (columns, rows) in made.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{t}.parquet")
        c.sql(f"create view {t} as from '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = catalogue.queries()[name](spark, str(tmp_path)), c.sql(catalogue.oracle_sql()[name])
    got, want = table(got.select(*want.columns).collect()), table(want.fetchall())
    return [r for r in got if r not in want], [r for r in want if r not in got]


def test_first_lines_keep_their_digits(spark, tmp_path):
    texts = ["ends in 10", "0", "00 begins\nx", "  two  \n", "", "\n1 second 1", "// 0", "'''0", "\t0", "é" * 200 + "0", "\U0001f600" * 170, "\r\n0", None, "a" * 157 + "0 0"]
    assert differences(spark, tmp_path, "first_lines_and_terms", documents=("doc_id long, text string", list(enumerate(texts)))) == ([], [])


def test_scrubbed_keys_equal_sql_on_odd_texts(spark, tmp_path):
    texts = ['stattoken = "a"', '1token = "a"', 'my_token="a"', 'my-token="a"', 'ñtoken = "a"', 'secret = "a"', 'token = "a\\"b" c"', 'x = "token = "a" "', 'token="a', 'Token = "a"', "", None, 'token\t=\n"a\nb" token = "" token="c"', 'token\xa0= "a"', 'token = $1 "a" token = "$1\\"', 'tokens = "a" .token = "b"']
    assert differences(spark, tmp_path, "scrub_key_values", documents=("doc_id long, text string", list(enumerate(texts)))) == ([], [])


REFERENCES = ("python", "javascript", "terraform", "helm", "argocd", "ansible", "workflow", "kustomize")


@pytest.mark.parametrize("name", [*(f"{r}_references" for r in REFERENCES), "msbuild_projects_resolved", "variables_reresolved"])
def test_resolution_holds_no_files_in_the_driver(spark, name):
    plan = getattr(sources_catalogue, name)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "MapInArrow" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_themes_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").orderBy("vec_id").collect()
    by = {}
    for i, label, x in rows:
        by.setdefault(label, []).append((i, np.array(x, dtype=float)))
    found = {}
    for k, c, i, _ in catalogue.queries()["theme_clusters"](spark, SF).collect():
        found.setdefault((k, c), set()).add(i)
    for k, v in by.items():
        x = np.array([y for _, y in v])
        for c, members in enumerate(memory.greedy_clusters(x @ x.T, 0.3)):
            held = {v[i][0] for i in members}
            assert found[k, c] <= held and len(found[k, c]) == min(len(held), memory.MAX_MEMBERS)
    small = memory.cohesion_by_blocks(spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", "label"), "label", rows=13).collect()
    pairs = {k: [round(float(a @ b), 6) for n, (_, a) in enumerate(v) for _, b in v[n + 1 :]] for k, v in by.items()}
    assert {k: n for k, _, n in small} == {k: max(v) > 0.97 for k, v in pairs.items()} and all(abs(c - sum(pairs[k]) / len(pairs[k])) < 2e-6 for k, c, _ in small)


def test_consolidated_report(spark):
    x = np.eye(8)
    near = lambda i, j, t: [float(v) for v in (x[i] * t + x[j] * (1 - t * t) ** 0.5)]
    plain = lambda i: [float(v) for v in x[i]]
    log = [(1, 1, 10.0, "cache of a/b.py warms", "db", plain(0)), (1, 2, 11.0, "cache warms again", "db", near(0, 1, 0.9)), (1, 3, 12.0, "alone", "", plain(3)), (1, 4, 13.0, "one covered", "", plain(5)), (1, 5, 14.0, "two covered", "", plain(5)), (1, 6, 1.0, "too old", "", plain(0)), (1, 7, 15.0, "empty", "", [0.0] * 8)]
    entries = spark.createDataFrame([r[:5] for r in log], "project_id long, id long, created_at double, summary string, tags string")
    vectors = spark.createDataFrame([(r[1], r[5]) for r in log], "id long, embedding array<double>")
    decisions = spark.createDataFrame([(1, 70, plain(5)), (2, 71, plain(0))], "project_id long, decision_id long, embedding array<double>")
    files = spark.createDataFrame([(1, "a/b.py"), (1, "c.py")], "project_id long, rel_path string")
    themes, summary = memory.consolidated(entries, vectors, decisions, files, 100.0 + 90 * 86400 - 95)
    assert [(r["topic"], r["members"], r["files"], r["decision_id"], r["cohesion"]) for r in themes.collect()] == [("warms", 2, ["a/b.py"], 70, 0.9)]
    assert [tuple(r) for r in summary.collect()] == [(1, 5, 1, 1)]
