import pytest
from pyspark.sql import functions as F

from quarrykit.functions import paths, text, variables
from quarrykit.operators import briefs, edges, incremental, memory, registry, retrieval
from quarrykit.sources import repository


def one(spark, column, **values):
    # Literal rows are folded by the optimiser, so the value comes from a table.
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("secret", ["ghp_" + "a" * 36, "hvs." + "b" * 24, "AKIA" + "Q" * 16, "xoxb-" + "1" * 12, "sk_live_" + "z" * 24, "postgres://u:" + "pw@host", "-----BEGIN RSA PRIVATE KEY-----\n" + "x\n" * 40 + "-----END RSA PRIVATE KEY-----", "ssh-ed25519 " + "A" * 68])
def test_scrub_is_idempotent(spark, secret):
    once = one(spark, text.scrub(F.col("t")), t=f"before {secret} after")
    assert secret not in once and "CHANGE_ME" in once and once.startswith("before ") and one(spark, text.scrub(F.col("t")), t=once) == once


def test_sensitive_keys_and_assignments(spark):
    assert [one(spark, text.is_sensitive_key(F.col("t")), t=k) for k in ("api-key", "client-secret", "private-key", "name")] == [True, True, True, False]
    assert one(spark, text.scrub_assignments(F.col("t")), t='db_password = "x\\"y" name = "n" token="1"') == 'db_password = "CHANGE_ME" name = "n" token="CHANGE_ME"'


def test_first_lines_lose_blanks_only(spark):
    assert one(spark, text.first_line(F.col("t")), t="\n   \n  2 of 20  \nx") == "2 of 20"
    assert one(spark, text.first_line(F.col("t")), t="0 to 10") == "0 to 10"
    assert one(spark, text.first_body_line(F.col("t")), t="# 1\n 1 + 0 = 1 ") == "1 + 0 = 1"


def test_whitespace(spark):
    assert one(spark, text.compress(F.col("t")), t="a    b\n\n\n  c") == "a^4^b^5^c"
    assert one(spark, text.decompress(F.col("t")), t="a^4^b") == "a    b"


@pytest.mark.parametrize(("path", "want"), [("a/./b/../c", "a/c"), ("../x", None), ("a//b/", "a/b"), ("a/../../b", None)])
def test_normalize(spark, path, want):
    assert one(spark, paths.normalize(F.col("p")), p=path) == want


def test_ignore_rules():
    assert [paths.rerooted(*x) for x in (("secrets.yml", "config"), ("/local.tf", "infra"), ("a/b.txt", "d"), ("!keep.yml", "config"))] == ["config/**/secrets.yml", "infra/local.tf", "d/a/b.txt", "!config/**/keep.yml"]


def test_language_and_flavor(spark):
    assert [one(spark, paths.language(F.col("p")), p=p) for p in ("a/B.PY", "x/Dockerfile", "x.unknown", ".py")] == ["python", "dockerfile", None, None]
    assert [one(spark, paths.yaml_flavor(F.col("p")), p=p) for p in ("k/kustomization.yml", ".github/actions/x/readme.yml", "c/templates/a.tpl", "x/vars/a.yml", "plain.yml")] == ["kustomize", None, "helm_template", "ansible", None]


def test_candidates(spark):
    py = one(spark, edges.python_candidates(F.col("s"), F.col("r"), F.col("y")), s="pkg/sub/m.py", r="..u", y="f")
    assert py == ["pkg/u/f.py", "pkg/u/f/__init__.py", "pkg/u.py", "pkg/u/__init__.py"]
    js = one(spark, edges.js_candidates(F.col("s"), F.col("r")), s="a/b.ts", r="./c")
    assert js[:4] == ["a/c.js", "a/c.jsx", "a/c.ts", "a/c.tsx"] and js[4] == "a/c/index.js" and len(js) == 8
    assert one(spark, edges.js_candidates(F.col("s"), F.col("r")), s="a/b.ts", r="react") == []
    net = one(spark, edges.manifest_candidates(F.col("s"), F.col("r"), F.lit(None), F.col("k")), s="src/App/App.csproj", r="..\\Lib\\Lib.fsproj", k="dotnet_project_reference")
    assert net == ["src/Lib/Lib.fsproj"]


def test_resolution_uses_variables_and_all_files(spark):
    files = spark.createDataFrame([(1, 10, "roles/web/tasks/main.yml"), (1, 11, "tasks/prod.yml")], "project_id int, file_id long, rel_path string")
    raw = [(1, 1, "site.yml", "yaml", "ansible_role_entry", "web", None), (1, 2, "site.yml", "yaml", "ansible_include_tasks", "tasks/{{ env }}.yml", None), (1, 3, "site.yml", "yaml", "ansible_include_tasks", "tasks/{{ other }}.yml", None)]
    e = spark.createDataFrame(raw, "project_id int, edge_id int, source_rel string, lang string, kind string, raw string, symbol string")
    got = {r["edge_id"]: (r["target_file_id"], r["raw"]) for r in edges.resolve(e, files, F.create_map(F.lit("env"), F.lit("prod"))).collect()}
    assert got == {1: (10, "web"), 2: (11, "tasks/{{ env }}.yml"), 3: (None, "tasks/{{ other }}.yml")}


def test_names_resolve_to_their_declarations(spark):
    paths_ = ["net/vars.tf", "net/main.tf", "app/main.tf", "c/Chart.yaml", "c/templates/_h.tpl", "c/templates/x/d.yaml", "c/charts/s/Chart.yaml", "c/charts/s/templates/_h.tpl", "c/charts/s/templates/d.yaml"]
    files = spark.createDataFrame([(1, 10 + i, p) for i, p in enumerate(paths_)], "project_id int, file_id long, rel_path string")
    raw = [(0, "tf_decl", "var.region"), (1, "tf_decl", "local.tags"), (1, "tf_decl", "module.vpc"), (2, "tf_decl", "var.other"), (4, "helm_define", "name"), (7, "helm_define", "name")]
    raw += [(1, "tf_var_ref", "region"), (0, "tf_local_ref", "tags"), (0, "tf_module_ref", "vpc"), (2, "tf_var_ref", "region"), (1, "tf_local_ref", "region"), (5, "helm_include", "name"), (8, "helm_include", "name"), (5, "helm_include", "none")]
    e = spark.createDataFrame([(1, i, paths_[at], "x", kind, text_, None) for i, (at, kind, text_) in enumerate(raw)], "project_id int, edge_id int, source_rel string, lang string, kind string, raw string, symbol string")
    for known in (None, F.create_map(F.lit("env"), F.lit("prod"))):
        got = {r["edge_id"]: r["target_file_id"] for r in edges.resolve(e, files, known).collect()}
        assert got == {6: 10, 7: 11, 8: 11, 9: None, 10: None, 11: 14, 12: 17, 13: None}


def test_manual_variables_win(spark):
    schema = "project_id int, scope string, name string, value string, source string, created_at double, updated_at double"
    held = spark.createDataFrame([(1, "all", "env", "prod", "manual", 1.0, 1.0)], schema)
    new = spark.createDataFrame([(1, "all", "env", "dev", "auto:x", 2.0, 2.0), (1, "all", "n", "1", "auto:x", 2.0, 2.0)], schema)
    assert {(r["name"], r["value"], r["source"], r["created_at"]) for r in variables.upsert(held, new).collect()} == {("env", "prod", "manual", 1.0), ("n", "1", "auto:x", 2.0)}


def test_fusion_order(spark):
    v = spark.createDataFrame([(10, 1), (20, 2)], "chunk_id long, rank int")
    t = spark.createDataFrame([(20, 1), (30, 2)], "chunk_id long, rank int")
    assert [r["chunk_id"] for r in retrieval.fuse(v, t, 10).collect()] == [20, 10, 30]


@pytest.mark.parametrize(("budget", "kept"), [(200, 5), (0, 10), (10, 1)])
def test_budget(spark, budget, kept):
    hits = spark.range(10).withColumnRenamed("id", "chunk_id")
    assert retrieval.within_budget(hits, [F.col("chunk_id")], budget).where("kept").count() == kept


def test_chunk_reuse_is_a_bag_match(spark):
    old = spark.createDataFrame([(1, "h", 1), (1, "h", 2)], "file_id long, content_hash string, chunk_id long")
    new = spark.createDataFrame([(1, "h", 7), (1, "h", 8), (1, "h", 9)], old.schema)
    got = incremental.chunk_reuse(old, new).collect()
    assert sum(r[2] is not None and r[3] is not None for r in got) == 2 and sum(r[2] is None for r in got) == 1


def test_big_split(spark):
    rows = [(1, "x" * 1500), (2, "y" * 5000), (3, "\n".join(["z" * 700] * 5))]
    got = incremental.big_split(spark.createDataFrame(rows, "chunk_id long, stored_text string")).collect()
    parts = {i: [r["text"] for r in sorted(got, key=lambda r: r["part"]) if r["chunk_id"] == i] for i in (1, 2, 3)}
    assert len(parts[1]) == 1 and len(parts[2]) == 1 and [len(p) for p in parts[3]] == [1401, 1401, 700]
    parents = incremental.big_parents(spark.createDataFrame(rows, "chunk_id long, stored_text string")).collect()
    assert [(r["chunk_id"], r["subchunk_count"]) for r in parents] == [(3, 3)]


def test_clusters_by_linkage():
    import numpy as np

    s = np.array([[1, 0.6, 0.1], [0.6, 1, 0.6], [0.1, 0.6, 1]])
    assert memory.greedy_clusters(s) == [[0, 1]] and memory.greedy_clusters(s, linkage="single") == [[0, 1, 2]]


def test_topic_and_coverage(spark):
    said = spark.createDataFrame([(1, 1, "cache postgres"), (1, 2, "cache other"), (1, 3, "postgres thing")], "g int, id long, summary string")
    assert memory.suggest_topic(said, "g").first()["topic"] == "postgres"
    centres = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    none = spark.createDataFrame([], "decision_id long, embedding array<double>")
    assert tuple(memory.coverage(centres, none).first()) == (1, None, 0.0, False)


def test_map_keeps_shallow_files(spark):
    files = spark.createDataFrame([(1, "a/b.py", "python"), (2, "a/c/d.py", "python"), (3, "r.md", "markdown")], "file_id long, rel_path string, lang string")
    chunks = spark.createDataFrame([], "chunk_id long, file_id long, kind string, name string, qualified_name string")
    e = spark.createDataFrame([(1, 2)], "source_file_id long, target_file_id long")
    assert [(r["dir"], r["entrypoint"]) for r in briefs.directory_map(files, chunks, e, 2).collect()] == [("", None), ("a/b.py", None), ("a/c", "a/c/d.py")]


def test_encoder_is_unit_length(spark):
    v = one(spark, retrieval.hashed_encoder(F.col("t")), t="some words in a text")
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-6


def test_long_runs_end(spark):
    texts = ['token = "' + "x" * 1_000_000 + '"', 'token = "' + '\\"' * 100_000 + '"', "a" * 300_000 + "://u:p@h", "eyJ" * 100_000, "^99999999999^ ^3^", "-----BEGIN A PRIVATE KEY-----" * 3000, "1ab://u:p@h x"]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = d.select("i", text.scrub(F.col("t")).alias("s"), text.scrub_assignments(F.col("t")).alias("a"), text.decompress(F.col("t")).alias("d")).orderBy("i").collect()
    assert [got[i]["a"] for i in (0, 1)] == ['token = "CHANGE_ME"'] * 2 and got[2]["s"] == "CHANGE_ME" and got[4]["d"] == "^99999999999^    " and got[6]["s"] == "1CHANGE_ME x"


def test_assignments_of_any_key(spark):
    d = spark.createDataFrame([('1token = "a" my-Secret="b\\"c" name = "d" password = "open',)], "t string")
    assert d.select(text.scrub_assignments(F.col("t"))).first()[0] == '1token = "CHANGE_ME" my-Secret="CHANGE_ME" name = "d" password = "open'


def test_values_that_hold_markers_stay(spark):
    d = spark.createDataFrame([("{{ a }} {{ b }} {{c}}", {"a": "{{ b }}", "b": "x"})], "t string, v map<string,string>")
    r = d.select(variables.substitute(F.col("t"), F.col("v"), "jinja").alias("s")).first()["s"]
    assert (r["text"], r["complete"]) == ("{{ b }} x {{c}}", False)


def test_queries_without_operands(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "chunk_id long, stored_text string").withColumns({"name": F.lit(""), "qualified_name": F.lit("")})
    found = lambda q: {r["chunk_id"] for r in d.where(retrieval.predicate(q)).collect()}
    assert found("a OR") == found("OR a") == found("a AND") == found("(a") == found("a)") == {1} and found("NOT") == found("()") == found("") == set()
    assert found("a) c") == set() and found("a OR NOT a") == {1, 2} and found("NOT a") == {2}


def test_palette_and_free_names(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("external",)], "node_group string")
    assert {r[0]: r[1] for r in edges.palette(nodes).collect()} == {"a": "#d68941", "b": "#5d41d6", "external": "#cccccc"}
    p = spark.createDataFrame([(1, "w", "/a"), (2, "w", "/b"), (3, "w_2", "/c"), (4, "w_3", "/d"), (5, "v", "/e")], "project_id long, name string, root_path string")
    assert registry.next_free_name(p, "w") == "w_4" and registry.next_free_name(p, "v") == "v_2" and registry.selected(p, "/b").first()["project_id"] == 2
    with pytest.raises(registry.AmbiguousProject):
        registry.selected(p, "w")


def test_deep_traversal_stores_its_levels(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "source_file_id long, target_file_id long")
    got = edges.traverse(chain, spark.createDataFrame([(0,)], "file_id long"), 8)
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(9)] and got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3


def test_nested_ignore_files_and_links(spark, tmp_path):
    for name, body in {"repo/a/repo/m.py": "x = 1", "repo/a/.gitignore": "skip.py\n!keep.py\n", "repo/a/b/skip.py": "x", "repo/skip.py": "x", "out/secret.py": "x"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    (tmp_path / "repo" / "link.py").symlink_to(tmp_path / "out" / "secret.py")
    got = repository.walk(spark, str(tmp_path / "repo"))
    assert {r["rel_path"] for r in got.collect()} == {"a/repo/m.py", "skip.py"}
