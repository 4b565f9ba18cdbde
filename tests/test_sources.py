import json

import pytest
import yaml

from quarrykit.sources import chunkers, extractors, parsers, repository
from quarrykit.streaming import staged, windows


def names(chunks):
    return [(c.kind, c.qualified_name) for c in chunks]


def test_python():
    got = parsers.python_chunks("import os\n\n@deco\ndef f():\n    pass\n\nX = 1\n\nclass C:\n    def m(self): ...\n")
    assert names(got) == [("module_level", None), ("function", "f"), ("class", "C")] and got[1].text.startswith("@deco") and got[1].start_line == 3
    assert got[0].text.startswith("import os") and got[0].text.endswith("X = 1")


def test_javascript_and_shell():
    assert names(parsers.javascript_chunks("const a = 1;\nexport function f() { return '}'; }\nclass K { x() {} }\nexport const g = (x) => {\n  return x;\n};\n")) == [("module_level", None), ("function", "f"), ("class", "K"), ("function", "g")]
    assert names(parsers.shell_chunks('set -e\nfoo() {\n  echo "}" # }\n}\nfunction bar {\n  :\n}\nfoo\n')) == [("module_level", None), ("shell_function", "foo"), ("shell_function", "bar")]


def test_hcl():
    got = parsers.hcl_chunks('# x {\nresource "aws_s3" "b" {\n  name = "}"\n  password = "p"\n}\nlocals {\n  a = 1\n  m = {\n    k = 2\n  }\n}\n')
    assert [(c.kind, c.name) for c in got] == [("resource", "aws_s3.b"), ("locals_block", "locals"), ("locals_entry", "a"), ("locals_entry", "m")]
    assert "CHANGE_ME" in got[0].text and got[3].text.count("}") == 1


def test_json_and_yaml():
    got = parsers.json_chunks('{"a": 1, "token": "t", "b": {"secret_key": "s"}}')
    assert [c.name for c in got] == ["a", "token", "b"] and got[1].text == '"token": "CHANGE_ME"' and json.loads(f"{{{got[2].text}}}")["b"]["secret_key"] == "CHANGE_ME"
    assert parsers.json_chunks("nope") == [] and len(parsers.json_chunks("[1]")) == 1
    tasks = "- name: one\n  debug: {}\n- name: two\n  debug: {}\n"
    assert [(c.kind, c.name) for c in parsers.yaml_chunks(tasks, "roles/r/tasks/main.yml")] == [("ansible_task", "one"), ("ansible_task", "two")]
    assert [c.name for c in parsers.yaml_chunks("kind: Pod\nmetadata:\n  name: p\n", "k.yml")] == ["Pod/p"]
    assert "CHANGE_ME" in parsers.yaml_chunks("password: x\n", "values.yaml")[0].text


def test_yaml_loaders_agree():
    def plain(n):
        own = (n.tag, n.start_mark.index, n.start_mark.line, n.end_mark.index)
        return own + (n.value if isinstance(n, yaml.ScalarNode) else tuple(plain(x) if isinstance(n, yaml.SequenceNode) else (plain(x[0]), plain(x[1])) for x in n.value),)

    def read(text, load):
        try:
            return [n and plain(n) for n in load(text)]
        except yaml.YAMLError:
            return "error"

    odd = ["--- ", "a: 1\n---", "?", "{ key:}", "{+' : }", "[" * 90 + "]" * 90, "k: |\n  x\n", "é: ü", "- - a", "a: b: c", "a:\tb", "&a x", "", "# c", "k" * 1030 + ": v"]
    own = ["password: x1\nimage:\n  tag: v1", "- name: one\n  include_role:\n    name: r2\n- x:\n", "a: 'b'\nc: \"d\"\n\n# e\nf:\n- g  # h\n- i\n"]
    for text in odd + own:
        assert read(text, parsers.yaml_nodes) == read(text, lambda t: yaml.compose_all(t, Loader=yaml.SafeLoader)), text
    assert all(parsers._YAML_COMMON.fullmatch(t) and not parsers._YAML_APART.search(t) for t in own)


def test_parsers_use_all_cores(spark):
    files = spark.createDataFrame([(i, f"v{i}/values.yaml", "yaml", "a: 1") for i in range(64)], "file_id long, rel_path string, lang string, content string").coalesce(1)
    for found in (chunkers.parsed(files), extractors.parsed(files)):
        assert found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_dotnet():
    cs = "using System;\nnamespace Demo.App;\n\n[Attr]\npublic class Program { void M() { } }\ninternal record R(int X);\n"
    assert names(parsers.csharp_chunks(cs)) == [("module_level", None), ("class", "Demo.App.Program"), ("record", "Demo.App.R")]
    nested = "namespace A { namespace B { struct S { class I {} } enum E { X } } }"
    assert [n for n in names(parsers.csharp_chunks(nested)) if n[0] != "module_level"] == [("struct", "A.B.S"), ("enum", "A.B.E")]
    vb = "Namespace Demo.Legacy\n  Public Class Thing\n    Sub X()\n    End Sub\n  End Class\n  Module M\n  End Module\nEnd Namespace\n"
    assert [n for n in names(parsers.vb_chunks(vb)) if n[0] != "module_level"] == [("class", "Demo.Legacy.Thing"), ("module", "Demo.Legacy.M")]
    fs = "module Demo.Library\n\nlet add a b =\n    a + b\n\nlet pi = 3\n\ntype T = { X: int }\n"
    assert [n for n in names(parsers.fsharp_chunks(fs, "Library.fs")) if n[0] != "module_level"] == [("module", "Demo.Library"), ("function", "Demo.Library.add"), ("value", "Demo.Library.pi"), ("type", "Demo.Library.T")]
    assert len(parsers.fsharp_chunks("let x = 1\n", "s.fsx")) == 1


def test_native_chunkers(spark):
    f = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny\n### C\nz", "r.md"), (2, "no heading", "r.md")], "file_id long, content string, rel_path string")
    got = sorted((r["file_id"], r["ord"], r["name"], r["start_line"], r["end_line"]) for r in chunkers.markdown(f).collect())
    assert got == [(1, 0, None, 1, 1), (1, 1, "A", 2, 3), (1, 2, "B", 4, 7), (2, 0, None, 1, 1)]
    d = spark.createDataFrame([(1, "ARG x\nFROM a AS build\nRUN y\nfrom b\nRUN z", "Dockerfile")], f.schema)
    assert [(r["name"], r["start_line"], r["end_line"]) for r in chunkers.dockerfile(d).orderBy("ord").collect()] == [("build", 2, 3), ("stage_1", 4, 5)]
    j = spark.createDataFrame([(1, "a {% macro m(x) %}b{% endmacro %} {% block c %}d{% endblock %}", "x.j2"), (2, "{% block open %}", "x.j2")], f.schema)
    assert sorted((r["file_id"], r["kind"], r["name"]) for r in chunkers.jinja(j).collect()) == [(1, "jinja_block", "c"), (1, "jinja_macro", "m"), (2, "jinja_block", None)]


def test_extractors(spark):
    assert extractors.python_edges("import a.b\nfrom ..u import f\ndef g():\n    importlib.import_module('x')\n    import_module(n)\n") == [("import", "a.b", None, 1), ("from_import", "..u", "f", 2), ("dynamic_import", "x", None, 4), ("unresolved", "n", None, 5)]
    tf = extractors.terraform_edges('module "m" {\n  source = "./mod"\n  x = var.a\n  y = var.a\n}\nvariable "a" {}\n', "main.tf")
    assert ("tf_module", "./mod", "m", 1) in tf and ("tf_decl", "var.a", None, 6) in tf and sum(e[0] == "tf_var_ref" for e in tf) == 1
    gha = extractors.yaml_edges("jobs:\n  a:\n    uses: ./.github/workflows/b.yml\n    steps:\n    - uses: actions/checkout@v4\n    - uses: ./.github/actions/x\n", "gha_workflow")
    assert [e[:2] for e in gha] == [("gha_uses_workflow", "./.github/workflows/b.yml"), ("gha_uses_external", "actions/checkout@v4"), ("gha_uses_action", "./.github/actions/x")]
    ansible = extractors.yaml_edges("- hosts: all\n  roles:\n  - web\n  - role: db\n  tasks:\n  - include_role:\n      name: r\n      tasks_from: t\n  - import_tasks: x.yml\n", "ansible")
    assert {e[:3] for e in ansible} == {("ansible_role_entry", "web", None), ("ansible_role_entry", "db", None), ("ansible_include_role", "r", "t"), ("ansible_import_tasks", "x.yml", None)}
    f = spark.createDataFrame([(1, "import x from './a'\nconst y = require('b')\nawait import('./c')", "m.js", "javascript"), (2, '<ProjectReference Include="../Lib/L.csproj;../O/O.vbproj" /><ProjectReference include="$(X)/a.csproj"/>', "a.csproj", "msbuild")], "file_id long, content string, rel_path string, lang string")
    got = {(r["file_id"], r["kind"], r["raw"]) for r in extractors.edges(f).collect()}
    assert got == {(1, "import", "./a"), (1, "require", "b"), (1, "dynamic_import", "./c"), (2, "dotnet_project_reference", "../Lib/L.csproj"), (2, "dotnet_project_reference", "../O/O.vbproj"), (2, "unresolved", "$(X)/a.csproj")}


def test_repository_to_index(spark, tmp_path):
    for name, body in {"src/App/App.csproj": '<ProjectReference Include="..\\Lib\\Lib.fsproj" />', "src/Lib/Lib.fsproj": "<Project/>", "a.py": "x = 'AKIA" + "Q" * 16 + "'\n", "build/skip.py": "x = 1", "notes.txt": "n"}.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    files = repository.walk(spark, str(tmp_path / "repo"))
    assert {r["rel_path"] for r in files.collect()} == {"src/App/App.csproj", "src/Lib/Lib.fsproj", "a.py"}
    chunks, raw = repository.index(files)
    assert "AKIA" not in "".join(r["stored_text"] for r in chunks.collect())
    assert [r["raw"] for r in raw.collect()] == ["..\\Lib\\Lib.fsproj"]


def test_staged_ingest_is_exactly_once(spark, tmp_path):
    def lines(name, *rows):
        (tmp_path / "staged").mkdir(exist_ok=True)
        (tmp_path / "staged" / name).write_text("\n".join(rows) + "\n")

    def run():
        staged.ingest(spark, *(str(tmp_path / d) for d in ("staged", "history", "rejected", "checkpoint"))).awaitTermination(120)
        return [spark.read.parquet(str(tmp_path / d)).count() for d in ("history", "rejected")]

    lines("a.jsonl", '{"short": "s", "long": "l"}', "broken", '{"short": " ", "long": "l"}')
    assert run() == [1, 2]
    lines("b.jsonl", '{"short": "t", "long": "token ghp_' + "a" * 40 + '"}')
    assert run() == [2, 2] and run() == [2, 2]
    assert "ghp_" not in "".join(r["long_summary"] for r in spark.read.parquet(str(tmp_path / "history")).collect())


def test_outbox_and_streamed_windows(spark, tmp_path):
    box = spark.createDataFrame([(1, '{"kind": "decision", "payload": "{}"}'), (1, '{"kind": "decision", "payload": "{}"}'), (2, '{"kind": "odd", "payload": "{}"}'), (3, "{")], "event_id long, value string")
    good, dead = staged.drained(box, ["decision"])
    assert good.count() == 1 and dead.count() == 2
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", __import__("pyspark.sql.functions", fromlist=["x"]).col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = windows.tumbling(stream, "1 hour", late="10 minutes").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hours").count() == windows.tumbling(events, "1 hour").count()


def test_build_and_lock(spark, tmp_path):
    for name, body in {"src/App/App.csproj": '<ProjectReference Include="..\\Lib\\Lib.fsproj" />', "src/Lib/Lib.fsproj": "<Project/>", "pkg/a.py": "from .b import f\n", "pkg/b.py": "def f():\n    pass\n"}.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    out = repository.build(spark, str(tmp_path / "repo"), 7)
    path = {r["file_id"]: r["rel_path"] for r in out["files"].collect()}
    assert {(path[r["source_file_id"]], path.get(r["target_file_id"])) for r in out["edges"].collect()} == {("src/App/App.csproj", "src/Lib/Lib.fsproj"), ("pkg/a.py", "pkg/b.py")}
    assert out["vectors"].count() == out["chunks"].count() >= 4 and {r[0] for r in out["chunks"].select("project_id").distinct().collect()} == {7}
    with repository.only_writer(spark, str(tmp_path), 7):
        with pytest.raises(repository.Busy), repository.only_writer(spark, str(tmp_path), 7):
            pass
        with repository.only_writer(spark, str(tmp_path), 8):
            pass
    with repository.only_writer(spark, str(tmp_path), 7):
        pass
