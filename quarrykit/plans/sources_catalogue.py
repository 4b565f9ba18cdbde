"""Named queries of the chunkers, extractors and resolvers, on files made from the parts, and of the index around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import paths, variables
from quarrykit.operators import briefs, cache, edges, incremental, memory, registry, retrieval
from quarrykit.plans import adapters as A
from quarrykit.plans.catalogue import query
from quarrykit.sources import chunkers, extractors, inventory, repository
from quarrykit.streaming import staged

#: ``{k}`` is a part's key and ``{n}`` the next one's; the same templates make the texts on both sides.
_K, _N = "CAST(p_partkey AS VARCHAR)", "CAST(p_partkey + 1 AS VARCHAR)"


def _sql_text(template: str) -> str:
    """A template as a DuckDB expression over ``part``."""
    quoted = template.replace("'", "''").replace("\n", "' || chr(10) || '")
    return "('" + quoted.replace("{k}", f"' || {_K} || '").replace("{n}", f"' || {_N} || '") + "')"


def _text(template: str) -> Column:
    """A template as a column over ``part``."""
    out = F.replace(F.lit(template), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return F.replace(out, F.lit("{n}"), (F.col("p_partkey") + 1).cast("string"))


def _files(spark, sf_dir, *made: tuple[str, str, str]) -> DataFrame:
    """(project_id, file_id, rel_path, lang, content): for each part a file of each (lang, path, content); ids are key times count plus place."""
    p = A.table(spark, sf_dir, "part").select("p_partkey")
    out = None
    for i, (lang, path, content) in enumerate(made):
        own = p.select(F.lit(1).alias("project_id"), (F.col("p_partkey") * len(made) + i).cast("long").alias("file_id"), _text(path).alias("rel_path"), F.lit(lang).alias("lang"), _text(content).alias("content"))
        out = own if out is None else out.unionByName(own)
    return out


def _raw(files: DataFrame) -> DataFrame:
    """Raw edges of files with what resolution reads."""
    # Not broadcast: the files are many times the table that they are made from.
    e = extractors.edges(files).join(files.select("project_id", "file_id", F.col("rel_path").alias("source_rel"), "lang").hint("merge"), "file_id")
    return e.withColumn("edge_id", F.xxhash64("file_id", "kind", "raw", "symbol", "line")).withColumnRenamed("file_id", "source_file_id")


def _resolved(files: DataFrame, **given) -> DataFrame:
    out = edges.resolve(_raw(files), files.select("project_id", "file_id", "rel_path"), **given)
    return out.select("source_file_id", "kind", "raw", "symbol", "target_file_id")


def _edges_sql(*rows: tuple[str, str, str, str, str]) -> str:
    """Expected edges: (source id, kind, raw template, symbol template or '', target id or NULL); ``q`` is the next part, if there is one."""
    one = lambda source, kind, raw, symbol, target: f"SELECT {source} AS source_file_id, '{kind}' AS kind, {_sql_text(raw)} AS raw, {_sql_text(symbol) if symbol else 'CAST(NULL AS VARCHAR)'} AS symbol, CAST({target} AS BIGINT) AS target_file_id FROM p"
    return "WITH p AS (SELECT a.p_partkey, b.p_partkey AS q FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1) " + " UNION ALL ".join(one(*r) for r in rows)


# Chunks.


def _chunks(files: DataFrame) -> DataFrame:
    return chunkers.chunk(files).select("file_id", "kind", "name", "start_line", "end_line", "text")


def _chunks_sql(*rows: tuple[str, str, str, int, int, str]) -> str:
    """Expected chunks: (file id, kind, name template or '', first line, last line, text template)."""
    return " UNION ALL ".join(f"SELECT {i} AS file_id, '{kind}' AS kind, {_sql_text(name) if name else 'CAST(NULL AS VARCHAR)'} AS name, {a} AS start_line, {z} AS end_line, {_sql_text(text)} AS text FROM part" for i, kind, name, a, z, text in rows)


_DOCKER = "ARG x\nFROM base:{k} AS build\nRUN make {k}\nfrom scratch\nCOPY . /{k}"


@query(_chunks_sql(("p_partkey", "dockerfile_stage", "build", 2, 3, "FROM base:{k} AS build\nRUN make {k}"), ("p_partkey", "dockerfile_stage", "stage_1", 4, 5, "from scratch\nCOPY . /{k}")))
def dockerfile_stages(spark, sf_dir):
    return _chunks(_files(spark, sf_dir, ("dockerfile", "d{k}/Dockerfile", _DOCKER)))


@query(_chunks_sql(("p_partkey", "jinja_block", "b{k}", 1, 1, "{% block b{k} %}x{% endblock %}"), ("p_partkey", "jinja_macro", "m", 2, 3, "{% macro m(x) %}y\n{{ x }}{% endmacro %}")))
def jinja_blocks(spark, sf_dir):
    return _chunks(_files(spark, sf_dir, ("jinja", "t/x{k}.j2", "a {% block b{k} %}x{% endblock %}\n{% macro m(x) %}y\n{{ x }}{% endmacro %}")))


@query(_chunks_sql(("p_partkey", "msbuild_project", "P{k}", 1, 3, "<Project>\n<A>{k}</A>\n</Project>")))
def msbuild_projects(spark, sf_dir):
    return _chunks(_files(spark, sf_dir, ("msbuild", "src/P{k}.csproj", "<Project>\n<A>{k}</A>\n</Project>")))


@query(_chunks_sql(("p_partkey", "json_object", "a", 1, 1, '"a": {k}'), ("p_partkey", "json_object", "token", 2, 2, '"token": "CHANGE_ME"'), ("p_partkey", "json_object", "b", 3, 3, '"b": {"secret_key": "CHANGE_ME", "c": "{n}"}')))
def json_keys_scrubbed(spark, sf_dir):
    return _chunks(_files(spark, sf_dir, ("json", "j/x{k}.json", '{"a": {k},\n "token": "t{k}",\n "b": {"secret_key": "s{k}", "c": "{n}"}}')))


@query(_chunks_sql(("p_partkey", "helm_values_section", "password", 1, 1, "password: CHANGE_ME"), ("p_partkey", "helm_values_section", "image", 2, 3, "image:\n  tag: v{k}")))
def yaml_values_scrubbed(spark, sf_dir):
    # A node may end where the next one begins, so blank ends are cut.
    out = _chunks(_files(spark, sf_dir, ("yaml", "c{k}/values.yaml", "password: x{k}\nimage:\n  tag: v{k}")))
    return out.withColumn("text", F.rtrim("text"))


@query(_chunks_sql(("p_partkey", "resource", "aws_s3.b{k}", 1, 3, 'resource "aws_s3" "b{k}" {\n  password = "CHANGE_ME"\n}'), ("p_partkey", "variable", "v{k}", 4, 4, 'variable "v{k}" {}')))
def hcl_blocks_scrubbed(spark, sf_dir):
    return _chunks(_files(spark, sf_dir, ("hcl", "i{k}/main.tf", 'resource "aws_s3" "b{k}" {\n  password = "p{k}"\n}\nvariable "v{k}" {}')))


_CODE = {
    "python": ("m{k}.py", "import os\n\ndef f{k}(x):\n    return x\n\nclass C{k}:\n    def m(self): ...\n", (("function", "f{k}"), ("class", "C{k}"))),
    "javascript": ("m{k}.js", "const a = 1;\nexport function f{k}() { return '}'; }\nclass K{k} { x() {} }\n", (("function", "f{k}"), ("class", "K{k}"))),
    "shell": ("m{k}.sh", 'set -e\nfoo{k}() {\n  echo "}" # }\n}\nfunction bar {\n  :\n}\n', (("shell_function", "foo{k}"), ("shell_function", "bar"))),
    "csharp": ("M{k}.cs", "using System;\nnamespace Demo.App;\n\npublic class P{k} { void M() { } }\n", (("class", "Demo.App.P{k}"),)),
    "fsharp": ("L{k}.fs", "module Demo.L{k}\n\nlet add a b =\n    a + b\n\ntype T = { X: int }\n", (("module", "Demo.L{k}"), ("function", "Demo.L{k}.add"), ("type", "Demo.L{k}.T"))),
    "visual_basic": ("V{k}.vb", "Namespace Demo.Old\n  Public Class T{k}\n    Sub X()\n    End Sub\n  End Class\nEnd Namespace\n", (("class", "Demo.Old.T{k}"),)),
}


def _code_sql() -> str:
    return " UNION ALL ".join(f"SELECT CAST(p_partkey * {len(_CODE)} + {i} AS BIGINT) AS file_id, '{lang}' AS lang, '{kind}' AS kind, {_sql_text(name)} AS qualified_name FROM part" for i, (lang, (*_, own)) in enumerate(_CODE.items()) for kind, name in own)


@query(_code_sql())
def code_symbols(spark, sf_dir):
    files = _files(spark, sf_dir, *((lang, path, content) for lang, (path, content, _) in _CODE.items()))
    return chunkers.chunk(files).where("kind <> 'module_level'").join(files.select("file_id", "lang"), "file_id").select("file_id", "lang", "kind", "qualified_name")


# Edges of each language, extracted and resolved.


@query(_edges_sql(("p_partkey", "import", "os", "", "NULL"), ("p_partkey", "from_import", ".m{n}", "f", "q"), ("p_partkey", "from_import", "pkg", "m{k}", "p_partkey"), ("p_partkey", "dynamic_import", "pkg.m{n}", "", "q"), ("p_partkey", "unresolved", "name", "", "NULL")))
def python_references(spark, sf_dir):
    body = "import os\nfrom .m{n} import f\nfrom pkg import m{k}\nimportlib.import_module('pkg.m{n}')\nimport_module(name)\n"
    return _resolved(_files(spark, sf_dir, ("python", "pkg/m{k}.py", body)))


@query(_edges_sql(("p_partkey", "import", "./a{n}", "", "q"), ("p_partkey", "require", "lodash", "", "NULL"), ("p_partkey", "unresolved", "name", "", "NULL"), ("p_partkey", "dynamic_import", "./a{k}.js", "", "p_partkey")))
def javascript_references(spark, sf_dir):
    body = "import x from './a{n}'\nconst y = require('lodash')\nconst z = require(name)\nawait import('./a{k}.js')"
    return _resolved(_files(spark, sf_dir, ("javascript", "src/a{k}.js", body)))


@query(_edges_sql(("p_partkey * 2", "tf_module", "../mod{n}", "n", "q * 2"), ("p_partkey * 2", "tf_var_ref", "v", "", "p_partkey * 2 + 1"), ("p_partkey * 2", "tf_module_ref", "n", "", "p_partkey * 2"), ("p_partkey * 2", "tf_templatefile", "t{k}.tpl", "", "NULL")))
def terraform_references(spark, sf_dir):
    body = 'module "n" {\n  source = "../mod{n}"\n  v = var.v\n}\noutput "o" {\n  value = module.n\n  t = templatefile("t{k}.tpl", {})\n}\n'
    return _resolved(_files(spark, sf_dir, ("hcl", "mod{k}/first.tf", body), ("hcl", "mod{k}/vars.tf", 'variable "v" {}\n')))


@query(_edges_sql(("p_partkey * 2", "helm_dependency", "file://../c{n}", "sub", "q * 2"), ("p_partkey * 2 + 1", "helm_include", "h{k}", "", "p_partkey * 2 + 1")))
def helm_references(spark, sf_dir):
    return _resolved(_files(spark, sf_dir, ("yaml", "c{k}/Chart.yaml", "name: c{k}\ndependencies:\n- name: sub\n  repository: file://../c{n}\n"), ("yaml", "c{k}/templates/_h.yaml", '{{- define "h{k}" }}x{{ end }}\n{{ include "h{k}" . }}\n')))


@query(_edges_sql(("p_partkey * 2", "argocd_app_source", "c{n}", "app{k}", "q * 2 + 1")))
def argocd_references(spark, sf_dir):
    return _resolved(_files(spark, sf_dir, ("yaml", "apps/a{k}.yaml", "kind: Application\nmetadata:\n  name: app{k}\nspec:\n  source:\n    path: c{n}\n"), ("yaml", "c{k}/Chart.yaml", "name: c{k}\n")))


@query(_edges_sql(("p_partkey * 2", "ansible_include_role", "r{n}", "", "q * 2"), ("p_partkey * 2", "ansible_import_tasks", "x.yml", "", "NULL"), ("p_partkey * 2", "ansible_module", "mod{k}", "", "p_partkey * 2 + 1")))
def ansible_references(spark, sf_dir):
    body = "- name: one\n  include_role:\n    name: r{n}\n- import_tasks: x.yml\n- name: two\n  mod{k}:\n    a: 1\n- name: three\n  gone{k}:\n    a: 1\n"
    return _resolved(_files(spark, sf_dir, ("yaml", "roles/r{k}/tasks/main.yml", body), ("python", "library/mod{k}.py", "x = 1\n")))


@query(_edges_sql(("p_partkey * 2", "gha_uses_workflow", "./.github/workflows/w{n}.yml", "", "q * 2"), ("p_partkey * 2", "gha_uses_external", "actions/checkout@v4", "", "NULL"), ("p_partkey * 2", "gha_uses_action", "./.github/actions/x{k}", "", "p_partkey * 2 + 1")))
def workflow_references(spark, sf_dir):
    body = "jobs:\n  a:\n    uses: ./.github/workflows/w{n}.yml\n  b:\n    steps:\n    - uses: actions/checkout@v4\n    - uses: ./.github/actions/x{k}\n"
    return _resolved(_files(spark, sf_dir, ("yaml", ".github/workflows/w{k}.yml", body), ("yaml", ".github/actions/x{k}/action.yml", "name: x\n")))


@query(_edges_sql(("p_partkey * 2", "kustomize_resource", "../k{n}", "", "q * 2"), ("p_partkey * 2", "kustomize_resource", "d.yaml", "", "p_partkey * 2 + 1"), ("p_partkey * 2", "kustomize_patch", "gone.yaml", "", "NULL")))
def kustomize_references(spark, sf_dir):
    return _resolved(_files(spark, sf_dir, ("yaml", "k{k}/kustomization.yaml", "resources:\n- ../k{n}\n- d.yaml\npatches:\n- path: gone.yaml\n"), ("yaml", "k{k}/d.yaml", "a: 1\n")))


@query(_edges_sql(("p_partkey", "dotnet_project_reference", "..\\P{n}\\P{n}.csproj", "", "q"), ("p_partkey", "unresolved", "$(X)/a.csproj", "", "NULL")))
def msbuild_projects_resolved(spark, sf_dir):
    return _resolved(_files(spark, sf_dir, ("msbuild", "src/P{k}/P{k}.csproj", '<ProjectReference Include="..\\P{n}\\P{n}.csproj;$(X)/a.csproj" />')))


_VARIABLES = {"env": "prod", "team": "core"}


def _marked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(edges, files): templated references, one variable of which is unknown for every third part."""
    files = _files(spark, sf_dir, ("yaml", "prod/core/d{k}.yml", "a: 1\n"))
    raw = F.concat(F.lit("/{{ env }}/"), F.when(F.col("file_id") % 3 == 0, "{{ who }}").otherwise("{{ team }}"), F.lit("/d"), F.col("file_id").cast("string"), F.lit(".yml"))
    e = files.select("project_id", F.col("file_id").alias("edge_id"), F.col("file_id").alias("source_file_id"), F.col("rel_path").alias("source_rel"), "lang", F.lit("ansible_include_vars").alias("kind"), raw.alias("raw"), F.lit(None).cast("string").alias("symbol"), F.lit(1).alias("line"))
    return e, files.select("project_id", "file_id", "rel_path")


@query("SELECT p_partkey AS edge_id, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS target_file_id, (SELECT count(*) FROM part WHERE p_partkey % 3 <> 0) AS updated, (SELECT count(*) FROM part WHERE p_partkey % 3 = 0) AS still_parametric FROM part")
def variables_reresolved(spark, sf_dir):
    e, files = _marked(spark, sf_dir)
    values = F.create_map(*(F.lit(x) for pair in _VARIABLES.items() for x in pair))
    out, counts = edges.reresolved(e.withColumn("target_file_id", F.lit(None).cast("long")), files, values)
    return out.select("edge_id", "target_file_id").crossJoin(F.broadcast(counts))  # one row


# Inventories and settings.

_CFG = "[defaults]\nroles_path = ./roles:shared/r{k}\ninventory=inv/hosts\n; roles_path = no\n[other]\nroles_path = wrong\n"


@query(f"""SELECT 1 AS project_id, 'a' || {_K} AS cfg_dir, key, value FROM part, (VALUES ('roles_path', NULL), ('inventory', 'inv/hosts')) v(key, fixed), LATERAL (SELECT coalesce(fixed, './roles:shared/r' || {_K}) AS value)""")
def ansible_settings(spark, sf_dir):
    return inventory.settings(_files(spark, sf_dir, ("ini", "a{k}/ansible.cfg", _CFG)))


@query(f"""WITH d AS (SELECT p_partkey, 'a' || {_K} AS c, 'shared/r' || {_K} AS s FROM part) SELECT 1 AS project_id, c || '/roles' AS dir FROM d UNION ALL SELECT 1, c || '/' || s FROM d""")
def ansible_role_paths(spark, sf_dir):
    return inventory.search_paths(inventory.settings(_files(spark, sf_dir, ("ini", "a{k}/ansible.cfg", _CFG))), "roles_path", "roles").select("project_id", "dir")


@query(f"""SELECT 1 AS project_id, 'group_vars' AS source, 'g' || {_K} AS name, 'play' AS value FROM part UNION ALL SELECT 1, 'group_vars', 'on' || {_K}, 'true' FROM part UNION ALL SELECT 1, 'group_vars', 'nil' || {_K}, '' FROM part UNION ALL SELECT 1, 'host_vars', 'g' || {_K}, {_K} FROM part""")
def inventory_variables(spark, sf_dir):
    cfg = ("ini", "a{k}/ansible.cfg", "[defaults]\ninventory = ./inv\n")
    low = ("yaml", "a{k}/inv/group_vars/all.yml", "g{k}: low\non{k}: yes\n")
    high = ("yaml", "a{k}/group_vars/all/x.yml", "g{k}: play\nnil{k}:\nlist{k}: [1]\n")
    host = ("yaml", "a{k}/host_vars/web.yml", "g{k}: {k}\n")
    vault = ("yaml", "a{k}/host_vars/sealed.yml", "$ANSIBLE_VAULT;1.1\ns{k}: x\n")
    files = _files(spark, sf_dir, cfg, low, high, host, vault)
    return inventory.variables(files, inventory.settings(files))


# The index: scope, families, listings, deletions, updates.


@query(f"""WITH {A.CHUNKS_SQL}, {A.PARTS_SQL} SELECT chunk_id, name FROM chunks WHERE kind = (SELECT min(p_type) FROM part) AND file_id IN (SELECT file_id FROM pfiles WHERE project_id = 1 AND lang = (SELECT max(p_type) FROM part))""")
def scoped_chunks(spark, sf_dir):
    c = A.chunks(spark, sf_dir)
    kind, lang = c.agg(F.min("kind"), F.max("kind")).first()
    return retrieval.scoped(c, A.parts_as_files(spark, sf_dir), 1, kind, lang).select("chunk_id", "name")


@query("SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 10 = 0 THEN -1 ELSE CAST(p_partkey % 10 AS INTEGER) END AS place FROM part WHERE p_partkey BETWEEN 20 AND 29")
def chunk_family(spark, sf_dir):
    c = A.chunks(spark, sf_dir)
    parent = F.col("chunk_id") % 10 == 0
    c = c.withColumns({"parent_id": F.when(~parent, F.col("chunk_id") - F.col("chunk_id") % 10), "kind": F.when(parent, "big_parent").otherwise("big_subchunk"), "sibling_order": (F.col("chunk_id") % 10).cast("int")})
    return retrieval.family(c, 23).select("chunk_id", "place")


@query(f"""WITH {A.CHUNKS_SQL}, {A.PARTS_SQL} SELECT chunk_id, rel_path || ':' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) || ' ' || qualified_name AS citation FROM chunks JOIN pfiles USING (file_id)""")
def cited_chunks(spark, sf_dir):
    c = A.chunks(spark, sf_dir)
    return retrieval.citations(c, c, A.parts_as_files(spark, sf_dir)).select("chunk_id", "citation")


@query(f"""WITH {A.EDGES_SQL}, {A.PARTS_SQL} SELECT edge_id, s.rel_path AS source_rel, t.rel_path AS target_rel, count(*) AS n FROM edges e JOIN pfiles s ON s.file_id = source_file_id LEFT JOIN pfiles t ON t.file_id = target_file_id GROUP BY 1, 2, 3""")
def edges_listed(spark, sf_dir):
    return edges.listed(A.edges(spark, sf_dir), A.parts_as_files(spark, sf_dir)).groupBy("edge_id", "source_rel", "target_rel").agg(F.count("*").alias("n"))


@query(f"""WITH {A.EDGES_SQL}, {A.PARTS_SQL}, l AS (SELECT e.*, s.rel_path AS source_rel, t.rel_path AS target_rel FROM edges e JOIN pfiles s ON s.file_id = source_file_id LEFT JOIN pfiles t ON t.file_id = target_file_id)
SELECT DISTINCT 'forward' AS direction, 1 AS hop, source_rel, kind, raw, target_rel FROM l WHERE source_file_id = 7 UNION SELECT DISTINCT 'reverse', 1, source_rel, kind, raw, target_rel FROM l WHERE target_file_id = 7""")
def relations_around(spark, sf_dir):
    f = A.parts_as_files(spark, sf_dir)
    return edges.relations(A.edges(spark, sf_dir), f, f.where("file_id = 7").first()["rel_path"])


@query(f"""WITH {A.PARTS_SQL}, me AS (SELECT rel_path FROM pfiles WHERE file_id = 7) SELECT 'sibling' AS direction, f.rel_path AS target_rel FROM pfiles f, me WHERE split_part(f.rel_path, '/', 1) = split_part(me.rel_path, '/', 1) AND f.rel_path <> me.rel_path ORDER BY f.rel_path LIMIT 50""")
def relations_of_lone_file(spark, sf_dir):
    f = A.parts_as_files(spark, sf_dir)
    return edges.relations(A.edges(spark, sf_dir), f, f.where("file_id = 7").first()["rel_path"], kinds=["no such kind"]).select("direction", "target_rel")


@query(f"""WITH {A.EDGES_SQL} SELECT 'file:' || CAST(source_file_id AS VARCHAR) AS source_key, CASE WHEN target_file_id IS NOT NULL THEN 'file:' || CAST(target_file_id AS VARCHAR) WHEN raw LIKE '%{{{{%' THEN 'parametric:' || raw WHEN kind = 'unresolved' THEN 'unresolved:' || raw ELSE 'external:' || raw END AS target_key, kind, count(*) AS n FROM edges GROUP BY 1, 2, 3""")
def graph_edges(spark, sf_dir):
    return edges.graph_edges(A.edges(spark, sf_dir))


@query(f"""WITH {A.PARTS_SQL} SELECT 'file:' || CAST(file_id AS VARCHAR) AS node_key, rel_path AS label, split_part(rel_path, '/', 1) AS node_group, 'dot' AS shape FROM pfiles""")
def graph_with_orphans(spark, sf_dir):
    return edges.graph(A.edges(spark, sf_dir).limit(0), A.parts_as_files(spark, sf_dir), orphans=True)


@query(f"""SELECT rel_path, cicd FROM (SELECT '.github/workflows/w' || {_K} || '.yml' AS rel_path, true AS cicd FROM part UNION ALL SELECT '.github/actions/a' || {_K} || '/action.yaml', true FROM part UNION ALL SELECT 'x/.github/workflows/w' || {_K} || '.yml', false FROM part UNION ALL SELECT '.github/w' || {_K} || '.yml', false FROM part)""")
def cicd_paths(spark, sf_dir):
    made = [("yaml", p, "") for p in (".github/workflows/w{k}.yml", ".github/actions/a{k}/action.yaml", "x/.github/workflows/w{k}.yml", ".github/w{k}.yml")]
    return _files(spark, sf_dir, *made).select("rel_path", paths.is_cicd(F.col("rel_path")).alias("cicd"))


@query(f"""WITH {A.PARTS_SQL}, d AS (SELECT rel_path AS dir, count(*) AS file_count FROM pfiles WHERE rel_path LIKE 'Brand_11/%' GROUP BY 1) SELECT dir, file_count, (SELECT count(*) > 5 FROM d) AS truncated FROM d ORDER BY dir LIMIT 5""")
def dir_map_below(spark, sf_dir):
    f, c = A.parts_as_files(spark, sf_dir), A.chunks(spark, sf_dir)
    return briefs.capped_map(briefs.directory_map(f, c, A.edges(spark, sf_dir), 2, "Brand_11"), 5).select("dir", "file_count", "truncated")


@query("SELECT p_partkey AS chunk_id, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE p_name END AS name FROM part WHERE p_partkey % 3 <> 0")
def rows_updated_and_deleted(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("name"))
    put = p.where("chunk_id % 4 = 0").select("chunk_id", F.lit("x").alias("name"))
    return incremental.without(incremental.updated(p, put, ["chunk_id"]), p.where("chunk_id % 3 = 0"), ["chunk_id"])


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) AS ids, true AS rebuild, false AS same FROM part")
def ids_and_rebuild(spark, sf_dir):
    p = incremental.stable_ids(A.table(spark, sf_dir, "part"), "p_partkey")
    meta = spark.createDataFrame([("schema", "1"), ("model", "a")], "key string, value string")
    told = [incremental.needs_rebuild(meta, want).select(F.col("rebuild").alias(n)) for want, n in (({"schema": "2", "gone": "x"}, "rebuild"), ({"schema": "1"}, "same"))]
    return p.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).crossJoin(F.broadcast(told[0])).crossJoin(F.broadcast(told[1]))  # one row each


@query("SELECT doc_id AS file_id, text[1:100] AS text FROM documents WHERE text <> ''")
def slices_of_files(spark, sf_dir):
    f = A.files(spark, sf_dir).withColumnRenamed("stored_text", "content").where("content <> ''")
    spans = f.select("file_id", F.lit(0).alias("start_byte"), F.octet_length(F.substring("content", 1, 100)).alias("end_byte"))
    return repository.reslice(f, spans).select("file_id", "text")


@query("""SELECT doc_id % 4 AS part, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' WHEN 2 THEN 'deleted' ELSE 'unchanged' END AS state, count(*) AS files, CAST(sum(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 2 END) AS BIGINT) AS chunks, CAST(sum(CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS fresh FROM documents GROUP BY 1, 2""")
def index_updated(spark, sf_dir):
    """Of four kinds of files one each is new, changed, deleted and unchanged; a changed file has one new chunk of two."""
    d = A.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("file_id"))
    path, part = F.concat(F.lit("d"), F.col("file_id").cast("string")), F.col("file_id") % 4
    files = lambda rows, version: rows.select("file_id", path.alias("rel_path"), F.sha2(F.concat_ws("/", path, F.when(part == 1, version).otherwise("0")), 256).alias("content_hash"), F.lit(float(version)).alias("mtime"))
    chunks = lambda rows, version: rows.select("file_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).select("file_id", F.xxhash64("file_id", "ord").alias("chunk_id"), F.sha2(F.concat_ws("/", F.col("file_id").cast("string"), F.when((part == 1) & (F.col("ord") == 0), F.lit(f"v{version}")).otherwise(F.col("ord").cast("string"))), 256).alias("content_hash"))
    old, new = d.where(part != 0), d.where(part != 2)
    out_files, out_chunks, states = incremental.update(files(old, 1), chunks(old, 1), files(new, 2), chunks(new, 2))
    per = out_chunks.groupBy("file_id").agg(F.count_distinct("chunk_id").alias("c"), F.count_if("fresh").alias("f"))
    every = d.select("file_id", path.alias("rel_path")).join(states, "rel_path").join(per, "file_id", "left").join(out_files.select("file_id", "mtime"), "file_id", "left")
    return every.groupBy((F.col("file_id") % 4).alias("part"), "state").agg(F.count("*").alias("files"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("f"), F.lit(0)).alias("fresh"))


# Variables.


@query("SELECT p_partkey AS id, p_partkey % 2 = 0 AS kept_scope, true AS kept_name, p_partkey % 3 = 0 AS kept_manual FROM part")
def variables_unset(spark, sf_dir):
    held = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "all").otherwise("dev").alias("scope"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "manual").otherwise("auto").alias("source"))
    kept = lambda df, name: df.select("id", F.lit(True).alias(name))
    out = held.select("id")
    for df, name in ((variables.unset(held, scope="dev"), "kept_scope"), (variables.unset(held, name="none"), "kept_name"), (variables.unset(held, automatic=True), "kept_manual")):
        out = out.join(kept(df, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


# Projects and the answer cache.


@query("""SELECT CAST(p_size AS VARCHAR) AS name, count(*) AS n, min('/w/' || CAST(p_partkey AS VARCHAR)) AS root_path FROM part GROUP BY 1""")
def projects_registered(spark, sf_dir):
    """Clones of one remote are one project, under their first path."""
    p = A.table(spark, sf_dir, "part")
    root = F.concat(F.lit("/w/"), F.col("p_partkey").cast("string"))
    roots = p.select(F.col("p_size").cast("string").alias("name"), root.alias("root_path"), F.concat(F.lit("git@Host.org:team/"), F.col("p_size").cast("string"), F.lit(".git")).alias("git_remote"))
    none = spark.createDataFrame([], "project_id long, name string, root_path string, git_remote string, remote_key string, created_at double")
    once = registry.registered(none, roots, 1.0)
    again = registry.registered(once, roots, 2.0)
    return again.join(roots.groupBy("name").agg(F.count("*").alias("n")), "name").select("name", "n", "root_path")


@query("""SELECT n_nationkey AS project_id, n_name AS name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS file_count, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS chunk_count FROM nation""")
def project_counts(spark, sf_dir):
    t = lambda n: A.table(spark, sf_dir, n)
    return registry.counts(t("nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name")), t("customer").select(F.col("c_nationkey").alias("project_id")), t("supplier").select(F.col("s_nationkey").alias("project_id")))


@query("""SELECT (SELECT count(*) FROM customer WHERE c_nationkey <> 7) AS files, (SELECT count(*) FROM supplier WHERE s_nationkey <> 7) AS chunks, (SELECT count(*) FROM supplier WHERE s_nationkey <> 7) AS vectors""")
def project_removed(spark, sf_dir):
    s = A.table(spark, sf_dir, "supplier")
    tables = {"files": A.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id")), "chunks": s.select(F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("chunk_id")), "vectors": s.select(F.col("s_suppkey").alias("chunk_id"))}
    out = registry.without_project(tables, 7)
    counts = [out[n].agg(F.count("*").alias(n)) for n in ("files", "chunks", "vectors")]
    return counts[0].crossJoin(F.broadcast(counts[1])).crossJoin(F.broadcast(counts[2]))  # one row each


def _answers(spark, sf_dir) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return e.select(F.sha2(F.col("event_id").cast("string"), 256).alias("query_hash"), F.when(F.col("event_id") % 5 == 0, "old").otherwise("head").alias("head_sha"), F.when(F.col("event_id") % 7 == 0, 1.0).otherwise(2.0).alias("index_stamp"), F.when(F.col("event_id") % 11 == 0, "{").otherwise(F.col("props")).alias("result_json"), F.lit(0.0).alias("created_at"), (F.col("event_id") % 3).cast("double").alias("expires_at"))


_VALID = "event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 3 = 2"


@query(f"SELECT sha256(CAST(event_id AS VARCHAR)) AS query_hash, {_VALID} AS hit, CASE WHEN {_VALID} THEN props END AS result_json FROM events")
def cached_answers(spark, sf_dir):
    entries = _answers(spark, sf_dir)
    return cache.lookup(entries, entries, "head", 2.0, 1.0)


@query(f"SELECT count(*) FILTER ({_VALID}) AS hits, count(*) FILTER (NOT ({_VALID})) AS misses, CAST(coalesce(sum(CASE WHEN {_VALID} THEN strlen(props) END), 0) AS BIGINT) AS bytes, round(count(*) FILTER ({_VALID}) / count(*), 6) AS hit_rate FROM events")
def cache_statistics(spark, sf_dir):
    return cache.statistics(cached_answers(spark, sf_dir))


@query("SELECT index_stamp, count(*) AS n, min(expires_at) AS least FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 3.0 ELSE CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 2.0 END END AS index_stamp, CASE WHEN event_id % 2 = 0 THEN 3700.0 ELSE CAST(event_id % 3 AS DOUBLE) END AS expires_at FROM events WHERE event_id % 5 <> 0) WHERE expires_at >= 1.0 GROUP BY 1")
def cache_replaced_and_swept(spark, sf_dir):
    held = _answers(spark, sf_dir).where("head_sha = 'head'")
    new = A.table(spark, sf_dir, "events").where("event_id % 2 = 0 and event_id % 5 <> 0").select(F.sha2(F.col("event_id").cast("string"), 256).alias("query_hash"), F.col("props").alias("result_json"))
    return cache.swept(cache.put(held, new, "head", 3.0, 100.0), 1.0).groupBy("index_stamp").agg(F.count("*").alias("n"), F.min("expires_at").alias("least"))


# Memory.


@query("SELECT event_id AS id, contains(lower(event_type), 'c') AS part, lower(event_type) = 'click' AS whole FROM events WHERE contains(lower(event_type), 'c')")
def decisions_about(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("topic"))
    exact = memory.about(e, "CLICK", exact=True).select("id", F.lit(True).alias("whole"))
    return memory.about(e, "C").select("id", F.lit(True).alias("part")).join(exact, "id", "left").withColumn("whole", F.coalesce("whole", F.lit(False)))


_ADDED = "FROM (SELECT event_id, event_type AS topic, event_id % 4 AS k FROM events)"


@query(f"""SELECT event_id, topic, CASE WHEN k = 1 THEN 'Symptom: err CHANGE_ME' || chr(10) || chr(10) || 'Why it works: because' ELSE 'because' END AS rationale, topic || ' :: use ' || CAST(event_id AS VARCHAR) || CASE WHEN k = 1 THEN ' :: err CHANGE_ME' ELSE '' END AS embedded_text, CAST(NULL AS VARCHAR) AS refusal {_ADDED} WHERE k <= 1
UNION ALL SELECT event_id, topic, NULL, NULL, CASE WHEN k = 2 THEN 'no reason to supersede' ELSE 'superseded decision unknown' END {_ADDED} WHERE k > 1""")
def decisions_added(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    none = F.lit(None).cast("string")
    new = e.select(
        F.col("event_id").alias("project_id"), F.col("event_type").alias("topic"), F.concat(F.lit("use "), F.col("event_id").cast("string")).alias("decision"), F.lit("because").alias("rationale"),
        F.when(k == 1, F.concat(F.lit("err AKIA"), F.repeat(F.lit("Q"), F.lit(16)))).alias("context"), F.lit(None).cast("array<string>").alias("files_touched"), none.alias("session_id"), none.alias("author"),
        F.when(k == 2, 5).when(k == 3, 6).cast("long").alias("supersedes"), none.alias("override_reason"), none.alias("kind"),
    )
    held = e.select(F.col("event_id").alias("project_id"), F.lit(5).cast("long").alias("decision_id"), F.col("event_type").alias("topic"), F.lit(1.0).alias("created_at"))
    kept, refused = memory.added(held, new, 2.0)
    out = kept.select(F.col("project_id").alias("event_id"), "topic", "rationale", "embedded_text", none.alias("refusal"))
    return out.unionByName(refused.select(F.col("project_id").alias("event_id"), "topic", none.alias("rationale"), none.alias("embedded_text"), "refusal"))


_HIT = "round(greatest(1 - list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 0.0), 6)"


def _asked(spark, sf_dir):
    return A.vectors(spark, sf_dir).where("chunk_id = 0").select("embedding")


@query(f"SELECT vec_id AS chunk_id, {_HIT} AS distance FROM embeddings WHERE vec_id % 2 = 1 ORDER BY 2, 1 LIMIT 10")
def history_knn(spark, sf_dir):
    v = A.vectors(spark, sf_dir).withColumn("project_id", F.col("chunk_id") % 2)
    zero = v.limit(1).select(F.lit(-1).cast("long").alias("chunk_id"), F.transform("embedding", lambda x: x * 0).alias("embedding"), "kind", F.lit(1).cast("long").alias("project_id"))
    return memory.history_hits(v.unionByName(zero), _asked(spark, sf_dir), 10, 1).select("chunk_id", "distance")


@query(f"SELECT chunk_id, distance FROM (SELECT vec_id AS chunk_id, {_HIT} AS distance FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) ORDER BY 2, 1 LIMIT 40) WHERE distance <= 0.92 * 0.92 / 2")
def decision_knn(spark, sf_dir):
    own = A.vectors(spark, sf_dir)
    return memory.decision_hits(own, _asked(spark, sf_dir), 40, own.where("chunk_id = 0").first()["kind"]).select("chunk_id", "distance")


@query(f"SELECT row_number() OVER (ORDER BY distance, vec_id) AS place, vec_id AS decision_id, 'fact' AS kind, 't' || CAST(vec_id AS VARCHAR) AS topic FROM (SELECT vec_id, {_HIT} AS distance FROM embeddings ORDER BY 2, 1 LIMIT 3) WHERE distance <= 0.92 * 0.92 / 2")
def decisions_preface(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    decisions = v.select(F.col("chunk_id").alias("decision_id"), F.lit("fact").alias("kind"), F.concat(F.lit("t"), F.col("chunk_id").cast("string")).alias("topic"), F.lit("d").alias("decision"))
    return memory.preface(v, decisions, _asked(spark, sf_dir)).select("place", "decision_id", "kind", "topic")


@query("""SELECT user_id, CASE WHEN max(event_id) >= 0 THEN max(t) END AS topic FROM (SELECT user_id, event_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY c DESC, event_type DESC) AS t FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events)) GROUP BY 1""")
def suggest_topic_by_tag(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.concat(F.lit("n"), F.md5(F.col("event_id").cast("string"))).alias("summary"), F.concat(F.lit(" "), F.col("event_type"), F.lit(" ,")).alias("tags"))
    several = e.join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    lone = several.where("n = 1").select("user_id", F.trim(F.regexp_replace("tags", ",", "")).alias("topic"))
    return memory.suggest_topic(several.where("n > 1").drop("n"), "user_id").unionByName(lone)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS n FROM events")
def files_of_entries(spark, sf_dir):
    from quarrykit.functions import text

    column = F.when(F.col("event_id") % 3 == 0, F.lit("{")).otherwise(F.concat(F.lit('["a.py", "b'), F.col("event_id").cast("string"), F.lit('.py"]')))
    return A.table(spark, sf_dir, "events").select("event_id", F.size(text.touched_files(column)).alias("n"))


@query("SELECT event_id, kind, payload, dead FROM (SELECT DISTINCT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'decision' END AS kind, CASE WHEN event_id % 4 = 0 THEN NULL ELSE '{}' END AS payload, event_id % 4 = 0 AS dead FROM events)")
def outbox_drained(spark, sf_dir):
    line = F.when(F.col("event_id") % 4 == 0, F.lit('{"kind": "odd"}')).otherwise(F.lit('{"kind": "decision", "payload": "{}"}'))
    box = A.table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    good, dead = staged.drained(box.unionByName(box), ["decision"])
    none = F.lit(None).cast("string")
    return good.select("event_id", "kind", "payload", F.lit(False).alias("dead")).unionByName(dead.select("event_id", none.alias("kind"), none.alias("payload"), F.lit(True).alias("dead")))


@query("SELECT event_type AS name, max(event_id) AS ord, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_write_wins(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("name")).agg(F.max("event_id").alias("ord"), F.max_by("value", "event_id").alias("value"))


@query("SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY 1, 2")
def distinct_in_order(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").withColumnRenamed("event_id", "place")
    return inventory.distinct_in_order(e, ["user_id"], "event_type", "place")


@query()
def consolidated_themes(spark, sf_dir):
    """The report over the vectors as a log of ten projects by label; tests hold its parts against brute force."""
    v = A.vectors(spark, sf_dir).withColumn("project_id", F.col("kind").cast("long"))
    entries = v.select("project_id", F.col("chunk_id").alias("id"), F.col("chunk_id").cast("double").alias("created_at"), F.concat(F.lit("entry "), F.col("chunk_id").cast("string")).alias("summary"), F.lit("tag").alias("tags"))
    decisions = v.where("chunk_id % 50 = 0").select("project_id", F.col("chunk_id").alias("decision_id"), "embedding")
    files = A.files(spark, sf_dir).select(F.col("project_id").cast("long").alias("project_id"), "rel_path")
    return memory.consolidated(entries, v.select(F.col("chunk_id").alias("id"), "embedding"), decisions, files, 0.0)[0]
