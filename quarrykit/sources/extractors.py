"""Edge extractors: files (file_id, rel_path, lang, content) to raw edges (file_id, kind, raw, symbol, line)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.paths import yaml_flavor
from quarrykit.functions.store import dealt
from quarrykit.sources import parsers

try:
    import yaml
except ImportError:
    yaml = None

EDGE = "file_id long, kind string, raw string, symbol string, line int"
_SCHEMA = pa.schema([("file_id", pa.int64()), ("kind", pa.string()), ("raw", pa.string()), ("symbol", pa.string()), ("line", pa.int32())])
Edge = tuple[str, str, str | None, int]  # kind, raw, symbol, line


def _by_line(files: DataFrame, pattern: str, kind: Column | str, group: int = 1) -> DataFrame:
    """An edge for each match of ``pattern`` in a line; ``kind`` may read the line as ``text``."""
    lines = files.select("file_id", F.posexplode(F.split("content", "\n")).alias("n", "text")).where(F.col("text").rlike(pattern))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return lines.select("file_id", kind.alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("raw"), F.lit(None).cast("string").alias("symbol"), (F.col("n") + 1).cast("int").alias("line"))


def javascript(files: DataFrame) -> DataFrame:
    """import … from, require() and import() of literal paths; those of other expressions are unresolved."""
    static = _by_line(files, r"""^\s*(?:import|export)\b(?:[^'"(]*\bfrom)?\s*['"]([^'"]+)['"]""", "import")
    required = _by_line(files, r"""\brequire\(\s*['"]([^'"]+)['"]\s*\)""", "require")
    dynamic = _by_line(files, r"""\bimport\(\s*['"]([^'"]+)['"]\s*\)""", "dynamic_import")
    loose = _by_line(files, r"""\b(?:require|import)\(\s*([^'"\s)][^)]*)\)""", "unresolved")
    return static.unionByName(required).unionByName(dynamic).unionByName(loose)


def msbuild(files: DataFrame) -> DataFrame:
    """Project references, one per part of an Include; those with a property or glob are unresolved."""
    found = _by_line(files, r"""(?i)<ProjectReference\b[^>]*?\bInclude\s*=\s*["']([^"']*)["']""", "dotnet_project_reference")
    parts = found.withColumn("raw", F.explode(F.split("raw", ";"))).withColumn("raw", F.trim("raw")).where("raw <> ''")
    loose = F.contains("raw", F.lit("$(")) | F.contains("raw", F.lit("*"))
    return parts.withColumn("kind", F.when(loose, "unresolved").otherwise(F.col("kind"))).select("file_id", "kind", "raw", "symbol", "line")


def argocd(files: DataFrame) -> DataFrame:
    """Source paths of Application documents; the symbol is the application's name."""
    docs = files.select("file_id", F.explode(F.split("content", r"(?m)^---\s*$")).alias("doc")).where(F.col("doc").rlike(r"(?m)^kind:\s*Application(Set)?\s*$"))
    name = F.nullif(F.regexp_extract("doc", r"""(?m)^metadata:[\s\S]*?^\s+name:\s*['"]?([^'"\n]+)""", 1), F.lit(""))
    found = docs.select("file_id", name.alias("symbol"), F.explode(F.regexp_extract_all("doc", F.lit(r"""(?m)^\s+(?:- )?path:\s*['"]?([^'"\n#]+)"""), F.lit(1))).alias("raw"))
    return found.select("file_id", F.lit("argocd_app_source").alias("kind"), F.trim("raw").alias("raw"), F.trim("symbol").alias("symbol"), F.lit(None).cast("int").alias("line"))


def helm(files: DataFrame) -> DataFrame:
    """include and template calls and definitions of Helm templates."""
    used = _by_line(files, r"""\{\{-?\s*[^}]*?\b(?:include|template)\s+"([^"]+)\"""", "helm_include")
    return used.unionByName(_by_line(files, r"""\{\{-?\s*define\s+"([^"]+)\"""", "helm_define"))


def links(files: DataFrame) -> DataFrame:
    """Links of an HTML page."""
    return files.select("file_id", F.explode(F.regexp_extract_all("content", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("raw")).select("file_id", F.lit("href").alias("kind"), "raw")


def python_edges(text: str) -> list[Edge]:
    """Imports anywhere in the file, and import_module() of a literal."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out: list[Edge] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [("import", a.name, None, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [("from_import", "." * node.level + (node.module or ""), a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.Call) and (getattr(node.func, "attr", None) or getattr(node.func, "id", None)) == "import_module" and node.args:
            arg = node.args[0]
            literal = isinstance(arg, ast.Constant) and isinstance(arg.value, str)
            out.append(("dynamic_import", arg.value, None, node.lineno) if literal else ("unresolved", ast.unparse(arg), None, node.lineno))
    return out


_TF_PATH = re.compile(r'\b(templatefile|file)\(\s*"([^"]+)"')
_TF_REF = re.compile(r"\b(var|local|module)\.([A-Za-z_][\w-]*)")


def terraform_edges(text: str, path: str) -> list[Edge]:
    """Modules, file functions, declarations and, once a file, references."""
    line = lambda at: text.count("\n", 0, at) + 1
    if path.endswith(".tfvars"):
        return [("tf_var_ref", m[1], None, line(m.start())) for m in re.finditer(r"(?m)^([A-Za-z_][\w-]*)\s*=(?!=)", text)]
    out: list[Edge] = []
    for c in parsers.hcl_chunks(text):
        if c.kind == "module" and (m := re.search(r'\bsource\s*=\s*"([^"]+)"', c.text)):
            out.append(("tf_module", m[1], c.name, c.start_line))
        if c.kind in ("variable", "module", "locals_entry"):
            out.append(("tf_decl", {"variable": "var", "module": "module", "locals_entry": "local"}[c.kind] + f".{c.name}", None, c.start_line))
    uncommented = parsers.masked(text, r"#[^\n]*|(?<!:)//[^\n]*|/\*[\s\S]*?\*/")
    out += [("tf_templatefile" if m[1] == "templatefile" else "tf_file", m[2], None, line(m.start())) for m in _TF_PATH.finditer(uncommented)]
    seen = set()
    for m in _TF_REF.finditer(parsers.masked(text, parsers.HCL_LIKE)):
        if (m[1], m[2]) not in seen:
            seen.add((m[1], m[2]))
            out.append(({"var": "tf_var_ref", "local": "tf_local_ref", "module": "tf_module_ref"}[m[1]], m[2], None, line(m.start())))
    return out


def _maps(node):
    """Every mapping of a composed document with its line."""
    if isinstance(node, yaml.MappingNode):
        yield {k.value: v for k, v in node.value if isinstance(k, yaml.ScalarNode)}
    for child in node.value if isinstance(node, yaml.SequenceNode) else [v for _, v in node.value] if isinstance(node, yaml.MappingNode) else []:
        yield from _maps(child)


def _scalars(node) -> list:
    return [node] if isinstance(node, yaml.ScalarNode) else [x for x in node.value if isinstance(x, yaml.ScalarNode)] if isinstance(node, yaml.SequenceNode) else []


_ANSIBLE = {"import_playbook": "ansible_import_playbook", "include_tasks": "ansible_include_tasks", "import_tasks": "ansible_import_tasks", "include_role": "ansible_include_role", "import_role": "ansible_import_role", "include_vars": "ansible_include_vars", "vars_files": "ansible_vars_file"}


# Keys of a task or block that are no modules.
_TASK_KEYS = frozenset((
    "name", "when", "tags", "register", "vars", "loop", "loop_control", "with_items", "with_dict", "with_fileglob", "become", "become_user",
    "become_method", "notify", "listen", "delegate_to", "run_once", "ignore_errors", "changed_when", "failed_when", "until", "retries", "delay",
    "environment", "no_log", "args", "block", "rescue", "always", "check_mode", "async", "poll", "connection", "remote_user", "any_errors_fatal", "throttle",
))


def _tasks(node):
    """The task mappings of a play, a task list, or the blocks inside."""
    for item in node.value if isinstance(node, yaml.SequenceNode) else []:
        if isinstance(item, yaml.MappingNode):
            m = {k.value: v for k, v in item.value if isinstance(k, yaml.ScalarNode)}
            below = ("tasks", "pre_tasks", "post_tasks", "handlers") if "hosts" in m else ("block", "rescue", "always")
            if "hosts" not in m:
                yield m
            for key in below:
                yield from _tasks(m[key]) if key in m else ()


def _modules(top) -> list[Edge]:
    """The modules that tasks call by a short name: the only key of a task that is no keyword."""
    out: list[Edge] = []
    for m in _tasks(top):
        own = [k for k in m if k not in _TASK_KEYS]
        if len(own) == 1 and own[0].isidentifier() and own[0] not in _ANSIBLE:
            out.append(("ansible_module", own[0], None, m[own[0]].start_mark.line + 1))
    return out


def yaml_edges(text: str, flavor: str | None) -> list[Edge]:
    """References of Ansible, workflow, kustomization and chart files."""
    if yaml is None or flavor is None or flavor == "helm_template":
        return []
    try:
        nodes = [n for n in parsers.yaml_nodes(text) if n is not None]
    except yaml.YAMLError:
        return []
    out: list[Edge] = []
    put = lambda kind, node, symbol=None: out.append((kind, node.value, symbol, node.start_mark.line + 1))
    for top in nodes:
        for m in _maps(top):
            if flavor.startswith("gha"):
                for n in _scalars(m["uses"]) if "uses" in m else []:
                    local = n.value.startswith("./")
                    put(("gha_uses_workflow" if ".github/workflows/" in n.value else "gha_uses_action") if local else "gha_uses_external", n)
            elif flavor == "ansible":
                for key, kind in _ANSIBLE.items():
                    value = m.get(key) or m.get(f"ansible.builtin.{key}")
                    if value is None:
                        continue
                    if isinstance(value, yaml.MappingNode):
                        inner = {k.value: v for k, v in value.value}
                        if (n := inner.get("name") or inner.get("file")) is not None:
                            put(kind, n, inner["tasks_from"].value if "tasks_from" in inner else None)
                    else:
                        for n in _scalars(value):
                            put(kind, n)
                for n in m["roles"].value if isinstance(m.get("roles"), yaml.SequenceNode) else []:
                    named = n if isinstance(n, yaml.ScalarNode) else next((v for k, v in n.value if k.value in ("role", "name")), None)
                    if named is not None:
                        put("ansible_role_entry", named)
        if flavor == "ansible":
            out += _modules(top)
        m = next(iter(_maps(top)), {})
        if flavor == "kustomize":
            for key, kind in (("resources", "kustomize_resource"), ("bases", "kustomize_resource"), ("components", "kustomize_component"), ("patchesStrategicMerge", "kustomize_patch")):
                for n in _scalars(m[key]) if key in m else []:
                    put(kind, n)
            for p in _maps(m["patches"]) if "patches" in m else []:
                if "path" in p:
                    put("kustomize_patch", p["path"])
            for g in (x for key in ("configMapGenerator", "secretGenerator") if key in m for x in _maps(m[key])):
                for n in _scalars(g["files"]) if "files" in g else []:
                    put("kustomize_generator", n)
        elif flavor == "helm_chart" and "dependencies" in m:
            for d in _maps(m["dependencies"]):
                name = d.get("name")
                where = d.get("repository")
                if name is not None:
                    out.append(("helm_dependency", where.value if where is not None else "", name.value, name.start_mark.line + 1))
    return out


def parsed(files: DataFrame) -> DataFrame:
    """Edges that need a parser: Python, Terraform and YAML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = r["content"] or ""
                found = python_edges(text) if r["lang"] == "python" else terraform_edges(text, r["rel_path"]) if r["lang"] == "hcl" else yaml_edges(text, r["flavor"])
                out += [{"file_id": r["file_id"], "kind": k, "raw": raw, "symbol": s, "line": n} for k, raw, s, n in found]
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    own = files.where(F.col("lang").isin("python", "hcl", "yaml"))
    return dealt(own.select("file_id", "lang", "rel_path", "content"), "file_id").withColumn("flavor", yaml_flavor(F.col("rel_path"))).mapInArrow(run, EDGE)


def edges(files: DataFrame) -> DataFrame:
    """All raw edges by language."""
    flavor = yaml_flavor(F.col("rel_path"))
    templates = files.where((F.col("lang") == "yaml") & (flavor == "helm_template"))
    out = parsed(files)
    for part in (javascript(files.where(F.col("lang").isin("javascript", "typescript"))), msbuild(files.where("lang = 'msbuild'")), helm(templates), argocd(files.where("lang = 'yaml'"))):
        out = out.unionByName(part)
    return out
