"""Path expressions: languages, YAML flavours, normalisation, ignore rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Language by extension, or by whole name.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".tf": "hcl", ".hcl": "hcl", ".tfvars": "hcl", ".yaml": "yaml", ".yml": "yaml", ".tpl": "yaml", ".tftpl": "yaml",
    ".json": "json", ".sh": "shell", ".bash": "shell", ".j2": "jinja", ".jinja": "jinja", ".jinja2": "jinja",
    ".cs": "csharp", ".csx": "csharp", ".fs": "fsharp", ".fsi": "fsharp", ".fsx": "fsharp", ".vb": "visual_basic",
    ".csproj": "msbuild", ".fsproj": "msbuild", ".vbproj": "msbuild", ".md": "markdown", ".markdown": "markdown",
}
LANGUAGES_BY_NAME = {"Dockerfile": "dockerfile"}
# Directories that are never scanned.
IGNORED = (".git/", "__pycache__/", "node_modules/", ".venv/", "venv/", ".terraform/", "_local/", ".local/", ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", "dist/", "build/", "*.egg-info/")
# Directory names that make a YAML file an Ansible one.
ANSIBLE_DIRS = ("ansible", "playbooks", "roles", "tasks", "handlers", "meta", "vars", "defaults", "group_vars", "host_vars")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """The path up to its last slash; empty for a root file."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """The last suffix of the name with its dot; a leading dot is none."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def language(path: Column) -> Column:
    """Language of a path, null if unknown: by exact name, else by extension."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES_BY_NAME.items() for x in pair))
    suffixes = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, base_name(path)), F.try_element_at(suffixes, F.lower(extension(path))))


def yaml_flavor(path: Column) -> Column:
    """Kind of a YAML file by its relative path, null if plain."""
    name = base_name(path)
    parts = F.split(path, "/")
    manifest = name.isin("action.yml", "action.yaml")
    return (
        F.when(name.isin("kustomization.yaml", "kustomization.yml"), "kustomize")
        .when(path.rlike(r"(^|/)\.github/workflows(/|$)"), "gha_workflow")
        .when(path.rlike(r"(^|/)\.github/actions(/|$)") & manifest, "gha_action")
        .when(path.rlike(r"(^|/)\.github/actions(/|$)"), F.lit(None))
        .when(name.isin("Chart.yaml", "Chart.yml"), "helm_chart")
        .when(path.rlike(r"[^/]/templates/") & F.lower(name).rlike(r".\.(yaml|yml|tpl)$"), "helm_template")
        .when(F.arrays_overlap(parts, F.array(*(F.lit(d) for d in ANSIBLE_DIRS))), "ansible")
    )


def is_cicd(path: Column) -> Column:
    """Whether a file belongs to a CI pipeline."""
    return F.coalesce(path.rlike(r"^\.github/workflows/(.*/)?[^/]*\.ya?ml$") | path.rlike(r"^\.github/actions/(.+/)action\.ya?ml$"), F.lit(False))


def normalize(path: Column) -> Column:
    """Without empty and ``.`` parts and with ``..`` resolved; null if it leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        kept = F.when(part.isin("", "."), acc["kept"]).when(up, F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).otherwise(F.concat(acc["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), (acc["out"] | (up & (F.size(acc["kept"]) == 0))).alias("out"))

    return F.aggregate(F.split(path, "/"), start, step, lambda acc: F.when(~acc["out"], F.array_join(acc["kept"], "/")))


def resolve(source: Column, raw: Column) -> Column:
    """``raw`` seen from the file ``source``; a leading slash means the root."""
    return normalize(joined(source, raw))


def joined(source: Column, raw: Column) -> Column:
    """``raw`` behind the directory of ``source``, or from the root, not yet normalised."""
    return F.when(raw.startswith("/"), raw).otherwise(F.concat_ws("/", dir_name(source), raw))


def top_group(path: Column) -> Column:
    """First path part, ``(root)`` for root files."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("(root)")


def bucket(path: Column, depth: int) -> Column:
    """First ``depth`` parts; a shallower file keeps its own path, a root file the empty one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, "").otherwise(F.array_join(F.slice(parts, 1, depth), "/"))


def ancestors(path: Column) -> Column:
    """All directories above a path, the root as the empty one, nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def glob_regex(glob: str) -> str:
    """Regex of an ignore pattern, matched against a path and each directory above it (with a slash at its end)."""
    rule, out, i = glob.removesuffix("/"), "", 0
    anchored = "/" in rule
    rule = rule.removeprefix("/")
    while i < len(rule):
        if rule.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif rule.startswith("**", i):
            out, i = out + ".*", i + 2
        elif rule[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif rule[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(rule[i]), i + 1
    return ("^" if anchored else "(^|/)") + out + ("/" if glob.endswith("/") else "(/|$)")


def rerooted(glob: str, directory: str) -> str:
    """An ignore pattern of a nested file, as one of the root."""
    sign, rule = ("!", glob[1:]) if glob.startswith("!") else ("", glob)
    if rule.startswith("/"):
        return f"{sign}{directory}{rule}"
    inner = "/" in rule.removesuffix("/")
    return f"{sign}{directory}/{rule}" if inner else f"{sign}{directory}/**/{rule}"


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths`` (rel_path) with ``ignored``: the last rule (ord, pattern) that matches decides, ``!`` takes back.

    Rules are few, so they are collected and folded into one expression.
    """
    verdict = F.lit(False)
    for r in sorted(rules.collect(), key=lambda r: r["ord"]):
        glob = r["pattern"].strip()
        if not glob or glob.startswith("#"):
            continue
        keep = glob.startswith("!")
        verdict = F.when(F.col("rel_path").rlike(glob_regex(glob.lstrip("!"))), F.lit(not keep)).otherwise(verdict)
    return paths.withColumn("ignored", verdict)
