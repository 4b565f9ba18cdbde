"""Edge classes, statistics, resolution and traversal."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions import paths
from quarrykit.functions.store import stored
from quarrykit.functions.variables import has_markers, substitute

# Candidate files of Python and JavaScript imports, in order.
JS_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")
#: References to names that a directory declares, with the names' prefix in the declarations.
TF_SYMBOLS = {"tf_var_ref": "var", "tf_local_ref": "local", "tf_module_ref": "module"}
#: Declarations: they give targets and are no references themselves.
DECLARATIONS = ("tf_decl", "helm_define")


def _shuffled(side: DataFrame) -> DataFrame:
    """A join's right side that is never broadcast: paths put together from a small table are many times its size, which is all the planner knows."""
    return side.hint("merge")


def edge_class() -> Column:
    """resolved, parametric, unresolved or external, of (target_file_id, raw, kind)."""
    return F.when(F.col("target_file_id").isNotNull(), "resolved").when(has_markers(F.coalesce("raw", F.lit(""))), "parametric").when(F.col("kind") == "unresolved", "unresolved").otherwise("external")


def stats(edges: DataFrame) -> DataFrame:
    """One row per project: totals by class in one pass."""
    cls = edge_class()
    count = lambda name: F.count_if(cls == name).alias(name)
    return edges.groupBy("project_id").agg(F.count("*").alias("total"), *(count(c) for c in ("resolved", "parametric", "unresolved", "external")))


def by_kind(edges: DataFrame) -> DataFrame:
    return edges.groupBy("project_id", "kind").agg(F.count("*").alias("n"))


def in_degree(edges: DataFrame) -> DataFrame:
    """(target_file_id, in_degree) of resolved edges."""
    return edges.where("target_file_id is not null").groupBy("target_file_id").agg(F.count("*").alias("in_degree"))


def hubs(edges: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """The most referenced files: degrees are summed before the join, so only one row per file meets it."""
    named = in_degree(edges).join(files.select(F.col("file_id").alias("target_file_id"), "rel_path"), "target_file_id")
    return named.select("rel_path", "in_degree").orderBy(F.desc("in_degree"), "rel_path").limit(limit)


def deduplicated(edges: DataFrame) -> DataFrame:
    """One reference per file, kind and raw, at its first line."""
    return edges.groupBy("source_file_id", "kind", "raw").agg(F.min("line").alias("line"))


# Candidate paths are put together as text and normalised once, at the end: a path function in every branch makes plans of hundreds of kilobytes.


def _normalized(candidates: Column) -> Column:
    return F.transform(candidates, paths.normalize)


def _python(source: Column, raw: Column, symbol: Column) -> Column:
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    name = F.replace(F.regexp_replace(raw, r"^\.+", ""), F.lit("."), F.lit("/"))
    ups = F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0)))
    base = F.when(dots > 0, F.concat_ws("/", paths.dir_name(source), F.array_join(ups, "/"), name)).otherwise(name)
    with_symbol = F.array(F.concat_ws("/", base, F.concat(symbol, F.lit(".py"))), F.concat_ws("/", base, symbol, F.lit("__init__.py")))
    plain = F.array(F.concat(base, F.lit(".py")), F.concat_ws("/", base, F.lit("__init__.py")))
    return F.when(symbol.isNotNull() & (symbol != "*"), F.concat(with_symbol, plain)).otherwise(plain)


def python_candidates(source: Column, raw: Column, symbol: Column) -> Column:
    """Files that a Python import may mean, in order; null entries where it leaves the root."""
    return _normalized(_python(source, raw, symbol))


def js_candidates(source: Column, raw: Column) -> Column:
    """Files that a relative JavaScript import may mean, in order; empty for packages."""
    tails = [*JS_EXTENSIONS, *(f"/index{e}" for e in JS_EXTENSIONS)]
    known = raw.rlike(r"\.(js|jsx|ts|tsx)$")
    target = F.array(paths.resolve(source, raw))
    guesses = F.flatten(F.transform(target, lambda t: F.when(known, F.array(t)).otherwise(F.array(*(F.concat(t, F.lit(e)) for e in tails)))))
    return F.when(raw.startswith("."), F.filter(guesses, lambda g: g.isNotNull())).otherwise(F.array().cast("array<string>"))


def _terraform(source: Column, raw: Column, kind: Column) -> Column:
    here = F.regexp_replace(raw, r"^\$\{path\.module\}/", "./")
    path = F.when(raw.startswith("${path.root}/"), F.regexp_replace(raw, r"^\$\{path\.root\}/", "/")).otherwise(here)
    target = paths.joined(source, path)
    module = F.when(path.rlike(r"^[./]"), F.array(F.concat_ws("/", target, F.lit("main.tf")))).otherwise(F.array().cast("array<string>"))
    return F.when(kind == "tf_module", module).otherwise(F.array(target))


def terraform_candidates(source: Column, raw: Column, kind: Column) -> Column:
    """Files of a Terraform path; a module means its main.tf."""
    return _normalized(_terraform(source, raw, kind))


def _manifest(source: Column, raw: Column, symbol: Column, kind: Column) -> Column:
    rooted = F.regexp_replace(F.regexp_replace(raw, "@.*$", ""), r"^\./", "")
    near = paths.joined(source, raw)
    none = F.array().cast("array<string>")
    remote = raw.rlike(r"^[a-z]+://|^git@|^github\.com/|\?ref=")
    in_dir = lambda base, *names: F.array(*(F.concat_ws("/", base, F.lit(n)) for n in names))
    return (
        F.when(kind == "gha_uses_workflow", F.array(rooted))
        .when(kind == "gha_uses_action", in_dir(rooted, "action.yml", "action.yaml"))
        .when(kind.startswith("kustomize_"), F.when(remote, none).otherwise(F.concat(F.array(near), in_dir(near, "kustomization.yaml", "kustomization.yml"))))
        .when(kind == "argocd_app_source", F.when(has_markers(raw), none).otherwise(F.concat(in_dir(rooted, "Chart.yaml", "kustomization.yaml", "kustomization.yml"), F.array(rooted))))
        .when(kind == "helm_dependency", F.concat(F.when(raw.startswith("file://"), in_dir(paths.joined(source, F.regexp_replace(raw, "^file://", "")), "Chart.yaml")).otherwise(none), in_dir(paths.joined(source, F.concat(F.lit("charts/"), symbol)), "Chart.yaml")))
        .when(kind == "dotnet_project_reference", F.array(paths.joined(source, F.replace(raw, F.lit("\\"), F.lit("/")))))
    )


def manifest_candidates(source: Column, raw: Column, symbol: Column, kind: Column) -> Column:
    """Files of workflow, kustomization, chart and project references."""
    return _normalized(_manifest(source, raw, symbol, kind))


def _ansible(source: Column, raw: Column, symbol: Column, kind: Column, roles: tuple[str, ...]) -> Column:
    entry = F.coalesce(symbol, F.lit("main"))
    role = F.array(*(F.concat(F.lit(f"{d}/"), raw, F.lit("/tasks/"), entry, F.lit(e)) for d in roles for e in (".yml", ".yaml")))
    return F.when(kind.isin("ansible_include_role", "ansible_import_role", "ansible_role_entry"), role).otherwise(F.array(paths.joined(source, raw)))


def ansible_candidates(source: Column, raw: Column, symbol: Column, kind: Column, roles: tuple[str, ...] = ("roles",)) -> Column:
    """Files of an Ansible reference: relative paths, or a role's task file in the role directories."""
    return _normalized(_ansible(source, raw, symbol, kind, roles))


def candidates(roles: tuple[str, ...] = ("roles",)) -> Column:
    """Candidate paths of a raw edge (source_rel, lang, kind, raw, symbol) by its kind; ``roles`` are the role directories."""
    source, raw, symbol, kind = F.col("source_rel"), F.col("raw"), F.col("symbol"), F.col("kind")
    return _normalized(
        F.when(kind.isin("import", "from_import", "dynamic_import") & (F.col("lang") == "python"), _python(source, raw, symbol))
        .when(kind.isin("import", "require", "dynamic_import"), js_candidates(source, raw))
        .when(kind.isin(*TF_SYMBOLS, "helm_include", "ansible_module"), F.array().cast("array<string>"))  # by name
        .when(kind.startswith("tf_"), _terraform(source, raw, kind))
        .when(kind.startswith("ansible_"), _ansible(source, raw, symbol, kind, roles))
        .otherwise(_manifest(source, raw, symbol, kind))
    )


def first_match(edges: DataFrame, files: DataFrame, candidate: Column) -> DataFrame:
    """``edges`` (project_id, edge_id, …) with target_file_id of the first candidate path that is a file, else null."""
    tried = edges.select("project_id", "edge_id", F.posexplode(candidate).alias("pos", "rel_path")).where("rel_path is not null")
    hit = tried.join(_shuffled(files.select("project_id", "rel_path", "file_id")), ["project_id", "rel_path"]).groupBy("project_id", "edge_id").agg(F.min_by("file_id", "pos").alias("target_file_id"))
    return edges.join(_shuffled(hit), ["project_id", "edge_id"], "left")


def symbol_targets(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, edge_id, declared_in) of references by name.

    A Terraform name is declared in the directory of its reference, a Helm
    template under the ``templates`` of the nearest chart above it. Of several
    declarations the one in the last path counts.
    """
    kind, source = F.col("kind"), F.col("source_rel")
    known = files.select("project_id", F.col("rel_path").alias("source_rel"), "file_id")
    helm = kind.isin("helm_include", "helm_define")
    refs = edges.where(kind.isin(*TF_SYMBOLS, "helm_include")).select("project_id", "edge_id", "source_rel", "kind", "raw")
    refs = refs.join(_shuffled(known), ["project_id", "source_rel"], "left").join(_shuffled(nearest_chart(files)), "file_id", "left")
    prefix = F.coalesce(*(F.when(kind == k, v) for k, v in TF_SYMBOLS.items()))
    name = F.when(helm, F.col("raw")).otherwise(F.concat_ws(".", prefix, F.substring_index("raw", ".", -1)))
    refs = refs.select("project_id", "edge_id", helm.alias("helm"), F.when(helm, F.col("chart_dir")).otherwise(paths.dir_name(source)).alias("scope"), name.alias("name"))
    chart = F.when(source.rlike("^(?:.*/)?templates/"), F.regexp_extract(source, "^(?:(.*)/)?templates/", 1))
    declared = edges.where(kind.isin(*DECLARATIONS)).join(_shuffled(known), ["project_id", "source_rel"])
    declared = declared.select("project_id", helm.alias("helm"), F.when(helm, chart).otherwise(paths.dir_name(source)).alias("scope"), F.col("raw").alias("name"), "source_rel", "file_id")
    declared = declared.groupBy("project_id", "helm", "scope", "name").agg(F.max_by("file_id", "source_rel").alias("declared_in"))
    return refs.join(_shuffled(declared), ["project_id", "helm", "scope", "name"]).select("project_id", "edge_id", "declared_in")


def module_dirs(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, edge_id, first_tf) of Terraform modules: the first .tf file of the module's directory."""
    raw = F.col("raw")
    local = edges.where((F.col("kind") == "tf_module") & raw.rlike(r"^[./]|^\$\{path\.(module|root)\}/"))
    here = F.regexp_replace(F.regexp_replace(raw, r"^\$\{path\.module\}/", "./"), r"^\$\{path\.root\}/", "/")
    asked = local.select("project_id", "edge_id", paths.resolve(F.col("source_rel"), here).alias("dir"))
    first = files.where(F.col("rel_path").endswith(".tf")).groupBy("project_id", paths.dir_name(F.col("rel_path")).alias("dir")).agg(F.min_by("file_id", "rel_path").alias("first_tf"))
    return asked.join(_shuffled(first), ["project_id", "dir"]).select("project_id", "edge_id", "first_tf")


def module_files(edges: DataFrame, files: DataFrame, libraries: tuple[str, ...] = ("library",)) -> DataFrame:
    """(project_id, edge_id, module_file) of Ansible modules: the file of that name in a library directory; of several the last path counts."""
    path = F.col("rel_path")
    inside = F.lit(False)
    for d in libraries:
        inside = inside | path.startswith(f"{d}/") | F.contains(path, F.lit(f"/{d}/"))
    own = files.where(inside & path.endswith(".py")).groupBy("project_id", F.regexp_replace(paths.base_name(path), r"\.py$", "").alias("raw")).agg(F.max_by("file_id", "rel_path").alias("module_file"))
    return edges.where("kind = 'ansible_module'").select("project_id", "edge_id", "raw").join(_shuffled(own), ["project_id", "raw"]).select("project_id", "edge_id", "module_file")


def _filled(column: str, values: Column) -> Column:
    """A templated column with its variables, in the syntax of the edge's kind; null if one is unknown."""
    whole = F.coalesce(F.col(column), F.lit(""))
    done = F.when(F.col("kind").startswith("tf_"), substitute(whole, values, "terraform")).otherwise(substitute(whole, values, "jinja"))
    return F.when(F.col(column).isNull() | ~has_markers(whole), F.col(column)).otherwise(F.when(done["complete"], done["text"]))


def resolve(edges: DataFrame, files: DataFrame, variables: Column | None = None, roles: tuple[str, ...] = ("roles",), libraries: tuple[str, ...] = ("library",)) -> DataFrame:
    """Raw edges with their targets; templated ones get their variables first, if all of raw and symbol are known.

    Always against all files, so an update gives what a rebuild gives.
    Declarations (``DECLARATIONS``) are used as targets and left out, as are
    Ansible modules that no library directory holds. ``variables`` is a map of
    names to values. The edges are stored first, as five steps read them, and
    no side of a join is held in one place.
    """
    asked = edges = stored(edges)
    if variables is not None:
        raw, symbol = _filled("raw", variables), _filled("symbol", variables)
        full = (raw.isNotNull() | F.col("raw").isNull()) & (symbol.isNotNull() | F.col("symbol").isNull())
        asked = edges.withColumns({"_raw": F.col("raw"), "_symbol": F.col("symbol"), "raw": F.when(full, raw).otherwise(F.col("raw")), "symbol": F.when(full, symbol).otherwise(F.col("symbol"))})
    out = first_match(asked.where(~F.col("kind").isin(*DECLARATIONS)), files, candidates(roles))
    for more in (symbol_targets(asked, files), module_dirs(asked, files), module_files(asked, files, libraries)):
        name = more.columns[-1]
        out = out.join(_shuffled(more), ["project_id", "edge_id"], "left").withColumn("target_file_id", F.coalesce("target_file_id", name)).drop(name)
    out = out.where((F.col("kind") != "ansible_module") | F.col("target_file_id").isNotNull())
    return out if variables is None else out.withColumns({"raw": F.col("_raw"), "symbol": F.col("_symbol")}).drop("_raw", "_symbol")


def reresolved(edges: DataFrame, files: DataFrame, variables: Column) -> tuple[DataFrame, DataFrame]:
    """(edges with new targets, counts) after a change of variables: only templated edges are touched.

    ``counts`` is one row: updated (targets that changed) and still_parametric
    (templated edges without one).
    """
    templated = has_markers(F.coalesce("raw", F.lit(""))) | has_markers(F.coalesce("symbol", F.lit("")))
    before = edges.where(templated)
    after = resolve(before.drop("target_file_id"), files, variables)
    both = before.select("project_id", "edge_id", F.col("target_file_id").alias("was")).join(_shuffled(after.select("project_id", "edge_id", "target_file_id")), ["project_id", "edge_id"])
    counts = both.agg(F.count_if(~F.col("was").eqNullSafe(F.col("target_file_id"))).alias("updated"), F.count_if(F.col("target_file_id").isNull()).alias("still_parametric"))
    return edges.where(~templated).unionByName(after.select(*edges.columns)), counts


def listed(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with source_rel and target_rel, null for those without a target."""
    source = files.select(F.col("file_id").alias("source_file_id"), F.col("rel_path").alias("source_rel"))
    target = files.select(F.col("file_id").alias("target_file_id"), F.col("rel_path").alias("target_rel"))
    return edges.drop("source_rel").join(source, "source_file_id").join(target, "target_file_id", "left")


def nearest_chart(files: DataFrame) -> DataFrame:
    """(file_id, chart_dir): the nearest directory above a file that holds a Chart.yaml, the root included."""
    charts = files.where(paths.base_name(F.col("rel_path")).isin("Chart.yaml", "Chart.yml")).select("project_id", paths.dir_name(F.col("rel_path")).alias("dir")).distinct()
    above = files.select("project_id", "file_id", F.posexplode(paths.ancestors(F.col("rel_path"))).alias("depth", "dir"))
    return above.join(_shuffled(charts), ["project_id", "dir"]).groupBy("file_id").agg(F.max_by("dir", "depth").alias("chart_dir"))


def traverse(edges: DataFrame, start: DataFrame, depth: int, reverse: bool = False, kinds: list[str] | None = None) -> DataFrame:
    """(file_id, hops): files reached from ``start`` (file_id) in up to ``depth`` hops, the start at 0.

    Each level joins the frontier with the edges, drops what was seen and is
    stored, so the plan of a level doesn't hold those before it; edges outside
    ``kinds`` are not followed. Ends early when a level finds nothing.
    """
    near, far = ("target_file_id", "source_file_id") if reverse else ("source_file_id", "target_file_id")
    own = edges.where("target_file_id is not null")
    if kinds:
        own = own.where(F.col("kind").isin(kinds))
    step = own.select(F.col(near).alias("file_id"), F.col(far).alias("to")).distinct()
    seen = start.select("file_id", F.lit(0).alias("hops")).distinct()
    if depth > 1:
        step, seen = stored(step), stored(seen)
    frontier = seen
    for hop in range(1, depth + 1):
        frontier = frontier.select("file_id").join(step, "file_id").select(F.col("to").alias("file_id")).distinct().join(seen.select("file_id"), "file_id", "left_anti").withColumn("hops", F.lit(hop))
        if hop < depth:
            frontier = stored(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def relations(edges: DataFrame, files: DataFrame, rel_path: str, depth: int = 1, kinds: list[str] | None = None, siblings: int = 50) -> DataFrame:
    """(direction, hop, source_rel, kind, raw, target_rel) around a file; files of its directory if it has no edges.

    Edges without a target are reported, not followed; ``kinds`` holds for both.
    """
    own = edges if not kinds else edges.where(F.col("kind").isin(kinds))
    start = files.where(F.col("rel_path") == rel_path).select("file_id")
    found = None
    for direction, near in (("forward", "source_file_id"), ("reverse", "target_file_id")):
        reached = traverse(own, start, depth - 1, direction == "reverse").select(F.col("file_id").alias(near), F.col("hops"))
        part = listed(own.join(reached, near), files).select(F.lit(direction).alias("direction"), (F.col("hops") + 1).alias("hop"), "source_rel", "kind", "raw", "target_rel")
        found = part if found is None else found.unionByName(part)
    found = found.distinct()
    here = F.lit(rel_path)
    near_by = files.where((paths.dir_name(F.col("rel_path")) == paths.dir_name(here)) & (F.col("rel_path") != here)).orderBy("rel_path").limit(siblings)
    near_by = near_by.select(F.lit("sibling").alias("direction"), F.lit(0).alias("hop"), here.alias("source_rel"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("raw"), F.col("rel_path").alias("target_rel"))
    some = F.broadcast(found.limit(1).select(F.lit(True).alias("_some")))  # one row
    return found.unionByName(near_by.join(some, F.col("_some"), "left_anti"))


def graph_nodes(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(node_key, label, node_group, shape): files with edges and one synthetic node per class and raw text of edges without target."""
    loose = edges.where("target_file_id is null").select(F.concat_ws(":", edge_class(), F.coalesce("raw", F.lit(""))).alias("node_key"), F.col("raw").alias("label"), edge_class().alias("node_group"), F.lit("diamond").alias("shape")).distinct()
    used = edges.select(F.col("source_file_id").alias("file_id")).union(edges.where("target_file_id is not null").select("target_file_id")).distinct()
    known = files.join(used, "file_id", "left_semi").select(F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("node_key"), F.col("rel_path").alias("label"), paths.top_group(F.col("rel_path")).alias("node_group"), F.lit("dot").alias("shape"))
    return known.unionByName(loose)


def _node_key(side: str) -> Column:
    """The key of an edge's end: its file, or for a missing target the class and raw text."""
    file = F.concat(F.lit("file:"), F.col(side).cast("string"))
    return file if side == "source_file_id" else F.coalesce(file, F.concat_ws(":", edge_class(), F.coalesce("raw", F.lit(""))))


def graph_edges(edges: DataFrame) -> DataFrame:
    """(source_key, target_key, kind, n): one line per pair of nodes and kind."""
    return edges.groupBy(_node_key("source_file_id").alias("source_key"), _node_key("target_file_id").alias("target_key"), "kind").agg(F.count("*").alias("n"))


def graph(edges: DataFrame, files: DataFrame, orphans: bool = False) -> DataFrame:
    """:func:`graph_nodes` with files without edges: all of them, or only those of CI pipelines, which always show."""
    known = graph_nodes(edges, files)
    rest = files.select(F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("node_key"), F.col("rel_path").alias("label"), paths.top_group(F.col("rel_path")).alias("node_group"), F.lit("dot").alias("shape"))
    rest = rest if orphans else rest.where(paths.is_cicd(F.col("label")))
    return known.unionByName(rest.join(known.select("node_key"), "node_key", "left_anti"))


# Colours of the groups that are no directories, first hue, step, lightness and saturation of the others.
NEUTRAL = {"external": "#cccccc", "parametric": "#e5c07b", "unresolved": "#e06c75"}
FIRST_HUE, HUE_STEP, LIGHTNESS, SATURATION = 0.08, 0.6180339887498949, 0.55, 0.65


def palette(nodes: DataFrame) -> DataFrame:
    """(node_group, colour): groups in order walk round the hues by the golden ratio; those of loose edges stay neutral."""
    names = sorted(r[0] for r in nodes.select("node_group").where("node_group is not null").distinct().collect())  # first path parts

    def colour(i: int) -> str:
        rgb = colorsys.hls_to_rgb((FIRST_HUE + i * HUE_STEP) % 1.0, LIGHTNESS, SATURATION)
        return "#" + "".join(f"{int(c * 255):02x}" for c in rgb)

    plain = [n for n in names if n not in NEUTRAL]
    rows = [(n, NEUTRAL[n] if n in NEUTRAL else colour(plain.index(n))) for n in names]
    return nodes.sparkSession.createDataFrame(rows, "node_group string, colour string")
