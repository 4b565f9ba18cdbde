"""Work-log memory: recall of decisions and history, themes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.functions.store import stored
from quarrykit.functions.text import path_tokens, scrub
from quarrykit.operators.retrieval import dot, knn

# Words that are no topic.
STOPWORDS = (
    "the", "and", "for", "are", "was", "with", "this", "that", "have", "from", "not", "but", "been", "had", "has", "its", "into", "will",
    "can", "also", "when", "use", "used", "using", "via", "per", "all", "any", "new", "one", "two", "out", "now", "get", "set", "run", "add",
    "fix", "our", "which",
    "shipped", "ships", "added", "adds", "updated", "updates", "fixed", "fixes", "changed", "changes", "removed", "refactored", "implemented",
    "verified", "created", "merged", "moved", "renamed", "deleted", "made", "done", "wip", "tested",
)
# Cutoff of decision hits on L2, the same on cosine, coverage and cohesion limits.
DECISION_CUTOFF_L2, COVERED, NEAR_EQUAL, TOPIC_SHARE = 0.92, 0.68, 0.97, 0.6
LINK, MAX_MEMBERS = 0.55, 15


def latest_per_topic(decisions: DataFrame) -> DataFrame:
    """The newest row per topic, case ignored; ties go to the larger id."""
    newest = Window.partitionBy(F.lower("topic")).orderBy(F.desc("created_at"), F.desc("decision_id"))
    return decisions.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def about(decisions: DataFrame, topic: str, exact: bool = False) -> DataFrame:
    """Decisions whose topic contains, or equals, the given one, case ignored; signs of LIKE are plain."""
    own = F.lower("topic")
    return decisions.where(own == topic.lower() if exact else F.contains(own, F.lit(topic.lower())))


def added(held: DataFrame, new: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(rows to append, refused rows) of new decisions and facts.

    ``new`` holds (project_id, topic, decision, rationale, context, files_touched,
    session_id, author, supersedes, override_reason, kind). Texts are scrubbed;
    a context becomes part of the rationale and of the embedded text. A row is
    refused without a topic or decision, with an override reason but nothing
    superseded, and with something superseded that is not in ``held`` or has no
    reason given. ``same_topic`` names the newest held decision on the topic.
    """
    text = {c: F.nullif(F.trim(scrub(F.col(c))), F.lit("")) for c in ("topic", "decision", "rationale", "context", "override_reason")}
    rows = new.withColumns(text).withColumn("_n", F.monotonically_increasing_id())
    known = held.select("project_id", F.col("decision_id").alias("supersedes"), F.lit(True).alias("_held"))
    newest = held.groupBy("project_id", F.lower("topic").alias("_topic")).agg(F.max_by("decision_id", F.struct("created_at", "decision_id")).alias("same_topic"))
    rows = rows.join(known, ["project_id", "supersedes"], "left").withColumn("_topic", F.lower("topic")).join(newest, ["project_id", "_topic"], "left").drop("_topic")
    refusal = (
        F.when(F.col("topic").isNull() | F.col("decision").isNull(), "blank")
        .when(F.col("override_reason").isNotNull() & F.col("supersedes").isNull(), "reason without a superseded decision")
        .when(F.col("supersedes").isNotNull() & F.col("_held").isNull(), "superseded decision unknown")
        .when(F.col("supersedes").isNotNull() & F.col("override_reason").isNull(), "no reason to supersede")
    )
    rows = rows.withColumn("refusal", refusal)
    why = F.when(F.col("context").isNotNull(), F.concat_ws("\n\n", F.concat(F.lit("Symptom: "), F.col("context")), F.concat(F.lit("Why it works: "), F.col("rationale")))).otherwise(F.col("rationale"))
    said = F.concat_ws(" :: ", "topic", "decision", "context")
    kept = rows.where("refusal is null").select("project_id", F.lit(float(now)).alias("created_at"), "topic", "decision", why.alias("rationale"), "files_touched", "session_id", "author", "supersedes", "override_reason", F.coalesce("kind", F.lit("decision")).alias("kind"), said.alias("embedded_text"), "same_topic")
    return kept, rows.where("refusal is not null").select("project_id", "topic", "decision", "supersedes", "refusal")


def history_entries(new: DataFrame, now: float) -> DataFrame:
    """(project_id, created_at, short_summary, long_summary, session_id, tags) of entries to append, scrubbed; blank ones are left out."""
    text = {c: scrub(F.col(c)) for c in ("short_summary", "long_summary", "tags")}
    return new.withColumns(text).where("trim(short_summary) <> ''").select("project_id", F.lit(float(now)).alias("created_at"), "short_summary", "long_summary", "session_id", "tags")


def sound(vectors: DataFrame, least: float = 1e-6) -> DataFrame:
    """Vectors that are not (nearly) zero."""
    return vectors.where(F.sqrt(dot(F.col("embedding"), F.col("embedding"))) >= least)


def history_hits(vectors: DataFrame, query, k: int = 10, project: int | None = None, metric: str = "cosine") -> DataFrame:
    """The ``k`` entries of (chunk_id, embedding, …) nearest to a query, of one project if given; filtered before ranking, so never too few."""
    return knn(sound(vectors), query, k, metric, None if project is None else F.col("project_id") == project)


def preface(vectors: DataFrame, decisions: DataFrame, query, k: int = 3, metric: str = "cosine") -> DataFrame:
    """(place, decision_id, kind, topic, decision) of the decisions within the cutoff, to stand before the answers of a question."""
    near = decision_hits(vectors, query, k, None, metric).select(F.col("chunk_id").alias("decision_id"), "distance")
    place = F.row_number().over(Window.orderBy("distance", "decision_id"))  # k rows at most
    return near.withColumn("place", place).join(decisions.select("decision_id", F.col("kind").alias("sort"), "topic", "decision"), "decision_id").select("place", "decision_id", F.col("sort").alias("kind"), "topic", "decision").orderBy("place")


def recent(rows: DataFrame, n: int, days: int | None = None, now: Column | None = None) -> DataFrame:
    """The newest ``n`` rows by created_at, of the last ``days`` if given."""
    if days is not None:
        rows = rows.where(F.col("created_at") >= now - F.expr(f"interval {days} days"))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def decision_hits(vectors: DataFrame, query, k: int = 3, kind: str | None = None, metric: str = "cosine") -> DataFrame:
    """Nearest decisions within the cutoff, which belongs to L2 and is converted for cosine."""
    cut = DECISION_CUTOFF_L2 if metric == "l2" else DECISION_CUTOFF_L2**2 / 2
    return knn(vectors, query, k, metric, F.col("kind") == kind if kind else None).where(F.col("distance") <= cut)


def touched(entries: DataFrame, git: DataFrame, files: DataFrame, n: int = 10) -> DataFrame:
    """(rel_path, score): files that entries (summary) name, one per entry, plus one if git (rel_path) touched them."""
    named = entries.select(F.explode(path_tokens(F.col("summary"))).alias("rel_path"))
    every = named.unionByName(git.select("rel_path").distinct())
    return every.groupBy("rel_path").agg(F.count("*").alias("score")).join(files.select("rel_path"), "rel_path", "left_semi").orderBy(F.desc("score"), "rel_path").limit(n)


def pair_similarities(vectors: DataFrame, by: str) -> DataFrame:
    """(by, a, b, similarity) of the pairs a < b of each group of (by, id, embedding). Groups are clusters of few entries."""
    left = vectors.select(by, F.col("id").alias("a"), F.col("embedding").alias("x"))
    right = vectors.select(by, F.col("id").alias("b"), F.col("embedding").alias("y"))
    return left.join(right, by).where("a < b").select(by, "a", "b", F.round(dot(F.col("x"), F.col("y")), 6).alias("similarity"))


def cohesion(pairs: DataFrame, by: str) -> DataFrame:
    """Mean similarity of each group and whether any pair nearly equals."""
    return pairs.groupBy(by).agg(F.round(F.avg("similarity"), 6).alias("cohesion"), F.bool_or(F.col("similarity") > NEAR_EQUAL).alias("near_equal"))


def cohesion_by_blocks(vectors: DataFrame, by: str, rows: int = 1024) -> DataFrame:
    """:func:`cohesion` of groups of any size of (by, id, embedding): blocks of about ``rows`` entries meet as matrices, pairs are never rows."""

    def one(held: pd.DataFrame) -> pd.DataFrame:
        low, high = held["_low"].iloc[0], held["_high"].iloc[0]
        parts = [np.array(held.loc[held["_block"] == k, "embedding"].tolist(), dtype=float) for k in (low, high)]
        if not len(parts[0]) or not len(parts[1]):
            return pd.DataFrame([], columns=[by, "s", "n", "top"])
        similar = np.round(parts[0] @ parts[1].T, 6)
        pairs = similar[np.triu_indices(len(similar), 1)] if low == high else similar.ravel()
        return pd.DataFrame([(held[by].iloc[0], float(pairs.sum()), len(pairs), float(pairs.max()))] if len(pairs) else [], columns=[by, "s", "n", "top"])

    sizes = vectors.groupBy(by).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("_blocks"))
    dealt = vectors.select(by, "id", "embedding").join(F.broadcast(sizes), by).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.withColumns({"_low": F.least("_block", "_other"), "_high": F.greatest("_block", "_other")})
    kind = vectors.schema[by].dataType.simpleString()
    sums = met.groupBy(by, "_low", "_high").applyInPandas(one, f"{by} {kind}, s double, n long, top double")
    return sums.groupBy(by).agg(F.round(F.sum("s") / F.sum("n"), 6).alias("cohesion"), (F.max("top") > NEAR_EQUAL).alias("near_equal"))


def mean_vectors(vectors: DataFrame, by: str) -> DataFrame:
    """(by, embedding): the mean of each group of (by, embedding)."""
    parts = vectors.select(by, F.posexplode("embedding").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("embedding"))


#: Centres that are compared with the decisions at a time.
CENTRES = 4096


def coverage(centres: DataFrame, decisions: DataFrame, by: str | None = None) -> DataFrame:
    """(id, decision_id, similarity, covered): the decision nearest to each centre, of the same ``by`` if given; null, 0 and false without decisions.

    Centres meet the decisions in broadcast blocks of ``CENTRES``.
    """
    centres = stored(centres)
    blocks = max(1, -(-centres.count() // CENTRES))
    pairs = None
    for k in range(blocks):
        own = centres if blocks == 1 else centres.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k)
        left = own.select("id", F.col("embedding").alias("x"), *([F.col(by).alias("_by")] if by else []))
        met = decisions.join(F.broadcast(left), F.col(by) == F.col("_by")) if by else decisions.crossJoin(F.broadcast(left))
        near = met.select("id", "decision_id", F.round(dot(F.col("x"), F.col("embedding")), 6).alias("s"))
        pairs = near if pairs is None else pairs.unionByName(near)
    best = pairs.groupBy("id").agg(F.max_by("decision_id", F.struct("s", -F.col("decision_id"))).alias("decision_id"), F.max("s").alias("similarity"))
    return centres.select("id").join(best, "id", "left").select("id", "decision_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce(F.col("similarity") >= COVERED, F.lit(False)).alias("covered"))


def suggest_topic(entries: DataFrame, by: str) -> DataFrame:
    """(by, topic): the commonest token of (by, id, summary) that at least 60 % of the group's summaries have, the last of ties.

    Else the commonest tag (comma-separated ``tags``, where there), the last of
    ties; else the first summary's head; ``unknown`` if that is blank.
    """
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("summary"), F.lit("[a-z0-9]{3,}"), F.lit(0))), lambda w: ~w.isin(*STOPWORDS))
    sizes = entries.groupBy(by).agg(F.count("*").alias("n"), F.nullif(F.trim(F.substring(F.min_by("summary", "id"), 1, 60)), F.lit("")).alias("head"))
    df = entries.select(by, F.explode(words).alias("word")).groupBy(by, "word").agg(F.count("*").alias("c"))
    telling = df.join(sizes.select(by, "n"), by).where(F.col("c") >= TOPIC_SHARE * F.col("n")).groupBy(by).agg(F.max_by("word", F.struct("c", "word")).alias("word"))
    out = sizes.join(telling, by, "left")
    said = ["word", "head"]
    if "tags" in entries.columns:
        tags = entries.select(by, F.explode(F.split("tags", ",")).alias("tag")).withColumn("tag", F.trim("tag")).where("tag <> ''").groupBy(by, "tag").agg(F.count("*").alias("c"))
        out, said = out.join(tags.groupBy(by).agg(F.max_by("tag", F.struct("c", "tag")).alias("tag")), by, "left"), ["word", "tag", "head"]
    return out.select(by, F.coalesce(*said, F.lit("unknown")).alias("topic"))


def consolidated(entries: DataFrame, vectors: DataFrame, decisions: DataFrame, files: DataFrame, now: float, days: int = 90, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(themes, summary): themes of the recent log that no decision covers yet.

    ``entries`` holds (project_id, id, created_at, summary, tags), ``vectors``
    (id, embedding), ``decisions`` (project_id, decision_id, embedding), ``files``
    (project_id, rel_path). Of each project the newest ``most`` entries of the
    last ``days`` are clustered. A theme has topic, members, cohesion,
    near_equal, nearest decision and similarity, and the indexed files that its
    entries name; the summary has scanned, covered and single entries. Themes
    stand by size, then cohesion.
    """
    newest = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))
    own = entries.where(F.col("created_at") >= F.lit(float(now) - days * 86400)).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    own = stored(own.join(sound(vectors), "id"))
    # Newest first is the order that clusters grow in.
    placed = own.select("project_id", F.col("_n").cast("long").alias("id"), "embedding")
    found = clusters(placed, "project_id").withColumnRenamed("id", "_n")
    held = stored(own.join(found, ["project_id", "_n"]).withColumn("theme", F.concat_ws("/", F.col("project_id").cast("string"), F.col("cluster").cast("string"))))
    centres = mean_vectors(held, "theme").join(held.select("theme", "project_id").distinct(), "theme").withColumnRenamed("theme", "id")
    near = coverage(centres, decisions, "project_id").withColumnRenamed("id", "theme")
    sizes = held.groupBy("theme", "project_id").agg(F.count("*").alias("members"), F.bool_or("truncated").alias("truncated"))
    cohesive = cohesion_by_blocks(held.select("theme", "id", "embedding"), "theme")
    topics = suggest_topic(held.select("theme", F.col("_n").alias("id"), "summary", "tags"), "theme")
    named = held.select("theme", "project_id", F.explode(path_tokens(F.col("summary"))).alias("rel_path")).join(files.select("project_id", "rel_path"), ["project_id", "rel_path"], "left_semi")
    named = named.groupBy("theme").agg(F.array_sort(F.collect_set("rel_path")).alias("files"))
    every = sizes.join(near, "theme").join(cohesive, "theme", "left").join(topics, "theme").join(named, "theme", "left")
    themes = every.where("not covered").select("project_id", "theme", "topic", "members", "truncated", "cohesion", "near_equal", "decision_id", "similarity", F.coalesce("files", F.array().cast("array<string>")).alias("files")).orderBy(F.desc("members"), F.desc("cohesion"), "theme")
    counted = own.groupBy("project_id").agg(F.count("*").alias("scanned"))
    inside = every.groupBy("project_id").agg(F.count_if("covered").alias("covered"), F.sum("members").alias("_in"))
    summary = counted.join(inside, "project_id", "left").select("project_id", "scanned", F.coalesce("covered", F.lit(0)).alias("covered"), (F.col("scanned") - F.coalesce("_in", F.lit(0))).alias("singles"))
    return themes, summary


def greedy_clusters(similar: np.ndarray, threshold: float = LINK, linkage: str = "complete", least: int = 2) -> list[list[int]]:
    """Clusters in index order: an entry joins the first cluster all (complete) or any (single) of whose members are near enough."""
    return _greedy(lambda i: similar[i, :i], len(similar), threshold, linkage, least)


def _greedy(row, n: int, threshold: float, linkage: str, least: int = 2) -> list[list[int]]:
    """``row(i)`` gives the similarities of entry i to those before it, so that no matrix is held."""
    found: list[list[int]] = []
    home, sizes = np.zeros(n, dtype=int), np.zeros(n, dtype=int)
    for i in range(n):
        near = np.bincount(home[:i][np.asarray(row(i)) >= threshold], minlength=len(found))
        fits = np.flatnonzero(near == sizes[: len(found)] if linkage == "complete" else near > 0)
        home[i] = k = int(fits[0]) if len(fits) else len(found)
        if k == len(found):
            found.append([])
        found[k].append(i)
        sizes[k] += 1
    return [c for c in found if len(c) >= least]


def clusters(entries: DataFrame, by: str, threshold: float = LINK, linkage: str = "complete") -> DataFrame:
    """(by, cluster, id, truncated) of (by, id, embedding): greedy clusters, cut to the most central members.

    Each entry depends on those before it, so a group is one task, which holds its vectors but no matrix of pairs.
    """
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        x = np.array(rows["embedding"].tolist(), dtype=float)
        out = []
        for k, members in enumerate(_greedy(lambda i: x[:i] @ x[i], len(x), threshold, linkage)):
            near = dict(zip(members, (x[members] @ x[members].mean(axis=0)).round(12), strict=True))
            central = sorted(members, key=lambda i: (-near[i], i))
            out += [(rows[by][0], k, int(rows["id"][i]), len(members) > MAX_MEMBERS) for i in sorted(central[:MAX_MEMBERS])]
        return pd.DataFrame(out, columns=[by, "cluster", "id", "truncated"])

    kind = entries.schema[by].dataType.simpleString()
    return entries.select(by, "id", "embedding").groupBy(by).applyInPandas(one, f"{by} {kind}, cluster int, id long, truncated boolean")
