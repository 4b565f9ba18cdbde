"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrykit.functions.store import stored
from quarrykit.functions.text import TERM, decompress

# Fusion constant, over-fetch, boosts and budget.
RRF_K, OVERFETCH, LEAST_FETCH = 60, 3, 30
GIT_BOOST, SESSION_BOOST, DEGREE_BOOST, TOKENS_A_HIT = 0.01, 0.02, 0.005, 40
K1, B = 1.2, 0.75


def find(chunks: DataFrame, name: str, mode: str = "exact", limit: int = 20) -> DataFrame:
    """Chunks by name or qualified name: exact, prefix or regex; exact names first, then by id."""
    match = {"exact": lambda c: c == name, "prefix": lambda c: c.startswith(name), "regex": lambda c: c.rlike(name)}[mode]
    hit = F.coalesce(match(F.col("name")), F.lit(False)) | F.coalesce(match(F.col("qualified_name")), F.lit(False))
    return chunks.where(hit).orderBy(F.desc(F.coalesce(F.col("name") == name, F.lit(False))), "chunk_id").limit(limit)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Distance of unit vectors: cosine, l2 or ip (the negated inner product)."""
    ip = dot(a, b)
    return {"cosine": F.greatest(1 - ip, F.lit(0.0)), "l2": F.sqrt(F.greatest(2 - 2 * ip, F.lit(0.0))), "ip": -ip}[metric]


def knn(vectors: DataFrame, query: list[float] | DataFrame, k: int = 10, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The ``k`` rows of (chunk_id, embedding, …) nearest to one query vector, filtered before ranking.

    The query is one row; each task keeps its own k best, so nothing is shuffled but those.
    """
    rows = vectors if where is None else vectors.where(where)
    if isinstance(query, DataFrame):
        rows = rows.crossJoin(F.broadcast(query.select(F.col("embedding").alias("_query")).limit(1)))
    else:
        rows = rows.withColumn("_query", F.lit([float(x) for x in query]))
    return rows.withColumn("distance", F.round(distance(F.col("embedding"), F.col("_query"), metric), 6)).drop("_query").orderBy("distance", "chunk_id").limit(k)


def bm25(chunks: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """(chunk_id, score): chunks with any of the terms, by BM25 over stored_text.

    One pass over the texts counts words and query terms inside each chunk and
    stores those few numbers; statistics and scores read them, so no text is
    read or split again and no posting of another term is built or shuffled.
    """
    terms = sorted({t.lower() for t in terms})
    low = F.lower(F.coalesce("stored_text", F.lit("")))

    def tf(term: str) -> Column:
        hits = F.regexp_count(F.col("t"), F.lit(rf"(?<![a-z0-9_A-Z]){re.escape(term)}(?![a-z0-9_A-Z])"))
        return F.when(F.contains("t", F.lit(term)), hits).otherwise(0)

    counted = stored(chunks.select("chunk_id", low.alias("t")).select("chunk_id", F.regexp_count("t", F.lit(TERM)).alias("length"), *(tf(t).alias(f"tf{i}") for i, t in enumerate(terms))))
    corpus = counted.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    scored = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(terms))) or "false").crossJoin(F.broadcast(corpus))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log1p((F.col("n") - df + 0.5) / (df + 0.5))
        total = total + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))).otherwise(0.0)
    return scored.select("chunk_id", F.round(total, 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


_LEX = re.compile(r'\s*(?:(\()|(\))|"([^"]*)"(\*?)|((?:[A-Za-z_]+:)?[A-Za-z0-9_]+)(\*?)|\S)')


def predicate(query: str, columns: tuple[str, ...] = ("name", "qualified_name", "stored_text")) -> Column:
    """A full-text query as a predicate: words (all needed), OR, NOT, parentheses, "phrases", prefix*, column:word."""
    tokens = [m for m in _LEX.finditer(query) if m[0].strip()]
    at = 0

    def test(pattern: str, where: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for c in where:
            hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).rlike(pattern)
        return hit

    def word(m: re.Match) -> Column:
        if m[3] is not None:
            parts = re.findall(r"[a-z0-9_]+", m[3].lower())
            body, star, where = "[^a-z0-9_]+".join(parts), m[4], columns
        else:
            column, _, name = m[5].rpartition(":")
            body, star, where = name.lower(), m[6], (column,) if column in columns else columns
        return test(f"(?<![a-z0-9_]){body}" + ("" if star else "(?![a-z0-9_])"), where)

    # An operator without its operand asks nothing: None, which the others leave out.
    def unit() -> Column | None:
        nonlocal at
        m = tokens[at]
        at += 1
        if m[5] == "NOT":
            inner = unit() if at < len(tokens) and not tokens[at][2] else None
            return None if inner is None else ~inner
        if m[1]:
            out = either()
            at += 1  # the closing parenthesis
            return out
        return word(m) if re.search("[A-Za-z0-9_]", m[3] if m[3] is not None else m[5] or "") else None

    def both() -> Column | None:
        nonlocal at
        out = None
        while at < len(tokens) and not tokens[at][2] and tokens[at][5] != "OR":
            if tokens[at][5] == "AND":
                at += 1
                continue
            part = unit()
            out = part if out is None else out if part is None else out & part
        return out

    def either() -> Column | None:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at][5] == "OR":
            at += 1
            part = both()
            out = part if out is None else out if part is None else out | part
        return out

    asked = None
    while at < len(tokens):
        part = either()
        asked = part if asked is None else asked if part is None else asked & part
        at += 1  # a closing parenthesis that nothing opened
    return F.lit(False) if asked is None else asked


def grep(chunks: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Chunks that satisfy the query, ranked by BM25 of its words."""
    held = chunks.where(predicate(query))
    words = [w for w in re.findall(r"[A-Za-z0-9_]{2,}", query) if w not in ("AND", "OR", "NOT")]
    ranked = bm25(chunks, words, 1 << 30) if words else held.select("chunk_id", F.lit(0.0).alias("score"))
    return held.select("chunk_id").join(ranked, "chunk_id", "left").select("chunk_id", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def scoped(rows: DataFrame, files: DataFrame, project: int | None = None, kind: str | None = None, lang: str | None = None) -> DataFrame:
    """``rows`` (file_id, kind, …) of one project, chunk kind and file language; a None asks nothing. Applied before any ranking."""
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if project is None and lang is None:
        return rows
    held = files
    for column, value in (("project_id", project), ("lang", lang)):
        held = held if value is None else held.where(F.col(column) == value)
    return rows.join(held.select("file_id"), "file_id", "left_semi")


def family(chunks: DataFrame, chunk_id: int) -> DataFrame:
    """A split chunk's parent and parts in order, from any of them; an ordinary chunk alone."""
    asked = chunks.where(F.col("chunk_id") == chunk_id).select(F.when((F.col("kind") == "big_subchunk") & F.col("parent_id").isNotNull(), F.col("parent_id")).otherwise(F.col("chunk_id")).alias("_root"))
    own = chunks.join(F.broadcast(asked.limit(1)), (F.col("chunk_id") == F.col("_root")) | (F.col("parent_id") == F.col("_root")))
    order = F.when(F.col("chunk_id") == F.col("_root"), -1).otherwise(F.col("sibling_order"))
    return own.withColumn("place", order.cast("int")).drop("_root").orderBy("place", "chunk_id")


def citations(hits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk_id, citation, body) of hits: ``path:first-last name`` and the chunk as JSON, its blanks restored."""
    where = F.concat_ws(" ", F.concat(F.col("rel_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")), F.coalesce("qualified_name", "name"))
    named = hits.select("chunk_id").join(chunks, "chunk_id").join(files.select("file_id", "rel_path"), "file_id")
    return named.select("chunk_id", where.alias("citation"), F.to_json(F.struct("rel_path", "start_line", "end_line", "kind", decompress(F.col("stored_text")).alias("text"))).alias("body"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The embedding sink: (chunk_id, embedding) as arrays of float, one file set per project if there is one."""
    out = vectors.select(*[c for c in ("project_id",) if c in vectors.columns], "chunk_id", F.col("embedding").cast("array<float>").alias("embedding"))
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy("project_id") if "project_id" in out.columns else writer).parquet(path)


def ranked(hits: DataFrame, order: list[Column]) -> DataFrame:
    """(chunk_id, rank) of a short result list, from 1."""
    return hits.select("chunk_id", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def fuse(vector: DataFrame, text: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of two short ranked lists (chunk_id, rank)."""
    both = vector.select("chunk_id", F.col("rank").alias("v")).join(text.select("chunk_id", F.col("rank").alias("t")), "chunk_id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    return both.select("chunk_id", F.round(part("v") + part("t"), 9).alias("score"), "v", "t").orderBy(F.desc("score"), F.asc_nulls_last("v"), F.asc_nulls_last("t")).limit(limit)


def rerank(fused: DataFrame, git: DataFrame, session: DataFrame, degrees: DataFrame) -> DataFrame:
    """Fused hits (chunk_id, file_id, score) with boosts for recent, mentioned and central files.

    ``git`` and ``session`` hold file_ids, ``degrees`` (file_id, in_degree).
    """
    flagged = fused.join(git.select("file_id", F.lit(1).alias("g")).distinct(), "file_id", "left").join(session.select("file_id", F.lit(1).alias("s")).distinct(), "file_id", "left").join(degrees, "file_id", "left")
    boost = F.coalesce(F.col("g") * GIT_BOOST, F.lit(0.0)) + F.coalesce(F.col("s") * SESSION_BOOST, F.lit(0.0)) + DEGREE_BOOST * F.log1p(F.coalesce("in_degree", F.lit(0)))
    return flagged.withColumn("score", F.round(F.col("score") + boost, 9)).drop("g", "s", "in_degree").orderBy(F.desc("score"), "chunk_id")


def within_budget(hits: DataFrame, order: list[Column], budget: int) -> DataFrame:
    """Ranked hits with ``kept``: as many as the token budget allows, one at least; all if it is 0 or less."""
    n = F.row_number().over(Window.orderBy(*order))
    return hits.withColumn("rank", n).withColumn("kept", F.lit(True) if budget <= 0 else F.col("rank") <= max(1, budget // TOKENS_A_HIT))


def ask(chunks: DataFrame, vectors: DataFrame, question: str, query: list[float] | DataFrame, k: int, git: DataFrame, session: DataFrame, degrees: DataFrame) -> DataFrame:
    """Hybrid search: vector and lexical channels, fused, reranked, cut to ``k``. Question words are literals."""
    fetch = max(OVERFETCH * k, LEAST_FETCH)
    near = ranked(knn(vectors, query, fetch), [F.col("distance"), F.col("chunk_id")])
    words = re.findall(TERM, question)
    said = ranked(bm25(chunks, words, fetch), [F.desc("score"), F.col("chunk_id")])
    fused = fuse(near, said, fetch).join(chunks.select("chunk_id", "file_id"), "chunk_id")
    return rerank(fused, git, session, degrees).select("chunk_id", "file_id", "score").limit(k)


def hashed_encoder(text: Column, width: int = 64) -> Column:
    """A deterministic stand-in for a sentence encoder: signed counts of hashed terms, at length 1."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * width)).cast("int"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (F.size(F.filter(places, lambda p: p == i)) - F.size(F.filter(places, lambda p: p == i + width))).cast("double"))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float"))
