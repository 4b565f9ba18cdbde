"""PII by bootstrapped contextual extraction, with DataFrame functions only.

Seed entities (well-formed addresses and numbers) induce lexical patterns: the
words before them, the words after them, and the shape of the token itself
(digits as 0, letters as a). Patterns and the instances they introduce form a
graph whose scores are refined over a few rounds; confident patterns then mark
identifiers that no seed rule knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .spans import BLOCK, found, let, listed, tagged

KINDS = ("email", "ip", "card", "phone")
#: Possessive throughout, so that no text overflows the stack; a run is searched once, from its start or from where the match before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole runs of 12 to 19 digits; a run's digits stand at most one blank or hyphen apart.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What may be an identifier: a whole token with a digit, five code points or more.
CANDIDATE = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z0-9._%+@-]{5})[A-Za-z._%+@-]*+[0-9][A-Za-z0-9._%+@-]*+"
_DOTTED = r"[0-9]{1,30}\.[0-9]{1,30}\.[0-9]{1,30}\.[0-9]{1,30}"
#: Code points of the text that a token's patterns may read on either side.
REACH = 40
ROUNDS = 3
#: A pattern needs so many different known instances, and this share of its instances known, to extend the graph ...
SUPPORT, CONFIDENCE = 4, 0.5
#: ... and this share to mark unseen identifiers.
MARKS = 0.8
CONTEXT = "context"


def _luhn(hit: Column) -> Column:
    digits = F.reverse(F.regexp_replace(hit, "[^0-9]", ""))
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda n, i: n + F.when(value(i) > 9, value(i) - 9).otherwise(value(i))) % 10 == 0


def _digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", ""))


def base_spans(text: Column) -> dict[str, Column]:
    """The seed entities of a non-null text by kind."""
    return {
        "email": found(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(found(text, IP), lambda s: F.forall(F.split(s["hit"], r"\."), lambda p: p.cast("double") <= 255)),
        "card": F.filter(found(text, CARD), lambda s: _luhn(s["hit"])),
        "phone": F.filter(found(text, PHONE, F.contains(text, F.lit("+"))), lambda s: _digits(s["hit"]).between(9, 15)),
    }


def _words(part: Column) -> Column:
    """Lower-cased with digits as 0; null if blank."""
    return F.nullif(F.trim(F.lower(F.regexp_replace(part, "[0-9]", "0"))), F.lit(""))


def _before(left: Column) -> Column:
    """The last two words of the line before a token, if a blank or sign parts them from it; null without a letter or sign of a number."""
    words = F.substring_index(F.rtrim(F.substring_index(left, "\n", -1)), " ", -2)
    return F.when(F.right(left, F.lit(1)).isin(*" :=#(\"'") & words.rlike("[A-Za-z+#]"), _words(words))


def _after(right: Column) -> Column:
    """The first two words of the line after a token, likewise."""
    words = F.substring_index(F.ltrim(F.substring_index(right, "\n", 1)), " ", 2)
    return F.when(F.left(right, F.lit(1)).isin(*" :=)\"'") & words.rlike("[A-Za-z]"), _words(words))


def _shape(hit: Column) -> Column:
    """Digits as 0 and letters as one a; null for what a seed rule reads and rejects, and for plain letters and digits."""
    shape = F.regexp_replace(F.regexp_replace(F.substring(hit, 1, 64), "[A-Za-z]++", "a"), "[0-9]", "0")
    rejected = hit.rlike(f"^(?:{_DOTTED}|[0-9]{{12,19}})$") | ~shape.rlike("[^a0]") | (F.length(hit) > 64)
    return F.when(~rejected, shape)


def _patterns(left: Column, right: Column, hit: Column) -> Column:
    """The lexical patterns of a token, each with the side that it reads."""
    sides = F.array(F.concat(F.lit("<"), _before(left)), F.concat(F.lit(">"), _after(right)), F.concat(F.lit("="), _shape(hit)))
    return F.array_compact(sides)


def scored(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Pattern confidence from (pattern, instance, known): one row per pattern with support and confidence.

    A round sets each pattern's confidence to the mean score of its instances;
    patterns with enough support raise their other instances to the noisy-or of
    their confidences. Hot patterns are summed before the shuffle.
    """
    edges = settle(edges.groupBy("pattern", "instance").agg(F.max("known").alias("known")))
    scores = settle(edges.groupBy("instance").agg(F.max("known").cast("double").alias("score")))
    patterns = None
    for k in range(rounds):
        patterns = settle(edges.join(scores, "instance").groupBy("pattern").agg(F.sum((F.col("score") >= 0.5).cast("int")).alias("support"), F.avg("score").alias("confidence")))
        if k + 1 == rounds:
            break
        strong = patterns.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "confidence")
        raised = edges.join(strong, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("raised"))
        scores = settle(scores.join(raised, "instance", "left").select("instance", F.greatest("score", F.coalesce("raised", F.lit(0.0))).alias("score")))
    return patterns


def extract(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, base (array of start, rank, end, kind) and context (the same, found by patterns).

    Null and empty texts have no spans. Equal rows get equal results; an empty
    table gives no rows; other columns are ignored. Tokens that overlap a seed
    entity of their text are known instances and are not marked again. A token
    is marked if some confident pattern introduces it.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_key"))
    base = base_spans(F.col("text"))
    df = df.select("doc_id", "_key", "text", *(v.alias(f"_{k}") for k, v in base.items()), found(F.col("text"), CANDIDATE, F.col("text").rlike("[0-9]"), REACH).alias("_candidates"))
    every = F.concat(*(tagged(F.col(f"_{k}"), k, i) for i, k in enumerate(KINDS)))
    df = df.withColumn("base", F.array_sort(every))
    # Seeds in blocks with the range that each covers, so that a token is compared with few of them.
    blocks = let(F.col("base"), lambda own: F.transform(F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(BLOCK)), lambda b: F.slice(own, b + 1, BLOCK)))
    df = df.withColumn("_blocks", F.transform(F.filter(blocks, lambda b: F.size(b) > 0), lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("a"), F.array_max(F.transform(b, lambda s: s["end"])).alias("z"), b.alias("own"))))
    clash = lambda bs, c: F.exists(bs, lambda b: (b["a"] < c["end"]) & (c["start"] < b["z"]) & F.exists(b["own"], lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    token = lambda bs, c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lower(c["hit"]).alias("instance"), _patterns(c["left"], c["right"], c["hit"]).alias("patterns"), clash(bs, c).cast("int").alias("known"))
    tokens = let(F.struct(F.col("_candidates").alias("own"), F.col("_blocks").alias("seeds")), lambda x: F.transform(x["own"], lambda c: token(x["seeds"], c)))
    rows = settle(df.select("doc_id", "_key", "base", F.filter(tokens, lambda c: F.size(c["patterns"]) > 0).alias("tokens")))
    seen = rows.select("doc_id", "_key", F.explode("tokens").alias("c")).select("doc_id", "_key", "c.*")
    sure = scored(seen.select(F.explode("patterns").alias("pattern"), "instance", "known")).where((F.col("support") >= SUPPORT) & (F.col("confidence") >= MARKS)).select("pattern")
    unseen = seen.where("known = 0").select("doc_id", "_key", "start", "end", F.explode("patterns").alias("pattern"))
    marked = unseen.join(sure, "pattern", "left_semi").groupBy("doc_id", "_key").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit(CONTEXT).alias("kind"))).alias("context"))
    marked = marked.withColumnsRenamed({"doc_id": "_doc", "_key": "_text"})
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    return rows.join(marked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_text")), "left").select("doc_id", "base", F.coalesce("context", none).alias("context"))


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return extract(docs).select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "context")).alias("spans"))
