"""Secret scans over a ledger of content-addressed blobs, with DataFrame functions only.

Every version of a file is a blob, addressed by the SHA-256 of its text. A
blob is searched once for each version of each rule; the ledger keeps which
pairs are done and what they found, and findings are joined back to every path
that holds the blob.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .spans import SPANS, found, listed

#: (name, version): the base rules first, in the order of their rank.
RULES = (("assign", 1), ("access", 1), ("hex", 1), ("pem", 1), ("forge", 1), ("jwt", 1))
BASE = ("assign", "access", "hex")
_VALUE = r"[A-Za-z0-9+/_.=-]"
_ASSIGN_HEAD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = _ASSIGN_HEAD + _VALUE + "+"
#: A whole match whose value has 8 characters or more.
_ASSIGN_LONG = f"^{_ASSIGN_HEAD}{_VALUE}{{8,}}$"
#: Runs of the whole alphabet at once, so that only those long enough match.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
FORGE = r"gh[opsru]_[A-Za-z0-9]{36,}"
#: A header is at most 500 signs, so that a run of starts is not searched to its end again and again.
JWT = r"eyJ[A-Za-z0-9_-]{10,500}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
LEDGER = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"


def matches(text: Column, rule: str) -> Column:
    """array<struct<start, end, hit>> of a rule in a non-null text."""
    if rule == "assign":
        return F.filter(found(text, ASSIGN), lambda s: s["hit"].rlike(_ASSIGN_LONG))
    guards = {"access": "AKIA", "pem": "PRIVATE KEY-----", "forge": "gh", "jwt": "eyJ"}
    return found(text, {"access": ACCESS, "hex": HEX, "pem": PEM, "forge": FORGE, "jwt": JWT}[rule], F.contains(text, F.lit(guards[rule])) if rule in guards else None)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger entries) of ``docs`` with doc_id as the path.

    Findings hold one row per document row: doc_id, blob and found, an array
    of (start, rank, end, kind). New ledger entries hold a row for each blob
    and rule version that ``ledger`` lacks, with its spans; appending them and
    passing the whole as ``ledger`` again makes the next scan incremental. Null
    and empty texts are one blob without findings; equal rows get equal
    results; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    paths = settle(docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob")))
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    wanted = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(n).alias("rule"), F.lit(v).alias("version")) for i, (n, v) in enumerate(rules)))
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
        blobs = blobs.join(done, "blob", "left")
        wanted = F.filter(wanted, lambda w: ~F.coalesce(F.array_contains("done", F.struct(w["rule"].alias("rule"), w["version"].alias("version"))), F.lit(False)))
    unseen = blobs.select("blob", "doc_id", wanted.alias("wanted")).where(F.size("wanted") > 0)
    # One path per unseen blob brings its text; a doc_id that repeats with other text is told apart by the digest.
    keyed = docs.withColumn("blob", F.unhex(F.sha2("text", 256)))
    searched = keyed.join(unseen, keyed["blob"].eqNullSafe(unseen["blob"]) & keyed["doc_id"].eqNullSafe(unseen["doc_id"])).select(keyed["text"], unseen["blob"], unseen["wanted"])
    empty = F.expr(f"cast(array() as {SPANS})")

    def searching(name: str, version: int) -> Column:
        due = F.exists("wanted", lambda w: (w["rule"] == name) & (w["version"] == version))
        spans = F.transform(F.when(due, matches(F.col("text"), name)).otherwise(empty), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.struct(F.lit(name).alias("rule"), F.lit(version).alias("version"), spans.alias("spans"))

    per_rule = [searching(n, v) for n, v in rules]
    results = F.filter(F.array(*per_rule), lambda r: F.exists("wanted", lambda w: (w["rule"] == r["rule"]) & (w["version"] == r["version"])))
    new = searched.select("blob", F.explode(results).alias("r")).select("blob", "r.rule", F.col("r.version").cast("int").alias("version"), "r.spans")
    new = settle(new.groupBy("blob", "rule", "version").agg(F.first("spans").alias("spans")), release=True)
    current = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(v).alias("version")) for n, v in rules))
    every = new if ledger is None else ledger.select("blob", "rule", "version", "spans").unionByName(new)
    rank = F.element_at(F.create_map(*(x for i, (n, _) in enumerate(rules) for x in (F.lit(n), F.lit(i)))), F.col("rule"))
    hits = every.where((F.size("spans") > 0) & F.array_contains(current, F.struct("rule", "version")))
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), F.col("rule").alias("kind"))).alias("own"))
    hits = hits.groupBy("blob").agg(F.flatten(F.collect_list("own")).alias("found"))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)")
    findings = paths.join(hits, "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))
    return findings, new


def ledgered(docs: DataFrame, batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """(findings of all rows, ledger): the rows arrive in ``batches`` by a hash of doc_id, and each scan starts from the stored ledger.

    A scan searches only the (blob, rule version) pairs that the ledger lacks,
    so copies in later batches cost a lookup; the last scan joins the findings
    back to every path of every batch. The result is that of one scan of all.
    """
    ledger, findings = None, None
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for k in range(batches):
        arrived = docs if k + 1 == batches else docs.where(batch <= k)
        findings, new = scan(arrived, ledger)
        ledger = new if ledger is None else ledger.unionByName(new)
    return findings, ledger


def report(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Counts by base rule, the digest of the base spans and all spans; without a ``ledger`` one is built batch by batch."""
    findings, _ = ledgered(docs) if ledger is None else scan(docs, ledger)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return findings.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
