"""Regex matches with code-point positions, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches of a block: a position is a sum over at most so many matches and over the blocks before.
BLOCK = 256
SPANS = "array<struct<start:int,end:int,hit:string,left:string,right:string>>"
_NONE = f"cast(array() as {SPANS})"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once; an expression inside a lambda is evaluated for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def found(text: Column, pattern: str, guard: Column | None = None, reach: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start:int,end:int,hit:string,left:string,right:string>>, end exclusive.

    ``text`` must not be null. ``guard``, where false, spares the search. The
    pieces between the matches give the positions; ``left`` and ``right`` are up
    to ``reach`` code points of the text before and after the match (empty
    without a reach), read from the pieces and matches around it, so that no
    match makes the whole text be read again.
    """

    def near(side, a: Column, b: Column) -> Column:
        """The ends of two strings that stand side by side."""
        return side(F.concat(side(a, F.lit(reach)), side(b, F.lit(reach))), F.lit(reach)) if reach else F.lit("")

    def paired(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        none, n = F.array(F.lit("")), F.size(hits)
        each = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), F.concat(none, hits).alias("last"), F.slice(gaps, 2, n).alias("then"), F.concat(F.slice(hits, 2, n), none).alias("next"))
        return F.transform(F.slice(each, 1, n), lambda p: F.struct(F.length(p["gap"]).alias("gap"), p["hit"].alias("hit"), near(F.right, p["last"], p["gap"]).alias("left"), near(F.left, p["then"], p["next"]).alias("right")))

    def placed(x: Column) -> Column:
        """Positions by sums within blocks and over blocks; nothing is appended to."""
        total = lambda own: F.aggregate(own, F.lit(0), lambda n, p: n + p["gap"] + F.length(p["hit"]))
        one = lambda at, p: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + F.length(p["hit"])).alias("end"), p["hit"].alias("hit"), p["left"].alias("left"), p["right"].alias("right"))
        block = lambda at, own: F.transform(own, lambda p, i: one(at + total(F.slice(own, 1, i)), p))
        before = lambda sums, k: F.aggregate(F.slice(sums, 1, k), F.lit(0), lambda n, v: n + v)
        blocks = F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(BLOCK)), lambda k: F.slice(x, k + 1, BLOCK))
        summed = let(blocks, lambda bs: F.struct(bs.alias("blocks"), F.transform(bs, total).alias("sums")))
        return let(summed, lambda y: F.flatten(F.transform(y["blocks"], lambda own, k: let(before(y["sums"], k), lambda at: block(at, own)))))

    pairs = let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), paired)
    folded = let(pairs, placed)
    searched = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(searched, folded).otherwise(F.expr(_NONE))


def tagged(spans: Column, kind: str, rank: int) -> Column:
    """Spans with their kind and its rank, for sorting by start and then rank."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then rank."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
