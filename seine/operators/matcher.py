"""Matching the pattern library against lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entropy import likely, with_randomness
from ..functions.patterns import DIALECT, Pattern
from ..functions.reuse import reused
from .predicates import any_of, contains_one

#: Two code points that are no characters stand around matches while they are cut out; in a line they become a third one
#: of equal length.
_OPEN, _CLOSE, _OTHER = "\ufdd0", "\ufdd1", "\ufffd"


def gate(line: Column, pattern: Pattern) -> Column:
    """A cheap test that every line with a match passes."""
    return any_of(line.contains(a) for a in pattern.anchors) if pattern.anchors else F.lit(True)


def gate_all(line: Column, patterns: Sequence[Pattern]) -> Column:
    """gate() of any of the patterns, as one small expression: a long disjunction would compile to a method too large for the JVM's compiler."""
    if not all(p.anchors for p in patterns):
        return F.lit(True)
    anchors = dict.fromkeys(a for p in patterns for a in p.anchors)
    return contains_one(line, [a for a in anchors if not any(b in a and b != a for b in anchors)])


def matches_of(line: Column, pattern: Pattern) -> Column:
    """array<struct<chars_before, matched>> of all matches, left to right, not overlapping; empty ones are dropped.

    One pass of the expression puts marks around its matches; cut at the marks, the line alternates between what no
    match holds and matches, so places are exact whatever the expression looks at around a match.
    """
    marked = F.regexp_replace(line, f"{DIALECT}{pattern.regex}", f"{_OPEN}$0{_CLOSE}")
    return F.split(marked, f"[{_OPEN}{_CLOSE}]")


@reused
def gate_lines(line: str, patterns: tuple[Pattern, ...]) -> Column:
    return gate_all(F.col(line), patterns)


@reused
def _clean(line: str) -> Column:
    clean = F.translate(F.col(line), _OPEN + _CLOSE, _OTHER * 2)
    return F.when(F.col(line).contains(_OPEN) | F.col(line).contains(_CLOSE), clean).otherwise(F.col(line))


@reused
def _hits(line: str, patterns: tuple[Pattern, ...]) -> Column:
    """A row for each expression that matches in _clean."""
    empty = F.lit(None).cast("struct<pattern_id:int,name:string,description:string,parts:array<string>,first:string,regex:string>")
    found = []
    for i, p in enumerate(patterns, 1):
        expression = f"{DIALECT}{p.regex}"
        first = F.regexp_extract(F.col("_clean"), expression, 1) if p.groups else F.lit("")
        hit = F.struct(F.lit(i).alias("pattern_id"), F.lit(p.name).alias("name"), F.lit(p.description).alias("description"), matches_of(F.col("_clean"), p).alias("parts"), first.alias("first"), F.lit(expression if p.groups else None).cast("string").alias("regex"))
        found.append(F.when(gate(F.col(line), p) & F.rlike("_clean", F.lit(expression)), hit).otherwise(empty))
    return F.explode(F.filter(F.array(*found), lambda h: h.isNotNull()))


@reused
def _ends() -> Column:
    # parts: outside, match, outside, match, ..., outside
    return F.transform(F.col("_hit.parts"), lambda x: F.octet_length(x))


@reused
def _spots() -> Column:
    """A row for each match of a hit, and its first byte."""
    parts = F.col("_hit.parts")
    spots = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2)),
        lambda i: F.struct(F.get(parts, i).alias("m"), F.aggregate(F.slice(F.col("_ends"), F.lit(1), i), F.lit(0), lambda a, x: a + x).alias("at")),
    )
    return F.explode(F.when(F.size(parts) > 1, spots))


def find(lines: DataFrame, patterns: Sequence[Pattern], line: str = "line", strict_groups: bool = False) -> DataFrame:
    """A row for each match: all columns of lines, and pattern_id, secret_type, pattern_description, matched_text,
    start_pos, end_pos (bytes from 0, end exclusive) and secret.

    secret is what the gate judges. For an expression with a group it is group 1 of the line's first match (with
    strict_groups: of this match), or the matched text if that group took no part; else the matched text. Everything
    stays in one stage without a shuffle.
    """
    patterns = tuple(patterns)
    rows = lines.filter(gate_lines(line, patterns)).withColumn("_clean", _clean(line))
    rows = rows.withColumn("_hit", _hits(line, patterns)).drop("_clean")
    rows = rows.withColumn("_ends", _ends()).withColumn("_spot", _spots()).filter("_spot.m != ''")
    matched, hit = F.col("_spot.m"), F.col("_hit")
    own = F.when(hit["regex"].isNotNull(), F.call_function("regexp_extract", matched, hit["regex"], F.lit(1))) if strict_groups else hit["first"]
    out = rows.withColumns(
        {
            "pattern_id": hit["pattern_id"], "secret_type": hit["name"], "pattern_description": hit["description"], "matched_text": matched,
            "start_pos": F.col("_spot.at"), "end_pos": F.col("_spot.at") + F.octet_length(matched), "secret": F.coalesce(F.nullif(own, F.lit("")), matched),
        }
    )
    return out.drop("_hit", "_ends", "_spot")


def gated(found: DataFrame, threshold: float, bigrams: Sequence[str] | None = None) -> DataFrame:
    """The matches whose secret is likely random."""
    judged = with_randomness(found, "secret", bigrams)
    return judged.filter(likely(F.col("secret"), F.col("p"), threshold)).drop("base", "p_distinct", "p_class", "p_bigram", "p")
