"""The randomness gate: how likely a text's distinct bytes, character classes and bigrams are in a random string.

All sums over lengths are looked up by the text's length in one small table, built on the driver: lengths go to 170
bytes at most, as factorials of more overflow a double and longer texts always pass. The table's size is a constant, so
it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reuse import reused

MAX_BYTES = 170
BASES = (16, 36, 64)

_HEX = "0123456789ABCDEF"
_VOWELS, _CONSONANTS = "aeiou", "bcdfghlmnprst"
_CLUSTERS = "bl br ch ck cl cr ct dr ff fl fr gh gl gr ks ld lf lk ll lp ls lt mb mm mp nc nd ng nk nn nt ph pl pp pr pt rc rd rk rl rm rn rr rs rt sc sh sk sl sm sn sp ss st th tr ts tt ty ly ry xt ey yp ym io ie ea ee oo ou ai au ue ua".split()


def default_bigrams() -> tuple[str, ...]:
    """A stand-in for a table of pairs that are common in source text, by rule: two hexadecimal digits, a vowel beside a
    frequent consonant, frequent clusters, and joints of names and paths.

    It has 488 pairs, the number that the gate is calibrated for, but not the pairs of any collected table: verdicts near
    the threshold differ from such a table's. One is given as ScanConfig.bigrams, or as a file (config.load_bigrams).
    """
    pairs = [a + b for a in _HEX for b in _HEX]
    pairs += [x for v in _VOWELS for c in _CONSONANTS for x in (v + c, c + v)]
    pairs += _CLUSTERS
    pairs += [x for c in "acdeknprst" for x in ("_" + c, c + "_")] + ["./", "..", "==", "r-", "-o", "/c", "e."]
    return tuple(dict.fromkeys(pairs))


#: The characters whose pairs the gate's table may hold.
PAIRED = "A-Za-z0-9_./=-"


def common_bigrams(texts: DataFrame, text: str, n: int = 488) -> DataFrame:
    """(pair, times, place): the n most frequent pairs of neighbouring characters in a column, for ScanConfig.bigrams; ties by the pair.

    Words are counted first, so pairs are cut from distinct words only.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(f"([{PAIRED}]{{2,}})"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("times"))
    pairs = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    counts = words.select("times", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("times").alias("times"))
    first = counts.orderBy(F.desc("times"), "pair").limit(n)
    return first.select("pair", "times", F.row_number().over(Window.orderBy(F.desc("times"), "pair")).alias("place"))


def collected_bigrams(texts: DataFrame, text: str, n: int = 488) -> tuple[str, ...]:
    """The same as a tuple, most frequent first: n pairs at most come to the driver."""
    return tuple(r["pair"] for r in common_bigrams(texts, text, n).orderBy("place").collect())


def occupancy(n: int, base: int) -> np.ndarray:
    """P(at most d distinct values among n draws from base), for d from 0 to n, by the recurrence over draws."""
    q = np.zeros(n + 1)
    q[0] = 1.0
    k = np.arange(n + 1)
    for _ in range(n):
        q[1:] = q[1:] * k[1:] / base + q[:-1] * np.maximum(base - k[1:] + 1, 0) / base
        q[0] = 0.0
    return np.cumsum(q)


def binomial_tails(n: int, p: float) -> np.ndarray:
    """For x from 0 to n: P(X <= x) if x < n * p, else P(X >= x)."""
    mass = np.array([comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    low, high = np.cumsum(mass), np.cumsum(mass[::-1])[::-1]
    return np.where(np.arange(n + 1) < n * p, low, high)


def class_rates(bigrams: Collection) -> dict[str, float]:
    return {"digit16": 10 / 16, "digit36": 10 / 36, "upper36": 26 / 36, "digit64": 10 / 64, "upper64": 26 / 64, "lower64": 26 / 64, "bigram": len(set(bigrams)) / 4096}


@lru_cache
def _length_rows(pairs: int) -> pa.Table:
    rates = class_rates(range(pairs))
    lengths = range(1, MAX_BYTES + 1)
    columns = {f"distinct{b}": [occupancy(n, b) for n in lengths] for b in BASES} | {x: [binomial_tails(n, p) for n in lengths] for x, p in rates.items()}
    return pa.table({"n": pa.array(lengths, pa.int32())} | {x: pa.array(v, pa.list_(pa.float64())) for x, v in columns.items()})


def length_table(spark: SparkSession, bigrams: Collection[str]) -> DataFrame:
    """(n, one array a probability): row n holds the distributions for texts of n bytes."""
    return spark.createDataFrame(_length_rows(len(set(bigrams))))


def base_of(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"\A[0-9a-fA-F]{16,}\z")), 16).when(F.rlike(text, F.lit(r"\A[0-9A-Z]{16,}\z")), 36).otherwise(64)


def distinct_bytes(text: Column) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1))))


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def bigram_count(text: Column, bigrams: Collection[str]) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(F.char_length(text) < 2, 0).otherwise(F.size(F.filter(pairs, lambda p: p.isin(sorted(set(bigrams))))))


DIGITS, UPPERS, LOWERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@reused
def _probabilities(text: str, bigrams: tuple[str, ...]) -> dict[str, Column]:
    """The three probabilities of a text, from the table's row for its length."""
    t, base = F.col(text), F.col("base")
    at = lambda name, x: F.get(F.col(name), x)
    distinct, digits, uppers, lowers = distinct_bytes(t), _count(t, DIGITS), _count(t, UPPERS), _count(t, LOWERS)
    return {
        "p_distinct": F.when(base == 16, at("distinct16", distinct)).when(base == 36, at("distinct36", distinct)).otherwise(at("distinct64", distinct)),
        "p_class": F.when(base == 16, at("digit16", digits))
        .when(base == 36, F.least(at("digit36", digits), at("upper36", uppers)))
        .otherwise(F.least(at("digit64", digits), at("upper64", uppers), at("lower64", lowers))),
        "p_bigram": at("bigram", bigram_count(t, bigrams)),
    }


def with_randomness(rows: DataFrame, text: str, bigrams: Sequence[str] | None = None) -> DataFrame:
    """rows plus base, p_distinct, p_class, p_bigram and p of a text column; all null beyond MAX_BYTES and for empty texts."""
    bigrams = tuple(bigrams or default_bigrams())
    t = F.col(text)
    table = F.broadcast(length_table(rows.sparkSession, bigrams).withColumnRenamed("n", "_n"))
    rows = rows.withColumns({"base": base_of(t), "_len": F.octet_length(t)})
    rows = rows.join(table, F.col("_len") == F.col("_n"), "left").withColumns(_probabilities(text, bigrams))
    base = F.col("base")
    p = F.col("p_distinct") * F.col("p_class") * F.when(base == 64, F.col("p_bigram")).otherwise(F.lit(1.0))
    return rows.withColumn("p", p).drop("_n", "_len", *[f"distinct{b}" for b in BASES], *class_rates(bigrams))


def likely(text: Column, p: Column, threshold: float) -> Column:
    """The verdict on a text with probability p: longer than MAX_BYTES passes; p below the threshold fails, and so does one below ten times the threshold without a digit."""
    return F.when(F.octet_length(text) > MAX_BYTES, True).otherwise(F.coalesce((p >= threshold) & (F.rlike(text, F.lit("[0-9]")) | (p >= 10 * threshold)), F.lit(False)))
