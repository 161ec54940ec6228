"""What each filter of a chain removes in every order of the chain, and its Shapley share.

A document is a mask of the filters that it fails, so all orders follow from the counts of the masks: the cells of a
part, 2^k of them at most. The orders are visited by single swaps of neighbours; a swap changes the union of the
filters before one step only, so the figures of two steps are made anew from the cells and all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, copy_groups, lookup, text_key

#: What a cell counts, and a step with it: documents, good ones, toxic ones.
COUNTS = ("docs", "good", "toxic")
MOST_FILTERS = 8


def text_filters(text: str = "text") -> dict[str, Column]:
    """The failure conditions that a document's own text decides: A few words, B few different words, C capitals, D marks."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = blank_words(F.col(text))
    capitals = F.char_length(whole) - F.char_length(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals > 5 * F.char_length(whole),
        "D": F.rlike(whole, F.lit(r"[#$%&*|]")),
    }


def swaps(n: int) -> Iterator[int]:
    """The places k of the swaps (k, k + 1) that visit all orders of n things, each once: the largest that can move does, in its direction."""
    order, left = list(range(n)), [True] * n
    while True:
        for x in reversed(range(n)):
            at = order.index(x)
            to = at - 1 if left[x] else at + 1
            if 0 <= to < n and order[to] < x:
                order[at], order[to] = order[to], x
                left[x + 1 :] = [not d for d in left[x + 1 :]]
                yield min(at, to)
                break
        else:
            return


class Walk:
    """The figures of all orders of the filters of one part, from its cells: masks, and counts of shape (cells, 3)."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray, filters: int):
        self.masks, self.counts = masks, counts
        self.order = list(range(filters))
        self.total = counts.sum(axis=0)
        self.fails = np.array([counts[masks >> f & 1 == 1, 0].sum() for f in self.order], np.int64)
        self.alone = np.array([counts[masks == 1 << f, 0].sum() for f in self.order], np.int64)
        self.removed = np.zeros((filters, len(COUNTS)), np.int64)
        self.kept = np.zeros(filters, np.int64)
        self.shapley = np.zeros(filters, np.int64)
        before, left = 0, self.total[0]
        for step, f in enumerate(self.order):
            self.removed[step] = self._removed(f, before)
            left = self.kept[step] = left - self.removed[step, 0]
            before |= 1 << f
        self.add()

    def _removed(self, f: int, before: int) -> np.ndarray:
        return self.counts[(self.masks >> f & 1 == 1) & (self.masks & before == 0)].sum(axis=0)

    def add(self) -> None:
        """Add the order's figures to the filters' shares."""
        self.shapley[self.order] += self.removed[:, 0]

    def swap(self, k: int) -> None:
        """Go on to the order with steps k and k + 1 swapped."""
        start = self.kept[k] + self.removed[k, 0]
        before = sum(1 << f for f in self.order[:k])
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
        self.removed[k] = self._removed(self.order[k], before)
        self.removed[k + 1] = self._removed(self.order[k + 1], before | 1 << self.order[k])
        self.kept[k] = start - self.removed[k, 0]  # what is kept after both steps stays
        self.add()


def audit_part(masks: np.ndarray, counts: np.ndarray, names: Sequence[str]) -> pd.DataFrame:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of all orders of one part."""
    n = len(names)
    walk = Walk(masks, counts, n)
    orders, rows = [], []
    for k in (None, *swaps(n)):
        if k is not None:
            walk.swap(k)
        orders.append(list(walk.order))
        rows.append(np.column_stack([walk.kept, walk.removed]))
    order, rows = np.concatenate(orders), np.concatenate(rows)
    return pd.DataFrame(
        {
            "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], n), "step": np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders)),
            "kept": rows[:, 0], "removed": rows[:, 1], "redundant": walk.fails[order] - rows[:, 1], "unique_fails": walk.alone[order], "good_lost": rows[:, 2], "toxic_lost": rows[:, 3], "shapley": walk.shapley[order],
        }
    )


def audit(docs: DataFrame, filters: Mapping[str, Column], part: str, good: Column, toxic: Column) -> DataFrame:
    """A row for each part, order of the filters (a mapping of names to failure conditions) and step.

    part: a string column; null counts as the empty string. Conditions and flags that are null are false. Rows shrink to
    cells before the only shuffle, and a part's cells, 2^filters at most, are one group whatever its size. An empty table
    gives no rows; repeated rows count each; docs may have columns of any other names.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters: all orders of more are too many rows")
    names = list(filters)
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    rows = docs.select(F.coalesce(F.col(part), F.lit("")).alias("part"), mask.cast("int").alias("mask"), good.alias("good"), toxic.alias("toxic"))
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))

    def walk(key: tuple, part_cells: pd.DataFrame) -> pd.DataFrame:
        out = audit_part(part_cells["mask"].to_numpy(), part_cells[list(COUNTS)].to_numpy(np.int64), names)
        out.insert(0, "part", key[0])
        return out

    return cells.groupBy("part").applyInPandas(walk, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """audit() of the filters A to E over documents (doc_id, text, source) by source, with labels (doc_id, quality, toxic).

    E fails documents that repeat the text (null: empty) of a smaller doc_id anywhere in the table; a null doc_id is neither
    smaller nor larger than any, and rows of equal doc_id and text are no earlier copies of each other. A document is good
    or toxic if any label of its doc_id says so; a null doc_id has none. Null and empty texts fail A only, but for E.
    """
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    marks = marks.filter("doc_id is not null and (_good = 1 or _toxic = 1)")
    # texts end here: what goes on is a few bytes a document
    own = text_filters()
    narrow = docs.select("doc_id", "source", text_key(F.col("text")).alias("_key"), *[c.alias(f"_{x}") for x, c in own.items()])
    known = lookup(narrow, copy_groups(narrow.select("doc_id", "_key")), ["_key"])
    known = known.join(marks, "doc_id", "left")
    filters = {x: F.col(f"_{x}") for x in own} | {"E": F.col("doc_id") > F.col("_first")}
    return audit(known, filters, "source", F.col("_good") == 1, F.col("_toxic") == 1)
