"""The filter audit against all orders worked out one by one, and odd rows."""

import itertools
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seine.llm import filter_audit


def brute(rows, names):
    """rows: (part, mask, good, toxic)."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in itertools.permutations(range(len(names))):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1] >> f & 1]
                fails = sum(r[1] >> f & 1 for r in own)
                left = [r for r in left if not r[1] >> f & 1]
                shapley[f] += len(gone)
                out[part, "".join(names[i] for i in order), step] = (len(left), len(gone), fails - len(gone), sum(r[1] == 1 << f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f)
        for k, v in out.items():
            if k[0] == part:
                out[k] = (*v[:6], shapley[v[6]])
    return out


def test_swaps_visit_all_orders_once():
    for n in (1, 2, 3, 5):
        order, seen = list(range(n)), [tuple(range(n))]
        for k in filter_audit.swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert len(seen) == len(set(seen)) == len(list(itertools.permutations(range(n))))


def test_audit_against_every_order(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{int(rng.integers(3))}", int(rng.integers(16)), int(rng.integers(2)), int(rng.integers(2))) for _ in range(200)] + [("one", 0, 1, 0)]
    names = "WXYZ"
    docs = spark.createDataFrame([(*r, "mask", 1) for r in rows], "p string, m int, g int, t int, mask string, docs int")
    filters = {x: F.col("m").bitwiseAND(1 << i) > 0 for i, x in enumerate(names)}
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(docs, filters, "p", F.col("g") == 1, F.col("t") == 1).collect()}
    assert got == brute(rows, names)


def test_odd_documents(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, words, "a"), (2, words, "a"), (2, words, "a"), (None, words, "a"), (3, None, None), (4, "", ""), (5, "x # y", "b"), (6, words + "$ ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2, "b")],
        "doc_id long, text string, source string",
    ).withColumn("part", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (None, 1, 1), (99, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit_documents(docs, labels).collect()}
    assert len(got) == 3 * 120 * 5
    # copies of doc 1: both rows of doc 2, not the row without an id
    e = got["a", "EABCD", 1]
    assert (e["kept"], e["removed"], e["unique_fails"], e["good_lost"], e["toxic_lost"], e["shapley"]) == (2, 2, 2, 0, 2, 240)
    # null and '' are one part, and one text: 4 repeats 3
    a = got["", "AEBCD", 1]
    assert (a["kept"], a["removed"], a["redundant"], a["shapley"]) == (0, 2, 0, 120 + 60)
    assert (got["", "AEBCD", 2]["removed"], got["", "AEBCD", 2]["redundant"]) == (0, 1)
    assert (got["b", "DCABE", 1]["removed"], got["b", "CDABE", 1]["removed"]) == (2, 1)
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_documents(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
