"""Removal of repeated strings against a plain count of all windows; suffix sorting in blocks; odd rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seine.llm import substring_dedup, suffixes
from seine.llm.queries import QUERIES

from ..test_queries import SF


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256, kept) of each text."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int8)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def check(spark, rows, length):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_key": F.lit(1), "runs": F.lit(2), "key": F.lit("x"), "n_bytes": F.lit(0)})
    got = sorted(map(repr, ((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in substring_dedup.deduplicate(docs, length, texts_too=True).collect())))
    assert got == sorted(repr((d, *x)) for (d, _), x in zip(rows, brute([t for _, t in rows], length), strict=True))


def texts(seed, n, letters, longest=400):
    rng = np.random.default_rng(seed)
    base = "".join(rng.choice(list(letters), 3000))
    for i in range(n):
        parts = []
        for _ in range(rng.integers(1, 5)):
            at, k = int(rng.integers(0, 2500)), int(rng.integers(1, longest))
            parts.append(base[at : at + k] if rng.random() < 0.6 else "".join(rng.choice(list(letters), k)))
        yield i, "".join(parts)


@pytest.mark.parametrize("seed, letters, length", [(1, "abcdefgh é漢", 16), (2, "ab", 24), (3, "abcdefghij ", 200), (4, "a", 32)])
def test_against_all_windows(spark, seed, letters, length):
    check(spark, list(texts(seed, 60, letters)), length)


def test_hot_anchors_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_IN_BATCH", 3)
    monkeypatch.setattr(substring_dedup, "HELD_ANCHORS", 200)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 4000)
    passage = "this passage stands in a great many of the texts, and what is around it differs"
    rows = list(texts(5, 80, "abcdefgh ")) + [(1000 + i, f"{chr(97 + i % 26) * (i % 7)}{i}{passage}{i % 5}{'x' * (i % 3)}") for i in range(80)]
    check(spark, rows, 16)


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 23) + chr(97 + i % 11) for i in range(400))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (None, "short"), (None, "short"), (4, long[:300] + "tail"), (5, "é" * 500), (6, "ab" * 300), (7, "x" + long[5:])]
    check(spark, rows, 200)
    check(spark, [(1, "aaaa" * 100)], 200)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.deduplicate(empty).count() == 0
    assert substring_dedup.deduplicate(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["n_removed"] == 0
    with pytest.raises(ValueError):
        substring_dedup.deduplicate(empty, 12)


def test_long_texts_in_parts():
    """Anchors do not depend on the parts in which a text is looked at."""
    rng = np.random.default_rng(2)
    raw = bytes(rng.integers(97, 100, 5000).astype(np.uint8)) + b"a" * 700
    whole, parts = (substring_dedup.Anchors(200, chunk).of(raw) for chunk in (1 << 20, 333))
    # the longer parts leave fewer bits of a hash, which decides between others
    for at, grams, first in (whole, parts):
        assert len(at) == len(grams) == len(first) and first[0] == 0 and np.all(np.diff(first) > 0) and np.all(np.diff(at) > 0)
        stop = np.append(first[1:], len(raw) - 199)
        assert np.all(first <= at) and np.all(at <= first + 100) and np.all(at >= stop - 1)
    again = substring_dedup.Anchors(200, 333).of(b"xyz" * 100 + raw)
    assert {*(parts[0] + 300).tolist()} >= {x for x in again[0].tolist() if x >= 600}


@pytest.mark.parametrize("v", [8, 16, 32, 64])
def test_difference_cover(v):
    inside, shift = suffixes.difference_cover(v)
    assert all(inside[(a + shift[a, b]) % v] and inside[(b + shift[a, b]) % v] for a in range(v) for b in range(v)) and inside.sum() <= 2 * v**0.5


def test_suffix_order_and_repeats():
    rng = np.random.default_rng(1)
    for _ in range(200):
        length, letters = int(rng.choice([8, 16, 40, 200])), int(rng.choice([1, 2, 3, 26]))
        base = rng.integers(97, 97 + letters, 600).astype(np.uint8)
        contexts, windows, bucket = [], [], []
        for _ in range(rng.integers(1, 15)):
            n, at = int(rng.integers(1, 60)), int(rng.integers(0, 300))
            c = base[at : at + n + length - 1].copy()
            if rng.random() < 0.5:
                c[rng.integers(len(c))] = rng.integers(97, 97 + letters)
            contexts.append(c.tobytes())
            windows.append(n)
            bucket.append(int(rng.integers(3)))
        got = suffixes.repeated(contexts, np.array(windows), np.array(bucket), length)
        count = Counter((b, c[i : i + length]) for c, n, b in zip(contexts, windows, bucket, strict=True) for i in range(n))
        assert [g.tolist() for g in got] == [[count[b, c[i : i + length]] > 1 for i in range(n)] for c, n, b in zip(contexts, windows, bucket, strict=True)]
        # the order of whole suffixes, where none is tied beyond the cover's ranks
        text = suffixes.Text(contexts[0], 300)
        at = np.arange(len(contexts[0]))
        ranks = suffixes.CoverRanks(text, np.array([[0, len(at)]]), 256)
        raw = contexts[0] + bytes(600)
        order = suffixes.suffix_order(text, at, np.zeros(len(at), np.int64), ranks)
        assert [raw[i : i + 256] for i in order] == sorted(raw[i : i + 256] for i in at)


def test_query_against_all_windows(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    got = sorted(tuple(r) for r in QUERIES["op11_suffix_dedup"](spark, SF).collect())
    assert got == sorted((d, *x[:4]) for d, x in zip(t["doc_id"], brute(t["text"], 200), strict=True)) and any(g[2] for g in got)
