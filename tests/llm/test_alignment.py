"""Token alignment against the libraries and a plain sweep, and odd texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seine.llm import alignment, tokens
from seine.llm.queries import QUERIES, vocabulary

from ..test_queries import SF

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def by_library(texts):
    """(A's ids and bytes, B's ids and bytes) of each text, by the libraries alone; none where bytes do not join."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(vocabulary(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    chars = {c: i for i, c in tokens._byte_level()}
    assert decoders.ByteLevel().decode(list(chars)[33:127]) == bytes(range(33, 127)).decode()
    for t in texts:
        if not t:
            yield None
            continue
        e, ids = a.encode(" " + t, add_special_tokens=False), b.encode(t)
        left = [bytes(chars[c] for c in x) for x in e.tokens]
        right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, map(b.id_to_piece, ids), strict=True)]
        whole = (" " + t).encode()
        yield ((e.ids, left), (ids, right)) if b"".join(left) == whole == b"".join(right) else None


def brute(rows):
    """rows: (doc_id, text) -> doc_id: the seven figures and the digest."""
    out, docs, links = {}, Counter(), {}
    for (doc, _), both in zip(rows, by_library([t for _, t in rows]), strict=True):
        if both is None:
            out[doc] = (0,) * 6 + ("",)
            continue
        spans = []
        for ids, raw in both:
            at, side = 0, []
            for i, x in zip(ids, raw, strict=True):
                side.append((at, at + len(x), i))
                at += len(x)
            spans.append(side)
        a, b = spans
        # byte by byte: the tokens that hold it, by place
        held = [[k for k, x in enumerate(side) for _ in range(x[1] - x[0])] for side in spans]
        own = [(a[i][2], b[j][2]) for i, j in dict.fromkeys(zip(*held, strict=True))]
        cuts = sorted({x[1] for x in a} & {y[1] for y in b})
        groups, at = [], [0, 0]
        for c in cuts:
            parts = []
            for k, side in enumerate(spans):
                start = at[k]
                while at[k] < len(side) and side[at[k]][1] <= c:
                    at[k] += 1
                parts.append(",".join(str(x[2]) for x in side[start : at[k]]))
            groups.append("|".join(parts))
        docs.update(set(own))
        links[doc] = own
        out[doc] = (len(a), len(b), len(groups), len(own), ";".join(groups))
    best = defaultdict(int)
    for (x, _), n in docs.items():
        best[x] = max(best[x], n)
    for doc, own in links.items():
        *n, text = out[doc]
        out[doc] = (*n, sum(docs[p] == best[p[0]] for p in own), sum(docs[p] for p in own), hashlib.sha256(text.encode()).hexdigest())
    return out


ODD = [
    (1, "a"), (2, ""), (3, None), (4, "  two  spaces "), (5, "x\n \n y\t z"), (6, "tab\tand\r\nline  nbsp 　 wide"), (7, "<|endoftext|> </s> <s> <0x41>"), (8, "a▁b"), (9, "naïve Ünïcode 漢字かな 🙂🙂 é"),
    (10, "don't I'll 'S 123 4,567.89"), (11, "ﬁ ① \x00 \x7f"), (12, "aaaa" * 3000), (13, "a"), (14, " lead"), (15, "\nlead\n"), (16, "trail \n"), (17, "word " * 9000),
]


@pytest.mark.parametrize("most", [0, 100_000])
def test_odd_texts(spark, most):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"key": F.lit(1), "n": F.lit("x"), "_key": F.lit(2)})
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(docs, vocabulary(A), vocabulary(B), most).collect()}
    expected = brute(ODD)
    assert {k: v for k, v in got.items() if v != expected[k]} == {} and len(got) == len(ODD)


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, "one two"), (None, "one two"), (1, "one two"), (1, "one two"), (2, "two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_links"], r["count_sum"]) for r in alignment.align(docs, vocabulary(A), vocabulary(B)).collect())
    expected = brute([(i, t) for i, (_, t) in enumerate(rows)])
    assert got == sorted((str(d), expected[i][3], expected[i][5]) for i, (d, _) in enumerate(rows))
    assert alignment.align(docs.limit(0), vocabulary(A), vocabulary(B)).count() == 0


def test_words_and_whole_texts_agree():
    """Texts put together from words and kinds of white space have the ids that the libraries give the whole text."""
    rng = np.random.default_rng(3)
    words = ["the", "Über", "don't", "x1,5", "漢字", "🙂", "'s", "a.b", "—", "", "<s>"]
    gaps = [" "] * 12 + ["  ", "\n", "\n\n", "\t", " \n", "\n ", " ", "　", "\r\n", "\x1c", "\x85", "\x0b ", "   "]
    texts = ["".join(words[rng.integers(len(words))] + gaps[rng.integers(len(gaps))] for _ in range(rng.integers(1, 9))) for _ in range(4000)]
    encoder = tokens.TwinEncoder(vocabulary(A), vocabulary(B))
    assert encoder.by_word
    for text, got, known in zip(texts, encoder.encode_batch(pa.array(texts)), by_library(texts), strict=True):
        assert (got is None) == (known is None), text
        if known:
            assert got[0].tolist() == known[0][0] and got[1].tolist() == known[1][0], text


def test_query_against_brute_force(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    expected = brute(list(zip(t["doc_id"], t["text"], strict=True)))
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_token_alignment"](spark, SF).collect()}
    assert got == expected
