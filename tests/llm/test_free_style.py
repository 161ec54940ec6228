"""Joins, chats, token files, counts, pages and the pipeline against plain Python, and their edge cases."""

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seine.llm import chat, common, html_text, jaccard_join, labelled_pages, token_counts, token_files
from seine.llm.queries import QUERIES
from seine.llm.tokens import PrefixCounter, WordEncoder, longest_prefix

from ..test_queries import SF
from .test_native import DOCS, LONG, WORD, clashing, empty_docs, odd_docs

P = pytest.importorskip("public_tokenizers")

# --- n-gram Jaccard join


def grams(text, n=5):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def naive_classes(texts, similarity=0.8):
    """By brute force: for each text the smallest index of its class, and its links."""
    sets = [grams(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(texts))], links


def near_copies(rng, base, n, most=3):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(0, most + 1)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_all_links(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    texts = [fresh(rng.randrange(1, 80)) for _ in range(60)]
    for n in (40, 120, 250):
        texts += near_copies(rng, fresh(n), 12, n // 25)
    shared = fresh(60)
    texts += [f"{shared} {fresh(40)}" for _ in range(20)] + [texts[0]] * 5 + ["a b", "a  b", "a b c", None, "", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tops, links = naive_classes(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.classes(docs).collect()}
    assert got == {i: (tops[i], links[i]) for i in range(len(texts))}


def test_a_large_group_is_compared_in_cells(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(9)
    texts = near_copies(rng, " ".join(f"q{i}" for i in range(200)), 90, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tops, links = naive_classes(texts)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.classes(docs).collect()}
    assert got == {i: (tops[i], links[i]) for i in range(len(texts))}


def recall_of(spark, docs, queries):
    """Links found and links there are, of the documents `queries`, by an inverted index over all n-grams."""
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.classes(docs).collect()}
    sets = {r["doc_id"]: grams(r["text"]) for r in docs.collect()}
    having = defaultdict(list)
    for i, g in sets.items():
        for x in g:
            having[x].append(i)
    found = there = 0
    for q in queries:
        shared = Counter(i for x in sets[q] for i in having[x] if i != q)
        links = sum(n >= 0.8 * (len(sets[q]) + len(sets[i]) - n) - 1e-9 for i, n in shared.items())
        assert got[q] <= links
        found, there = found + got[q], there + links
    return found, there


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_recall_on_documents(spark):
    """Every id divisible by 50 against all rows, at production constants."""
    docs = spark.read.parquet(f"{SF.parent}/sf0.1/documents.parquet").select("doc_id", "text")
    found, there = recall_of(spark, docs, range(0, docs.count(), 50))
    assert there > 20 and found >= 0.98 * there


def test_recall_within_boilerplate(spark, monkeypatch):
    """Many words of 500 texts are the same, yet too few for a link; some have near copies. No leaf holds them all, and links are found."""
    monkeypatch.setattr(jaccard_join, "LEAF", 16)
    monkeypatch.setattr(jaccard_join, "DENSE", 0.72)
    rng = random.Random(2)
    shared = " ".join(f"b{i}" for i in range(160))
    texts = [f"{shared} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(400)]
    for t in texts[:50]:
        texts += near_copies(rng, t, 2, 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found, there = recall_of(spark, docs, range(400))
    assert there > 80 and found >= 0.95 * there
    records = common.cut(jaccard_join.signatures(docs).select("record", "size", "sig").dropDuplicates(["record"]), "records")
    assert jaccard_join.leaves(records, 1).agg(F.max("n")).first()[0] < 300


def test_hot_nodes_keep_all_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAF", 2)
    level = spark.createDataFrame([(i, 7 if i < 20 else i // 2) for i in range(60)], "record long, node long")
    sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.lit(1.0).alias("grams"))
    got = jaccard_join.with_sizes(level, sizes)
    assert got.count() == 60 and got.filter("node = 7").agg(F.min("n"), F.count("*")).first() == (20, 20)


def test_dedupe_keeps_one_of_each_class(spark):
    kept = jaccard_join.dedupe(clashing(odd_docs(spark)))
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == clashing(odd_docs(spark)).columns
    assert got == Counter([(1, "a b c d e f g h i j k l"), (None, "x y z"), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "É Ünï %%% $$$"), (None, None)])
    assert jaccard_join.dedupe(empty_docs(spark)).count() == 0 and jaccard_join.classes(empty_docs(spark)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(25)]
    parent = {x: x for e in edges for x in e}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for a, b in edges for x in (a, b) if a != b}


def test_chance_and_runs():
    assert jaccard_join.meeting_chance(1.0) == 1.0 and 0.93 < jaccard_join.meeting_chance(0.8) < 0.97
    assert jaccard_join.runs_needed(0.8, jaccard_join.RECALL) == 3
    assert jaccard_join.expected_recall(0.8, 3, levels=3) > 0.995 and jaccard_join.expected_recall(0.85, 3) > 0.998


# --- chats

ANY = st.lists(st.sampled_from([*"<>[]/\\sINST \nab", "</s>", "[INST]", "[/INST]", "<s>"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "a\nb", "\\n", "[INST]"]), ANY), ANY), max_size=6))
def test_the_template_reads_back(turns):
    out = chat.render_inst(turns)
    assert [(r, t) for r, t, _, _ in chat.parse_inst(out)] == turns
    assert all(chat.unescape(out[a:b]) == t for _, t, a, b in chat.parse_inst(out))


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (3, 5, None, "x"), (3, 5, None, "x"), (None, 0, "user", "n"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"<s> turn {i} é" * 3) for i in range(200)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    got = {r["conv"]: r for r in chat.digest(chat.format_turns(frame)).collect()}
    convs = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        convs[c].append((r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        learned = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and not got[c]["rewrites"]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(chat.render_inst(turns))
    assert {r["conv"]: r for r in chat.format_and_digest(frame).collect()} == got
    assert chat.format_and_digest(frame.limit(0)).count() == 0
    assert chat.digest(chat.format_turns(frame.limit(0))).count() == 0


def test_pieces_and_spans(spark):
    rows = [(1, i, "user", f"t{i}") for i in range(100)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.format_turns(frame).orderBy("place").collect()
    whole = chat.render_inst([("user", f"t{i}") for i in range(100)])
    assert "".join(p["piece"] for p in pieces) == whole
    assert all(whole[p["start"] : p["start"] + len(p["piece"])] == p["piece"] for p in pieces)


def test_templates_that_rewrite_history(spark):
    last_only = lambda turns: "".join(f"{r}:{t}\n" if i + 1 == len(turns) else f"{r}:.\n" for i, (r, t) in enumerate(turns))
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert chat.rewrites_history(last_only, turns) and not chat.rewrites_history(chat.render_inst, turns)
    frame = spark.createDataFrame([(1, i, "user", "long text") for i in range(3)], "conv_id long, turn long, role string, text string")
    assert [r["rewrites"] for r in chat.format_turns(frame, last_only).orderBy("place").collect()] == [False, True, True]


def stepped(render, turns):
    """(piece, start, rewrites) of each turn."""
    steps = chat.Incremental(render)
    return [(p.text, p.start, p.rewrites) for p in [*(p for t in turns for p in steps.add(t)), *steps.end()]]


def naive_pieces(render, turns):
    """(piece, start, rewrites) of each turn, by whole prefixes."""
    out, pieces = "", []
    for i in range(len(turns)):
        now = render(turns[: i + 1])
        at = next((k for k, (a, b) in enumerate(zip(now, out)) if a != b), min(len(now), len(out)))  # noqa: B905
        pieces.append((now[at:], at, not now.startswith(out)))
        out = now
    return pieces


def test_templates_that_rewrite_long_conversations(spark):
    turns = [("user", f"t{i}") for i in range(150)]
    frame = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    last_only = lambda turns: "".join(f"{r}:{t}\n" if i + 1 == len(turns) else f"{r}:.\n" for i, (r, t) in enumerate(turns))
    from_70 = lambda turns: "".join(f"{r}:{t}\n" if len(turns) < 70 or i + 70 > len(turns) else "" for i, (r, t) in enumerate(turns))
    noticed = lambda turns: "".join("notice\n" * (i == 69) + f"{r}:{t}\n" for i, (r, t) in enumerate(turns))
    for render, first in ((last_only, 1), (from_70, 69), (noticed, None)):
        got = [(r["piece"], r["start"], r["rewrites"]) for r in chat.format_turns(frame, render).orderBy("place").collect()]
        assert got == naive_pieces(render, turns)
        assert [p[2] for p in got].index(True) == first if first is not None else not any(p[2] for p in got)


LAST_ONLY = lambda turns: "".join(f"{r}:{t}\n" if i + 1 == len(turns) else f"{r}:.\n" for i, (r, t) in enumerate(turns))
NUMBERED = lambda turns: "".join(f"{i}:{t}\n" for i, (_, t) in enumerate(turns))
LAST_50 = lambda turns: "".join(t for _, t in turns[-50:])
STOPPED = lambda turns: "gone" if turns[-1][1] == "t60." else "".join(t for _, t in turns if t != "t60.")


@pytest.mark.parametrize("render", [chat.render_inst, LAST_ONLY, NUMBERED, LAST_50, STOPPED])
@pytest.mark.parametrize("declared", [True, False])
def test_one_law_at_every_length(render, declared):
    """A declaration, right or wrong, changes no piece, at any number of turns; turns are given out once and in order."""
    template = (lambda turns: render(turns)) if not declared else chat.local(lambda turns: render(turns))
    turns = [("user" if i % 2 else "assistant", f"t{i}.") for i in range(140)]
    expected = naive_pieces(render, turns)
    for n in (0, 1, 2, 3, 31, 32, 33, 49, 50, 51, 61, 62, 63, 64, 65, 66, 127, 128, 129, 140):
        got = stepped(template, turns[:n])
        assert got == expected[:n]


def test_rewriting_is_marked_wherever_it_begins():
    turns = [("user", f"t{i}.") for i in range(150)]
    kept = lambda prefix: "".join(t for _, t in prefix[-100:])
    for template in (kept, chat.local(lambda prefix: kept(prefix))):
        assert [p[2] for p in stepped(template, turns)] == [False] * 100 + [True] * 50
    emptied = lambda prefix: "".join(f"{r}:{t}\n" if len(prefix) < 80 or i + 1 == len(prefix) else "" for i, (r, t) in enumerate(prefix))
    assert chat.rewrites_history(emptied, turns) and chat.rewrites_history(chat.local(lambda prefix: emptied(prefix)), turns)


def test_five_thousand_turns():
    turns = [("user", f"{i};") for i in range(5000)]
    plain = lambda turns: "".join(t for _, t in turns)
    for template in (plain, chat.local(lambda turns: plain(turns)), chat.render_inst):
        got = stepped(template, turns)
        assert "".join(p[0] for p in got) == template(turns) and not any(p[2] for p in got) and len(got) == 5000


def test_more_than_sixteen_million_characters():
    turns = [("user", "x" * 150_000 + str(i)) for i in range(130)]
    kept = lambda prefix: "".join(t for _, t in prefix[-120:])
    got = stepped(chat.local(lambda prefix: kept(prefix)), turns)
    assert [p[2] for p in got] == [False] * 120 + [True] * 10
    assert "".join(p[0] for p in stepped(chat.render_inst, turns)) == chat.render_inst(turns)


def test_large_ids_beside_a_missing_one(spark):
    big = 2**53 + 1
    rows = [(c, i, "user", f"{c} {i}") for c in (big - 1, big, big + 1, None) for i in range(2)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    for got in (chat.format_and_digest(frame), chat.digest(chat.format_turns(frame))):
        assert sorted(((r["conv"], r["n_turns"]) for r in got.collect()), key=str) == sorted([(big - 1, 2), (big, 2), (big + 1, 2), (None, 2)], key=str)


# --- tokens

WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    "", "a", " a", "a ", "\n", "\n\n", "a\n\nb", "a\n b", " \n a", "  a   b  ", "▁a b▁ ▁", "<s> a </s>\n<unk>", "a\tb\r\nc", "é́ ÉCOLE Σίσυφος ΣΑΣ İI", " x y\x1cz\x85w",
    "<|endoftext|> hi<|startoftext|>there", "don't 'll we're", "日本語 テスト😀😀", "a" * 3000, "x\x00y", " ́combining", "word,  .\n\n\n  z\n ", "Hello, World! It's 3.5% (OK).", "A.B,C.", "ab, Ab. AB! aB?", LONG[:20000],
]


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(WORDS)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PIECES)


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), encoder.dtype).tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_encoder_and_counter_agree_with_the_libraries(encoder, counter, text):
    for _ in range(2):  # the second time from the cache
        assert ids_of(encoder, text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(counter.model.encode(text))
    table = counter.table(text)
    assert all(table[k - 1] == len(counter.model.encode(text[:k])) for k in range(1, len(text) + 1, 1 + len(text) // 200))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB é,.'\n\t ▁ñ日😀sStTx0́<|>")), max_size=40), st.integers(0, 12))
def test_any_text_and_prefix(encoder, counter, text, budget):
    assert ids_of(encoder, text) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(counter.model.encode(text))
    table = counter.table(text)
    assert table.tolist() == [len(counter.model.encode(text[: k + 1])) for k in range(len(text))]
    assert longest_prefix(table, budget) == max((k for k in range(len(text) + 1) if len(counter.model.encode(text[:k])) <= budget), default=0)


def test_a_full_cache_starts_anew(monkeypatch):
    from seine.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    e, c = WordEncoder(WORDS), PrefixCounter(PIECES)
    for i in range(30):
        text = f"w{i} x{i} common, Common. w{i - 1}"
        assert ids_of(e, text) == e.tokenizer.encode(text, add_special_tokens=False).ids
        assert c.count(text) == len(c.model.encode(text))
    assert len(e.cache) < 20


def test_token_files_read_back(spark, encoder):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "first"), (7, "again"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("own")).repartition(5)
    index, folder = token_files.write_tokens(docs, WORDS, 2, length=64)
    got = token_files.read_back(index).orderBy("start").collect()
    assert [(-1 if r["key"] is None else r["key"]) for r in got] == sorted(-1 if k is None else k for k, _ in rows)
    at = 0
    expected = Counter((k, zlib.crc32(np.array([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for k, t in rows)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert Counter((r["key"], r["ids_crc32"]) for r in got) == expected
    sample = index.filter("n_tokens > 100").first()
    f = token_files.SequenceFile(sample["file"])
    ids, mask = f.sequence(sample["local"] // 64)
    assert len(ids) == len(mask) == 64 and not ids.flags.owndata and ids[sample["local"] % 64] == f.ids(sample["local"], 1)[0]
    empty, _ = token_files.write_tokens(docs.limit(0), WORDS, 2)
    assert token_files.read_back(empty).count() == 0


def test_files_of_other_rules_have_whole_texts_encoded():
    e = WordEncoder(P.path("byte_bpe_50k.json"))
    assert not e.by_piece and WordEncoder(WORDS).by_piece
    for text in TEXTS:
        assert ids_of(e, text) == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_file_edges(spark):
    index, _ = token_files.write_tokens(clashing(odd_docs(spark)), WORDS, 2)
    got = token_files.read_back(index)
    assert got.count() == 11 and got.filter("n_tokens = 1").count() == 4 and got.filter("key = 1").select("n_tokens", "ids_crc32").distinct().count() == 1


def test_a_failed_file_leaves_nothing(tmp_path):
    w = token_files.SequenceWriter(f"file://{tmp_path}/a.arrow", np.dtype("<u2"), 8, 2)
    w.add(np.arange(90, dtype="<u2").tobytes())
    w.abort()
    assert not list(tmp_path.iterdir())


def test_last_sequence_is_filled_up(tmp_path):
    w = token_files.SequenceWriter(f"file://{tmp_path}/a.arrow", np.dtype("<u2"), 8, 2)
    starts = [w.add(np.arange(n, dtype="<u2").tobytes()) for n in (5, 0, 20, 3)]
    w.close()
    f = token_files.SequenceFile(f"file://{tmp_path}/a.arrow")
    assert starts == [0, 5, 5, 25] and f.ids(5, 20).tolist() == list(range(20)) and f.ids(25, 3).tolist() == [0, 1, 2]
    ids, mask = f.sequence(3)
    assert ids.tolist() == [19 - 0, 0, 1, 2, 0, 0, 0, 0] and mask.to_pylist() == [True] * 4 + [False] * 4
    f.close()


def test_token_counts(spark, counter):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, None)], "doc_id long, text string")
    for r in token_counts.token_counts(docs, PIECES, limit=10).collect():
        t = "" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        n = len(counter.model.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 10)
        assert len(counter.model.encode(t[: r["fit_chars"]])) <= 10
    table = {r["doc_id"]: r["counts"] for r in token_counts.prefix_tables(docs, PIECES).collect()}
    assert all(table[i] == [len(counter.model.encode(TEXTS[i][: k + 1])) for k in range(len(TEXTS[i]))] for i in (12, 16, 22)) and table[None] == []


def test_token_count_edges(spark):
    got = token_counts.token_counts(clashing(odd_docs(spark)), PIECES, limit=10)
    assert got.count() == 11 and got.filter("doc_id = 1").distinct().count() == 1
    assert token_counts.token_counts(empty_docs(spark), PIECES, limit=10).count() == 0 and token_counts.prefix_tables(empty_docs(spark), PIECES).count() == 0


def test_long_words_have_tables_too(counter):
    rng = random.Random(8)
    for n in (1500, 40_000):
        text = "".join(rng.choice("etaoinshr") for _ in range(n))
        table = counter.table(text)
        for k in (1, 2, 999, n // 2, n):
            assert table[k - 1] == len(counter.model.encode(text[:k]))
        cut = longest_prefix(table, 200)
        assert table[cut - 1] <= 200 and (table[cut:] > 200).all()


def test_a_model_without_the_property_is_encoded_by_prefixes(counter, monkeypatch):
    monkeypatch.setattr(counter, "splits", False)
    assert counter.table("ab  c\nd").tolist() == [len(counter.model.encode("ab  c\nd"[: k + 1])) for k in range(7)]


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_the_token_queries_by_the_libraries(spark, encoder, counter):
    """op3 and op5 on all documents against the libraries."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op5_token_counts"](spark, str(SF)).collect():
        n = len(counter.model.encode(docs[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 4096)
    got = {r["doc_id"]: r for r in QUERIES["op3_token_files"](spark, str(SF)).collect()}
    at = 0
    for i in sorted(docs):
        ids = [*encoder.tokenizer.encode(docs[i], add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)


# --- pages


def test_tree_fits_its_table_and_short_text_stays():
    tree = html_text.fit()
    rows, labels = html_text.labelled_rows(labelled_pages.pages())
    assert 500 < len(rows) < 1000
    assert sum(html_text.is_text(tree, r) == y for r, y in zip(rows, labels, strict=True)) / len(rows) > 0.95
    assert html_text.fit() == tree


def test_held_out_pages():
    tree = html_text.fit()
    text = "Every word of this is part of the article, and there are more than enough words here to be sure of that."
    page = f"""<html><head><title>T</title><style>p{{}}</style><script>var a = "</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id="cookie-banner">{text}</div>
      <div class="layout with-sidebar"><article><h1>Head &amp; line</h1><p>{text}<p>Short.<ul><li>Item&nbsp;one</li><li><a href=y>Two</a></li></ul><script>x()</script><!-- no --><p>A <b>bold</b>
      <i>line</i> &lt;tag&gt; &#233;</p><div class="ad-box">{text}</div><section id="comments"><article><p>{text}</p></article></section></article><aside>{text}</aside></div><form><p>{text}</p></form><footer>{text}</footer>"""
    assert html_text.main_text(page, tree) == f"Head & line\n{text}\nShort.\nItem one\nTwo\nA bold line <tag> é"


#: Pages of shapes that the labelled table lacks; [n] is a link of n words.
HELD_OUT = (
    "<body><div data-label=0>[1] - [1] - [2] - [1]</div><div data-label=1><h1>Of walls</h1><p>{35}</p><p>{60}</p><p>{14}</p><p>{27} [2] {5}</p></div><div data-label=0>[2]</div><div data-label=0>[3]</div><div data-label=0>{2} [1]</div></body>",
    "<body><div class=page><div class=skip-link data-label=0>[3]</div><div class=post data-label=1><h2>{4}</h2><p>{31}</p><p>{45}</p><div class=social-contract>{52}</div></div><div class=post-comments data-label=0><p>{30}</p><p>{8}</p></div></div></body>",
    "<body><dl data-label=0><dt>[1]</dt><dd>[2]</dd><dt>[1]</dt><dd>[3]</dd></dl><section data-label=1><p>{22}</p><p>{90}</p><p>{41}</p></section><center data-label=0>[1] [1] [1]</center></body>",
    "<body><main data-label=1><h1>{3}</h1><p>{6}</p><p>{80}</p><table><tr><td>{3}</td><td>{4}</td></tr></table><p>[2]</p></main><div id=related data-label=0>[5] [4] [6]</div><div id=footer data-label=0>{12}</div></body>",
    "<body><ul class=nav data-label=0><li>[1]</li><li>[2]</li></ul><div class=widget-theory data-label=1><p>{44}</p><p>{71}</p></div><div class=widget data-label=0>[2]</div><div class='ads right' data-label=0>{33}</div></body>",
)


def test_features_decide_held_out_blocks():
    """The tree errs on few blocks of unseen shapes, and does not just repeat the sure names."""
    tree = html_text.fit()
    pages = [labelled_pages._fill(p, scale, 7 * i) for i, p in enumerate(HELD_OUT) for scale in (0.7, 1.4)]
    rows, labels = html_text.labelled_rows(pages)
    said = [html_text.is_text(tree, r) for r in rows]
    hit = sum(s and y for s, y in zip(said, labels, strict=True))
    names = [r[html_text.FEATURES.index("beside")] < 2 for r in rows]
    assert len(rows) > 70 and hit / sum(said) >= 0.95 and hit / sum(labels) >= 0.9
    assert sum(s != n for s, n in zip(said, names, strict=True)) / len(rows) > 0.15
    by_name = sum(n and y for n, y in zip(names, labels, strict=True))
    assert by_name / sum(names) < hit / sum(said)


def test_word_counts_and_links_alone_learn_most():
    """Without names, main parts and headings, a tree on the sizes and links of a block and its neighbours still tells most apart."""
    rows, labels = html_text.labelled_rows(labelled_pages.pages())
    bare = [r[:6] + (0.0, 0.0, 0.0) for r in rows]
    tree = html_text.grow(bare, labels)
    assert sum(html_text.is_text(tree, r) == y for r, y in zip(bare, labels, strict=True)) / len(rows) > 0.8


@pytest.mark.parametrize("page", ["<div>x" * 20000 + "</b>" * 20000, "<div>x" * 20000 + "</p>" * 20000, "<head><noscript>" + "<div>x" * 20000, "<div>" * 20000 + "<button>x<div>y" * 10000, "<head>" * 20000 + "<p>x", "<section>" + "<div>x</p>" * 20000 + "</section>"])
def test_no_page_takes_quadratic_time(page):
    began = time.process_time()
    html_text.blocks(page)
    assert time.process_time() - began < 8  # minutes, if tags went through all open elements


def test_the_query_by_brute_force(spark):
    """The pages of the test tables hold their text in one article of p, h1 and br."""
    got = {r["page_id"]: r for r in QUERIES["op9_html_text"](spark, str(SF)).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)(?:</article>|$)", p["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)(?:\s[^>]*)?/?>", body))
        want = "\n".join(x for x in parts if x)
        assert (got[p["page_id"]]["text"], got[p["page_id"]]["n_chars"], got[p["page_id"]]["url"]) == (want, len(want), p["url"])


def texts_of(page):
    return [b.text for b in html_text.blocks(page)]


def test_a_head_without_end_tag_ends():
    assert texts_of("<html><head><title>T</title><meta charset=x><style>p{}</style><body><p>one<p>two</body></html>") == ["one", "two"]
    assert texts_of("<head><title>T</title><link href=x><div>one</div><p>two") == ["one", "two"]
    assert texts_of("<head><title>T</title>\n one <b>two</b><p>three") == ["one two", "three"]
    assert texts_of("<head><title>T</title><span>one</span></head> two") == ["one two"]
    assert texts_of("<head><noscript><p>no</p><img src=x></noscript><template><p>no</p></template><title>T</title><p>one") == ["one"]
    assert texts_of("<head><noscript><img src=x><body><p>one") == ["one"]
    assert texts_of("<head><title>T</title></head><body>one</body>") == ["one"]


def test_hidden_elements_without_end_tag_end():
    for tag in ("button", "svg", "object"):
        assert texts_of(f"<div><p>one</p><{tag}>no<p>two</p><p>three</p></div><p>four") == ["one", "two", "three", "four"]
        assert texts_of(f"<div><{tag}>no<div>no</div></{tag}>one</div>") == ["one"]
        assert texts_of(f"<{tag}>no<p>one <{tag}>no</{tag}> two") == ["one two"]
    assert texts_of("<div><select><option>no<option>no<p>one</p></div>") == ["one"]
    assert texts_of("<div><select><option>no<option>no</select>one</div>") == ["one"]


def test_a_line_break_does_not_end_a_marked_paragraph():
    for at in ("<br>", "<br/>"):
        assert [(b.text, b.beside == 2) for b in html_text.blocks(f"<p class=ad>one{at}two{at}three</p><p>four")] == [("one", True), ("two", True), ("three", True), ("four", False)]
    assert [(b.text, b.beside == 2) for b in html_text.blocks("<h2 class=notice>one<br>two<hr>three</h2>four")] == [("one", True), ("two", True), ("three", True), ("four", False)]
    assert [(b.text, b.beside == 2) for b in html_text.blocks("<p class=ad>one<hr>two")] == [("one", True), ("two", False)]


def test_extract_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<article><p>x"), (3, "w", "plain text"), (4, "b", "<p>" * 2000 + "deep"), (5, "b", "</div></p><>< <a <!-- x")], "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert got[1]["text"] == "" and got[2]["n_chars"] == 0 and got[None]["text"] == "x" and len(got) == 6
    assert html_text.extract(pages.limit(0)).count() == 0


# --- the pipeline


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from seine.llm import decontam, mixing, quality, sharding

    rng = random.Random(11)
    fresh = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(80))
    base, item = fresh(), fresh()
    texts = [fresh() for _ in range(60)] + near_copies(rng, base, 6, 1) + [f"{fresh()} {item} {fresh()}", "bad " * 90, "short", None, base, base]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema if len(seen) < 4 else DOCS + ", shard int")
        seen.append(sorted(r["doc_id"] for r in docs.collect()))
    ids = [i for i, t in enumerate(texts) if t and t != "short" and not t.startswith("bad")]
    assert seen[0] == ids
    tops, _ = naive_classes([texts[i] for i in ids])
    firsts = sorted({ids[k] for k in tops})
    assert seen[1] == firsts
    clean = [i for i in firsts if item not in texts[i]]
    assert seen[2] == clean and len(clean) < len(firsts)
    copies = Counter(seen[3])
    sizes = {s: sum(len(texts[i].split()) for i in clean if i % 3 == s) for s in range(3)}
    for s, w in zip(range(3), (3, 1, 2), strict=True):
        taken = sum(len(texts[i].split()) * n for i, n in copies.items() if i % 3 == s)
        goal = min(2.0, 1.5 * sum(sizes.values()) * w / 6 / sizes[s]) * sizes[s]
        assert abs(taken - goal) < 0.25 * sizes[s]
    assert seen[4] == seen[3]
    whole = pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in whole.collect()) == seen[4]
    assert all(x is not None for x in (decontam, mixing, quality, sharding))


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, and an empty table: each stage and the whole run."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(90))
    twice = prose()
    good = [(100 + i, prose(), "en", "s1", 1) for i in range(30)] + [(None, prose(), "en", None, None), (200, twice, None, "s1", 1), (200, twice, None, "s1", 1), (201, prose(), None, None, 1)]
    docs = odd_docs(spark).unionByName(spark.createDataFrame(good, DOCS))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "x y z"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in got}
    assert {None, 200, 201} <= kept and len({r["text"] for r in got if r["doc_id"] == 200}) == 1 and not {1, 2, 3, 4, 5, 7} & kept
    root = common.shared_root(spark).removeprefix("file://")
    assert not [p for p in Path(root, "seine", spark.sparkContext.applicationId).glob("stage-*") if not p.name.startswith("stage-sharding")]
    clash = clashing(docs)
    for name, stage in pipeline.STAGES:
        out = stage(spark, clash, str(tmp_path))
        assert set(out.columns) == set(clash.columns) and out.count() > 0, name
        assert stage(spark, clash.limit(0), str(tmp_path)).count() == 0, name


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_the_join_and_chat_queries_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    tops, links = naive_classes([d["text"] for d in docs])
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in QUERIES["op1_jaccard_join"](spark, str(SF)).collect()}
    assert got == {d["doc_id"]: (docs[t]["doc_id"], n) for d, t, n in zip(docs, tops, links, strict=True)}
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs[r["conv_id"]].append((r["role"], r["text"] or ""))
    says = "</s>[INST] ok [/INST]"
    convs[-7] = [("user", says), ("assistant", says)]
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for r in QUERIES["op2_chat_format"](spark, str(SF)).collect():
        turns = convs.pop(r["conv_id"])
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(learned), sha(learned))
    assert not convs
