"""Walks in rounds, shares of bytes, files read in ranges, counters of one job, test blocks as a fold, shortest edit scripts."""

import itertools
import random

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from seine.functions.text import lines_of
from seine.operators import blocks, drift
from seine.operators.edits import matches
from seine.plans.scan import Scanner
from seine.sources import chunks, files, written
from seine.sources.config import ScanConfig

TOKEN = "ghp_x7Kq2mZ9vT4bN8cR1wL5yH3jF6dS0aPuEgQi"


def tree(root, names, content="x\n"):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(content)


@pytest.mark.parametrize("entries", [1, 3, 4096])
def test_walk_in_rounds(spark, tmp_path, entries):
    names = {"a.txt", *(f"one/branch/{'d/' * k}f{k}.txt" for k in range(12)), *(f"wide/{i}/f.txt" for i in range(9))}
    tree(tmp_path, names)
    rows = files.walk_all(spark, str(tmp_path), entries=entries).collect()
    assert sorted(r["rel_path"] for r in rows if r["kind"] == "file") == sorted(names)
    assert {r["kind"] for r in rows} == {"file", "folder"} and len(rows) == len({r["path"] for r in rows})


def test_shares_of_bytes(spark):
    sizes = [(f"{i:03}", (i * 7919) % 1000) for i in range(200)] + [("zz", 50_000)]
    rows = written.shared_out(spark.createDataFrame(sizes, "path string, length long").repartition(5), ["path"], F.col("length"), share=8000, open_cost=10, tasks=3)
    got = rows.orderBy("path").collect()
    before = np.concatenate([[0], np.cumsum([n + 10 for _, n in sizes])[:-1]])
    assert [(r["path"], r["task"]) for r in got] == [(p, int(b // 8000)) for (p, _), b in zip(sizes, before, strict=True)]
    dealt = written.dealt_by_task(rows).withColumn("p", F.spark_partition_id())
    per = dealt.groupBy("p").agg(F.sum("length").alias("bytes"), F.max("length").alias("last")).collect()
    assert all(r["bytes"] <= 8000 + r["last"] for r in per) and len(per) == max(r["task"] for r in got) + 1
    nothing = written.shared_out(rows.drop("task").limit(0), ["path"], F.col("length"))
    assert written.dealt_by_task(nothing).count() == 0


def test_a_folder_below_one_branch_is_read_by_many_tasks(spark, tmp_path):
    tree(tmp_path, [f"packages/core/src/m{i}/f{k}.txt" for i in range(10) for k in range(10)], f"x\n{TOKEN}\n")
    result = Scanner().scan_directory(spark, str(tmp_path))
    assert result.findings.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    assert result.counters == {"files_scanned": 100, "scanned": 100, "skipped": 0, "binary": 0, "with_secrets": 100, "total_matches": 100}
    # the listing is written: no plan walks again
    assert all("ArrowEvalPython" not in p and p.count("MapInArrow") <= 2 for p in (d._jdf.queryExecution().optimizedPlan().toString() for d in (result.findings, result.files)))


def test_blocks_of_a_file_are_whole_lines(tmp_path):
    fs, path = pafs.LocalFileSystem(), tmp_path / "f"
    random.seed(1)
    for turn in range(400):
        raw = bytes(random.choice(b"ab\n\n" if turn % 2 else b"abcdefghij\n") for _ in range(random.randrange(60)))
        path.write_bytes(raw)
        size, block = random.randrange(1, 20), random.randrange(1, 10)
        begins = [0] + [i + 1 for i, c in enumerate(raw) if c == 10]
        for start in range(0, max(len(raw), 1), size):
            stop = min(len(raw), start + size)
            got = b"".join(chunks.blocks(fs, str(path), start, stop, block))
            assert got == b"".join(raw[b : raw.find(b"\n", b) + 1 or None] for b in begins if start <= b < stop)


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_lines_of_files_read_in_ranges(spark, tmp_path, size):
    texts = {"a": "x\r\n\né漢 y\nlast", "b": "", "c": "\n", "d": "no end", "e": "w" * 300 + "\n" + "v" * 50 + "\r\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad").write_bytes(b"fine\nfine\n" + b"\xff\n")
    (tmp_path / "bin").write_bytes(b"\x7f\0\xff")
    listed = files.walk(spark, str(tmp_path))
    parts = chunks.counted(chunks.ranges(listed, size), str(tmp_path))
    name = F.substring_index("path", "/", -1)
    states = {r[0]: (r[1], r[2]) for r in chunks.file_states(parts).select(name, "success", "is_binary").collect()}
    assert states == dict.fromkeys(texts, (True, False)) | {"bad": (False, False), "bin": (True, True)}
    good = parts.filter(~name.isin("bad", "bin"))
    got = sorted((r[0], r["line_number"], r["line"]) for r in chunks.lines_of_parts(good, str(tmp_path)).select(name, "line_number", "line").collect())
    frame = spark.createDataFrame([*texts.items()], "p string, t string")
    expected = sorted((r["p"], r["pos"] + 1, r["col"]) for r in frame.select("p", F.posexplode(lines_of(F.col("t")))).collect())
    assert got == expected


def test_large_files_are_streamed(spark, tmp_path):
    text = f"it('x', () => {{\n# scan:ignore-next\n{TOKEN}\n}})\n" * 300
    tree(tmp_path, ["large.js"], text)
    tree(tmp_path, ["small.js"], text[:400])
    (tmp_path / "broken.js").write_bytes(text.encode() + b"\xff")
    config = ScanConfig(whole_mib=-1)
    flagged = files.scannable(files.walk(spark, str(tmp_path)))
    result = Scanner(config).scan_files(flagged, str(tmp_path), range_bytes=1000)
    counts = {r["path"].rsplit("/", 1)[1]: r["count"] for r in result.findings.groupBy("path").count().collect()}
    # neither blocks nor the directive for the next line apply
    assert counts == {"large.js": 300, "small.js": text[:400].count(TOKEN)}
    assert result.findings.agg(F.max("line_number")).first()[0] == 1199
    assert result.findings.select(F.spark_partition_id()).distinct().count() > 4
    assert result.counters["skipped"] == 1 and result.counters["files_scanned"] == 2 and tuple(result.stats.first()) == (2, 1, sum(counts.values()))
    assert result.warnings.count() == 1


def test_counters_without_files(spark):
    result = Scanner().scan_table(spark.createDataFrame([], "path string, text string"))
    assert set(result.counters.values()) == {0} and result.saved.count() == 0


def sequential(lines, python):
    """Test blocks by looking ahead from each start; brute force."""
    starts = lambda s: s.startswith(("def test_", "class Test", "@pytest.", "it(", "test(", "describe(")) or s in ("#[bench]", "#[cfg(test)]") or (s.startswith("#[") and s.endswith("test]")) or any(m in s for m in ("mod tests {", "mod test {", "class Test", "describe(", "__tests__"))
    depth = lambda s: len(s.encode()) - len(s.lstrip().encode())
    out, i = [], 0
    while i < len(lines):
        end = None
        if starts(lines[i].strip()):
            if python:
                end = next((k for k in range(i + 1, len(lines)) if lines[k].strip() and depth(lines[k]) <= depth(lines[i])), len(lines))
            else:
                level, opened = 0, False
                for k in range(i, len(lines)):
                    level += lines[k].count("{") - lines[k].count("}")
                    opened |= "{" in lines[k]
                    if opened and level == 0:
                        end = k + 1
                        break
        if end is None:
            i += 1
        else:
            out.append((i, end))
            i = max(end, i + 1)
    return out


def test_block_fold_against_looking_ahead(spark):
    random.seed(3)
    parts = ["it('x', () => {", "});", "{", "}", "}}", "{{", "fn a() {", "  let x = 1;", "", "#[test]", "mod tests {", "def test_a():", "  pass", "\tx", "class TestA:", "    @pytest.fix", "  　", "describe('a'", "} {", "test('y', () => { z })"]
    rows = [(f"f{i}{random.choice(['.rs', '.py', '.js', ''])}", [random.choice(parts) for _ in range(random.randrange(25))]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "path string, lines array<string>")
    found = frame.select("path", blocks.test_blocks(F.col("lines"), F.col("path"), F.array_join("lines", "\n")).alias("b"))
    assert "Python" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["path"]: [tuple(x) for x in r["b"]] for r in found.collect()}
    assert got == {p: sequential(x, p.endswith(".py")) for p, x in rows}
    assert spark.createDataFrame([(None, None)], "path string, lines array<string>").select(blocks.test_blocks(F.col("lines"), F.col("path"), F.lit(None).cast("string"))).first()[0] == []


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_edit_scripts_are_shortest():
    random.seed(1)
    for _ in range(1500):
        letters = random.choice([1, 2, 3, 5, 30])
        a = [random.randrange(letters) for _ in range(random.randrange(25))]
        b = [random.randrange(letters) for _ in range(random.randrange(25))]
        if random.random() < 0.4:
            b = a[: len(a) // 2] + [random.randrange(letters)] + a[len(a) // 2 + random.randrange(2) :]
        i, j = matches(np.array(a, np.int64), np.array(b, np.int64))
        assert len(i) == common_length(a, b) and [a[x] for x in i] == [b[x] for x in j]
        assert all(np.diff(i) > 0) and all(np.diff(j) > 0)


def test_long_files_are_compared_in_seconds(spark):
    rng = np.random.default_rng(1)
    old = rng.integers(0, 1000, 100_000)
    new = np.insert(np.delete(old, rng.integers(0, 100_000, 200)), rng.integers(0, 99_000, 200), rng.integers(0, 1000, 200))
    i, _ = matches(old, new)
    assert len(i) >= 99_800


@pytest.mark.parametrize("context", [0, 1, 3])
def test_hunks_rebuild_both_versions(spark, context):
    random.seed(context)
    pairs = [("\n".join(random.choice("abcd") for _ in range(random.randrange(40))), "\n".join(random.choice("abcd") for _ in range(random.randrange(40)))) for _ in range(60)]
    pairs += [(x := "\n".join(map(str, range(50))), x.replace("\n7\n", "\nseven\n").replace("\n30\n", "\n")), ("a\n", ""), ("", "b\nc"), ("same", "same")]
    frame = spark.createDataFrame([(f"{i:03}", a, b) for i, (a, b) in enumerate(pairs)], "path string, old_text string, new_text string")
    rows = drift.grouped_diff(frame, context).orderBy("path", "hunk", "place").collect()
    split = lambda t: (t.split("\n")[:-1] if t.endswith("\n") else t.split("\n")) if t else []
    for i, (a, b) in enumerate(pairs):
        own = [r for r in rows if r["path"] == f"{i:03}"]
        a, b = split(a), split(b)
        assert all(r["line"] == a[r["old_index"]] for r in own if r["tag"] != "insert") and all(r["line"] == b[r["new_index"]] for r in own if r["tag"] != "delete")
        gone, come = {r["old_index"] for r in own if r["tag"] == "delete"}, {r["new_index"] for r in own if r["tag"] == "insert"}
        assert [x for k, x in enumerate(a) if k not in gone] == [x for k, x in enumerate(b) if k not in come]
        assert len(gone) + len(come) == len(a) + len(b) - 2 * common_length(a, b)
        for _, hunk in itertools.groupby(own, lambda r: r["hunk"]):
            tags = [r["tag"] for r in hunk]
            ends = [len(list(itertools.takewhile(lambda t: t == "equal", x))) for x in (tags, tags[::-1])]
            assert max(ends) <= context and max((len(list(g)) for k, g in itertools.groupby(tags) if k == "equal"), default=0) <= 2 * context
