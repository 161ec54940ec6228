"""Work and memory that must not grow with the number of files: states of streams, opened files, walks, commits, diffs."""

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from seine.plans.scan import Scanner
from seine.streaming.blocks import lines_outside_blocks


def test_files_of_a_stream_share_states(spark, tmp_path):
    texts = {f"f{i}.rs": ["#[test]", "fn t() {", "key = a", "}", f"key = {i}"] for i in range(40)}
    rows = [(p, n, line) for p, x in texts.items() for n, line in enumerate([*x, None], 1)]
    out = []
    for turn in range(2):
        part = [r for r in rows if (r[1] > 3) == turn]
        spark.createDataFrame(part, "path string, line_number int, line string").write.mode("append").parquet(str(tmp_path / "lines"))
        stream = spark.readStream.schema("path string, line_number int, line string").parquet(str(tmp_path / "lines"))
        query = lines_outside_blocks(stream, Scanner(), 4).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        out.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))
    assert 0 < out[0] <= 4
    found = {(r["path"], r["line_number"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(p, 5) for p in texts} == {f for f in found if f[1] > 1}


def test_sync_status_lists_all_changed_files_of_a_repository(spark):
    from seine.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = {r["repo"]: r for r in QUERIES["sync_status"](spark, sf).collect()}
    changed = [r["rel_path"] for r in QUERIES["sync_changed_files"](spark, sf).collect()]
    assert rows["idle"]["status"] == "InSync" and rows["idle"]["changed_files"] == ""
    for repo in {p.split("/")[0] for p in changed if not p.split("/")[0].endswith("1")}:
        assert rows[repo]["changed_files"] == ",".join(sorted(p for p in changed if p.startswith(f"{repo}/")))


def test_sync_status_has_a_row_for_each_of_two_repositories_of_a_name(spark, tmp_path):
    from seine.queries import QUERIES

    # the query adds a repository named idle to the brands
    parts = [(5, "n", "idle", 1), (10, "n", "idle", 1), (1, "n", "idle", 1), (7, "n", "b", 1), (2, "n", "calm", 1), (5, "n", "x1", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = sorted(tuple(r) for r in QUERIES["sync_status"](spark, str(tmp_path)).collect())
    assert found == [("b", "OutOfSync", "b/7"), ("calm", "InSync", ""), *[("idle", "OutOfSync", "idle/10,idle/5")] * 2]


def test_short_sequences_have_the_script_of_the_method_for_long_ones():
    from seine.operators import edits

    random = np.random.default_rng(3)
    for _ in range(200):
        a, b = (random.integers(0, random.integers(2, 9), random.integers(0, 40)) for _ in range(2))
        short, long = edits._short_matches(a.tolist(), b.tolist()), edits._long_matches(a, b)
        assert all(np.array_equal(x, y) for x, y in zip(short, long, strict=True))


def test_diffs_of_small_files_go_out_together(spark):
    from seine.operators import drift

    rows = [(str(i), f"a\nb{i}\nc", f"a\nc\nd{i}") for i in range(500)]
    found = drift.grouped_diff(spark.createDataFrame(rows, "path string, old_text string, new_text string").coalesce(1))
    assert found.count() == 500 * 4
    assert [tuple(r) for r in found.filter("path = '7'").orderBy("place").collect()] == [
        ("7", 0, 0, "equal", 0, 0, "a"), ("7", 0, 1, "delete", 1, None, "b7"), ("7", 0, 2, "equal", 2, 1, "c"), ("7", 0, 3, "insert", None, 2, "d7"),
    ]
    batches = found.mapInArrow(lambda xs: (x.slice(0, 1).select(["path"]) for x in xs), "path string")
    assert batches.count() == 1


def test_html_page_scans_once(spark):
    from seine.queries import QUERIES

    plan = QUERIES["html_page_lines"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "supplier" not in plan and "s_suppkey" not in plan


def test_tasks_rename_what_is_written(spark, tmp_path, monkeypatch):
    from seine.sources import folder_tree

    def commit(self, messages):
        raise AssertionError("renamed by the driver")

    monkeypatch.setattr(folder_tree.TreeWriter, "commit", commit)
    rows = spark.range(50).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("rel_path"), F.lit("x").cast("binary").alias("content"))
    folder_tree.write_tree(rows, str(tmp_path))
    assert len(list((tmp_path / "d").iterdir())) == 50 and [p.name for p in tmp_path.iterdir()] == ["d"]
    # a task that runs again finds its files renamed
    writer = folder_tree.TreeWriter(f"file://{tmp_path}")
    staged = writer.write(iter(rows.toArrow().to_batches()))
    writer.publish(staged.manifest)
    writer.publish(staged.manifest)
    writer.clear()
    assert len(list((tmp_path / "d").iterdir())) == 50


def test_a_flat_folder_is_listed_without_being_held(tmp_path):
    from seine.sources import files

    (tmp_path / "sub").mkdir()
    for i in range(30):
        (tmp_path / f"f{i}").write_bytes(b"x" * i)
    (tmp_path / "link").symlink_to(tmp_path / "f1")
    (tmp_path / "gone").symlink_to(tmp_path / "nothing")

    walker = files.Walker(f"file://{tmp_path}")
    first = next(walker.entries(str(tmp_path)))  # one entry, before the rest is looked at
    assert len(first) == 6
    assert {r[1]: (r[2], r[4]) for r in walker.entries(str(tmp_path))} == {f"f{i}": (i, "file") for i in range(30)} | {"sub": (None, "folder")}


def test_consecutive_ranges_open_their_file_once(tmp_path):
    from seine.sources import chunks

    (tmp_path / "a").write_bytes(b"".join(b"line %d\n" % i for i in range(1000)))
    times = []

    class Counting:
        def open_input_file(self, path):
            times.append(path)
            return pafs.LocalFileSystem().open_input_file(path)

    opened, path = chunks.Opened(Counting()), str(tmp_path / "a")
    size = (tmp_path / "a").stat().st_size
    got = [b for at in range(0, size, 700) for b in opened.blocks(path, at, min(at + 700, size))]
    assert b"".join(got) == (tmp_path / "a").read_bytes() and times == [path]


def test_listed_paths_are_dealt_out(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"f{i}").write_bytes(b"token = 0a1b2c3d4e5f60718293a4b5c6d7e8f9")
    paths = spark.createDataFrame([(str(tmp_path / f"f{i}"),) for i in range(300)], "path string")
    files = Scanner().scan_paths(spark, str(tmp_path), paths).files.filter("text is not null")
    assert files.select(F.spark_partition_id()).distinct().count() >= 8 and files.count() == 300


def test_equal_lines_of_a_file_are_looked_at_once(spark):
    line = "token = 0a1b2c3d4e5f60718293a4b5c6d7e8f9"
    rows = spark.createDataFrame([(p, n, line if n % 2 else f"{line}{n}") for p in "ab" for n in range(1, 21)], "path string, line_number int, line string")
    found = Scanner().line_findings(rows)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["path"], r["line_number"], r["line"]) for r in found.collect()) == sorted(map(tuple, rows.collect()))
