"""Written tables, lookups on either side of the size check, ordered tables, and queries against their SQL."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seine.llm import common, decontam
from seine.llm.oracle import ORACLE
from seine.llm.queries import QUERIES

from ..test_queries import SF, TABLES, rows


@pytest.mark.parametrize("most", [0, 100])
def test_lookup_matches_nulls_and_keeps_all_rows(spark, most):
    big = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "k long, x string")
    small = spark.createDataFrame([(1, "one"), (None, "none")], "k long, y string")
    got = sorted((r["x"], r["y"]) for r in common.lookup(big, small, ["k"], max_rows=most).collect())
    assert got == [("a", "one"), ("b", "one"), ("c", "none"), ("d", None)]
    assert common.lookup(big, small, ["k"], "inner", most).count() == 3


def test_a_broadcast_is_bounded_in_bytes(spark):
    small = common.cut(spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t")), "small")
    assert common.may_broadcast(small) and not common.may_broadcast(small, max_bytes=50_000) and not common.may_broadcast(small, max_rows=99)
    assert common.may_broadcast(small.limit(0))


@pytest.fixture
def many_files(spark):
    """Small tables stay in as many files as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_slots_and_mixes_over_many_files(spark, many_files):
    from seine.llm import mixing, sharding

    rows = spark.range(3000).select((F.col("id") % 700).alias("doc_id"), (F.col("id") % 700 % 3).cast("int").alias("shard"), F.lit(1).alias("c"))
    got = [(r["shard"], r["slot"], r["doc_id"]) for r in sharding.slots(rows, "doc_id", ["c"]).orderBy("shard", "slot").collect()]
    for s in range(3):
        own = [g for g in got if g[0] == s]
        assert [g[1] for g in own] == list(range(len(own))) and [g[2] for g in own] == sorted(g[2] for g in own)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), (F.col("id") % 40).alias("size"), F.lit(1.0).alias("weight"))
    taken = mixing.mix(docs, weights=(1, 2), share=0.7).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert len(taken) == 2 and all(r["n"] == int(r["t"]) for r in taken)


def test_slots_and_mixes_where_sessions_bound_files(spark, many_files):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "100")
    try:
        test_slots_and_mixes_over_many_files(spark, None)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_ordered_table_and_bases(spark, many_files):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.lit(1).alias("same"), F.col("id").alias("v"))
    table = common.ordered_table(df, [F.col("g"), F.col("same"), F.col("v")], "t").cache()
    got = [(r["g"], r["v"]) for r in table.orderBy("_split", "_pos").collect()]
    assert got == sorted(got) and len(got) == 5000 and table.select("_split").distinct().count() > 1
    start = common.bases(table, ["g"], F.sum("v"), "t")
    first = {(r["g"], r["_split"]): r for r in start.collect()}
    for g in range(3):
        splits = sorted(s for k, s in first if k == g)
        assert first[g, splits[0]]["base"] == 0
    table.unpersist()


def test_release_deletes_what_was_written(spark):
    common.cut(spark.range(3), "gone").count()
    root = Path(common.shared_root(spark).removeprefix("file://"), "seine", spark.sparkContext.applicationId)
    assert any(root.iterdir())
    common.release(spark)
    assert not root.exists()


def test_decontamination_joins_by_a_shuffle_as_well(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "z a b c d e f g h i j"), (2, "x y"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.contamination(docs, items).collect()}
    assert got == {1: (10, 1), 2: (1, 1), 3: (0, 0)}
    assert [r["doc_id"] for r in decontam.decontaminate(docs, items).collect()] == [3]


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(ORACLE))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, str(SF))
    collected = found.collect()
    expected = c.execute(ORACLE[name]).to_arrow_table().to_pydict()
    assert sorted(found.columns) == sorted(expected)
    assert rows(found.columns, {n: [r[n] for r in collected] for n in found.columns}) == rows(found.columns, expected)
