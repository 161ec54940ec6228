"""Tables written in the shared folder: later stages start from files that outlive any executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """A new folder name in spark.checkpoint.dir, which driver and executors share; only a local session may lack the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seine-files-")
    return f"{root.rstrip('/')}/seine-files/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None, records: int = 0) -> DataFrame:
    """df, written as Parquet and read again. A task writes one file, or, with records, one for each so many rows."""
    path = path or shared_folder(df.sparkSession)
    df.write.option("maxRecordsPerFile", records).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, order: Sequence[str], cost: Column, name: str) -> DataFrame:
    """df, written in the order given, with a column `name`: what the rows before cost together.

    No window is over all rows: each file holds a range of the order, and what the files before it cost is a table of one
    row a file, of as many rows as there are shuffle partitions at most.
    """
    rows = written(df.withColumn("_cost", cost.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order))
    rows = rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int").alias("_part"), F.col("_metadata.row_index").alias("_place"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_part").agg(F.sum("_cost").alias("_own")).select("_part", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_base") + F.coalesce(F.sum("_cost").over(inside), F.lit(0))
    return rows.join(F.broadcast(bases), "_part").withColumn(name, total).drop("_part", "_place", "_cost", "_base")


#: What opening a file counts beside its bytes, and the most bytes that a reading task is given, but for its last file.
OPEN_COST, SHARE = 64 << 10, 64 << 20


def shared_out(files: DataFrame, order: Sequence[str], size: Column, share: int = SHARE, open_cost: int = OPEN_COST, tasks: int | None = None) -> DataFrame:
    """files with a column `task`: consecutive files of the order, until a task has its share.

    A task's files begin within one share of the running total of sizes, so it reads less than a share and one file. The
    share is smaller where all files would not make `tasks` (by default three a core) of them.
    """
    tasks = tasks or 3 * files.sparkSession.sparkContext.defaultParallelism
    placed = running_total(files, order, size + open_cost, "_before")
    total = placed.agg(F.max(F.col("_before") + size + open_cost)).first()[0] or 0
    own = max(min(share, -(-total // tasks)), 1)
    return placed.withColumn("task", F.floor(F.col("_before") / own).cast("int")).drop("_before")


def dealt_by_task(files: DataFrame) -> DataFrame:
    """The rows of shared_out(), each task's in a partition of its own."""
    most = files.agg(F.max("task")).first()[0]
    return files.repartitionById((most or 0) + 1, F.col("task")).drop("task")
