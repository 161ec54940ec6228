"""Aggregations of findings, files and warnings. All of them combine on the map side; order is given where a report shows one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import BUILT_IN, Pattern, pattern_table


def by_pattern(findings: DataFrame, patterns: Iterable[Pattern] = BUILT_IN) -> DataFrame:
    """(pattern_id, name, matches) for every pattern, those without a match included."""
    counts = findings.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    table = pattern_table(findings.sparkSession, patterns).select("pattern_id", "name")
    return table.join(counts, "pattern_id", "left").select("pattern_id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("matches"))


def by_type(findings: DataFrame) -> DataFrame:
    """(secret_type, matches), most first; equal counts by name."""
    return findings.groupBy("secret_type").agg(F.count(F.lit(1)).alias("matches")).orderBy(F.desc("matches"), "secret_type")


def by_file(findings: DataFrame) -> DataFrame:
    """(path, matches, first_line, types), by path."""
    return findings.groupBy("path").agg(F.count(F.lit(1)).alias("matches"), F.min("line_number").alias("first_line"), F.countDistinct("secret_type").alias("types")).orderBy("path")


def files_with_findings(findings: DataFrame) -> DataFrame:
    return findings.select("path").distinct()


def first_findings(findings: DataFrame, n: int) -> DataFrame:
    """The first n findings in report order."""
    return findings.orderBy("path", "line_number", "pattern_id", "start_pos").limit(n)


def first_per_file(findings: DataFrame, n: int) -> DataFrame:
    """The first n findings of each file; a rank of at most n needs no more than n rows of a file and task."""
    order = Window.partitionBy("path").orderBy("line_number", "pattern_id", "start_pos")
    return findings.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def scan_stats(files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files_scanned, files_skipped, total_matches. files has a column `success`; binary and ignored files are successes."""
    counted = files.agg(F.count_if(F.col("success")).alias("files_scanned"), F.count_if(~F.col("success")).alias("files_skipped"))
    return counted.crossJoin(findings.agg(F.count(F.lit(1)).alias("total_matches")))


def live_counters(files: DataFrame) -> DataFrame:
    """One row: scanned (without binary files), with_secrets, skipped, binary. files has success, is_binary and matches."""
    done = F.col("success") & ~F.col("is_binary")
    return files.agg(F.count_if(done).alias("scanned"), F.count_if(done & (F.col("matches") > 0)).alias("with_secrets"), F.count_if(~F.col("success")).alias("skipped"), F.count_if(F.col("is_binary")).alias("binary"))


def observed_counts(columns: Iterable[str]) -> list[Column]:
    """What a scan counts of its files while it passes over them: files_scanned, scanned (without binary files), skipped, binary."""
    binary = F.col("is_binary") if "is_binary" in columns else F.lit(False)
    ok = F.col("success")
    return [F.count_if(ok).alias("files_scanned"), F.count_if(ok & ~binary).alias("scanned"), F.count_if(~ok).alias("skipped"), F.count_if(binary).alias("binary")]


def warning_classes(warnings: DataFrame) -> DataFrame:
    """(warning_type, warnings), most first; equal counts by name."""
    m = F.col("message")
    kind = F.when(m.contains("Failed to scan"), "Scan Failures").when(m.contains("Walk error"), "Directory Walk Errors").otherwise("Other Warnings")
    return warnings.groupBy(kind.alias("warning_type")).agg(F.count(F.lit(1)).alias("warnings")).orderBy(F.desc("warnings"), "warning_type")
