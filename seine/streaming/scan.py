"""Scanning streams of lines. Every operator but test blocks and the directive for the next line looks at one line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matcher import find, gated
from ..operators.predicates import contains_any, test_line
from ..plans.scan import Scanner


def scan_stream(lines: DataFrame, scanner: Scanner | None = None, line: str = "line") -> DataFrame:
    """A streaming or batch DataFrame of lines with its findings: columns of lines and those of operators.matcher.find.

    Stateless, so it needs no watermark and may run in append mode.
    """
    scanner = scanner or Scanner()
    c = scanner.config
    text = F.col(line)
    rows = lines.filter(~contains_any(text, c.ignore_comments) & ~contains_any(text, c.ignore_patterns))
    if c.ignore_test_code:
        rows = rows.filter(~test_line(text, c.test_attributes, c.test_modules))
    found = find(rows, scanner.patterns, line, c.strict_groups)
    return (gated(found, c.threshold, c.bigrams) if c.entropy else found).drop("secret")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, line) over text files that appear in a folder."""
    return spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def counts_by_window(found: DataFrame, time: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, secret_type, matches) over event time; rows later than the watermark are dropped."""
    return found.withWatermark(time, late).groupBy(F.window(time, window), "secret_type").agg(F.count(F.lit(1)).alias("matches"))
