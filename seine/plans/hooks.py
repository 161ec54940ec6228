"""Filters and checks of repository hooks as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import commit_message, commit_scope, commit_type
from ..operators.predicates import matches_glob
from ..operators.summaries import first_findings

SHOWN = 5


def files_for_command(files: DataFrame, globs: Sequence[str] = (), all_files: bool = False) -> DataFrame:
    """The paths that a command runs on. A command over all files needs globs."""
    if all_files and not globs:
        raise ValueError("a command over all files needs globs")
    return files.filter(matches_glob(F.col("path"), globs)) if globs else files


def commit_checks(messages: DataFrame, column: str = "message") -> DataFrame:
    """messages plus clean, type, scope, verdict (valid, invalid or empty) and advice."""
    clean = commit_message(F.col(column))
    rows = messages.withColumn("clean", clean).withColumns({"type": commit_type(F.col("clean")), "scope": commit_scope(F.col("clean"))})
    verdict = F.when(F.col("clean") == "", "empty").when(F.col("type").isNull(), "invalid").otherwise("valid")
    rows = rows.withColumn("verdict", verdict).withColumn("scope", F.when(F.col("verdict") == "valid", F.col("scope")))
    return rows.withColumn("advice", F.when((F.col("type") == "feat") & F.col("scope").isNull(), "Consider adding a scope to feat commits"))


def pre_commit(findings: DataFrame) -> tuple[bool, DataFrame]:
    """Whether the commit may pass, and the first findings to show."""
    return findings.isEmpty(), first_findings(findings, SHOWN)
