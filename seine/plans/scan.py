"""The scan: files to findings, statistics and warnings, as one narrow stage up to the aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.fs as pafs
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import Pattern, library
from ..functions.reuse import reused
from ..functions.text import lines_of
from ..operators.blocks import test_blocks
from ..operators.matcher import find, gate_lines, gated
from ..operators.predicates import contains_any, ignored_next, streamed, test_line
from ..operators.summaries import observed_counts
from ..sources.chunks import RANGE, counted, file_states, lines_of_parts, ranges
from ..sources.config import ScanConfig
from ..sources.files import as_uri, decoded, listed, scannable, skipped, walk_all
from ..sources.written import written

FINDINGS = ["path", "line_number", "line", "matched_text", "start_pos", "end_pos", "secret_type", "pattern_description", "pattern_id"]


@dataclass
class ScanResult:
    """findings, files and warnings are lazy, each a plan of its own."""

    findings: DataFrame
    files: DataFrame
    warnings: DataFrame
    observed: Callable[[Observation], DataFrame]

    @cached_property
    def _job(self) -> tuple[DataFrame, dict[str, int]]:
        observation = Observation()
        rows = written(self.observed(observation))
        try:
            counts = observation.get
        except Py4JError:  # a plan without any row is optimized away, and its metrics with it
            counts = dict.fromkeys(("files_scanned", "scanned", "skipped", "binary"), 0)
        return rows, counts

    @property
    def saved(self) -> DataFrame:
        """The findings, written in the shared folder by one job, which also counts the files on its way."""
        return self._job[0]

    @cached_property
    def counters(self) -> dict[str, int]:
        """scanned (without binary files), with_secrets, skipped, binary, files_scanned and total_matches of the job that writes `saved`.

        Those of files are metrics of that job's own pass over them; with_secrets and total_matches count what it wrote.
        """
        rows = self.saved.agg(F.countDistinct("path").alias("with_secrets"), F.count(F.lit(1)).alias("total_matches")).first()
        return {**self._job[1], **rows.asDict()}

    @property
    def stats(self) -> DataFrame:
        """One row: files_scanned, files_skipped, total_matches. Nothing is scanned again."""
        c = self.counters
        return self.findings.sparkSession.createDataFrame([(c["files_scanned"], c["skipped"], c["total_matches"])], "files_scanned long, files_skipped long, total_matches long")


@reused
def _line_rules(comments: tuple[str, ...], substrings: tuple[str, ...], attributes: tuple[str, ...] | None, modules: tuple[str, ...]) -> Column:
    """Whether no rule about a line alone leaves it out; without attributes test lines stay."""
    line = F.col("line")
    kept = ~contains_any(line, comments) & ~contains_any(line, substrings)
    return kept if attributes is None else kept & ~test_line(line, attributes, modules)


@reused
def _blocks(attributes: tuple[str, ...], modules: tuple[str, ...]) -> Column:
    none = F.array().cast("array<struct<start_line:int,end_line:int>>")
    return F.when(F.col("streamed"), none).otherwise(test_blocks(F.col("lines"), F.col("path"), F.col("text"), attributes, modules))


@reused
def _numbered(outside_blocks: bool) -> Column:
    """The lines of a file, as rows."""
    kept = F.transform(F.col("lines"), lambda x, i: F.struct((i + 1).alias("line_number"), x.alias("line"), F.get(F.col("lines"), i - 1).alias("previous")))
    if outside_blocks:
        # blocks are few and most files have none, so most lines are not tested against any
        kept = F.when(F.size("blocks") == 0, kept).otherwise(F.filter(kept, lambda r: ~F.exists(F.col("blocks"), lambda b: (b["start_line"] < r["line_number"]) & (r["line_number"] <= b["end_line"]))))
    return F.inline(kept)


class Scanner:
    """Scans tables of (path, text) or folders. Every result is lazy."""

    def __init__(self, config: ScanConfig | None = None, patterns: Sequence[str] = ()):
        self.config = config or ScanConfig()
        self.patterns: tuple[Pattern, ...]
        self.patterns, self.pattern_warnings = library(self.config.custom_patterns, patterns)

    def lines(self, files: DataFrame) -> DataFrame:
        """(path, line_number, line) of the lines that a scan looks at. files: path, text, and streamed if it has lengths.

        Lines of files that are read as streams are exempt from test blocks and from the directive for the next line.
        """
        c = self.config
        whole = F.col("streamed") if "streamed" in files.columns else F.lit(False)
        rows = files.select("path", whole.alias("streamed"), "text", lines_of(F.col("text")).alias("lines"))
        if c.ignore_test_code:
            rows = rows.withColumn("blocks", _blocks(tuple(c.test_attributes), tuple(c.test_modules)))
        return self._wanted(rows.select("path", "streamed", _numbered(c.ignore_test_code)))

    def _wanted(self, rows: DataFrame) -> DataFrame:
        """The lines of (path, streamed, line_number, line, previous) that no rule about lines leaves out."""
        c = self.config
        rows = rows.filter(gate_lines("line", self.patterns))
        rows = rows.filter(_line_rules(tuple(c.ignore_comments), tuple(c.ignore_patterns), tuple(c.test_attributes) if c.ignore_test_code else None, tuple(c.test_modules)))
        return rows.filter(F.col("streamed") | ~ignored_next(F.col("previous"), c.ignore_next)).select("path", "line_number", "line")

    def findings(self, files: DataFrame) -> DataFrame:
        return self._found(self.lines(files))

    def line_findings(self, lines: DataFrame) -> DataFrame:
        """Findings in lines (path, line_number, line) that come without their files, as of files that are read in parts.

        Equal lines of a file have equal findings, so a line that may hold one is looked at once for all its places in an
        Arrow batch, and its findings are dealt out to these. Nothing is shuffled.
        """
        wanted = self._wanted(lines.withColumns({"streamed": F.lit(True), "previous": F.lit(None).cast("string")}))

        def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = pa.Table.from_batches([batch]).group_by(["path", "line"]).aggregate([("line_number", "list")])
                yield from rows.select(["path", "line", "line_number_list"]).rename_columns(["path", "line", "_places"]).to_batches()

        once = wanted.select("path", "line", "line_number").mapInArrow(together, "path string, line string, _places array<int>")
        # a place holder for find(), which hands on the columns that it is given
        found = self._found(once.select("path", F.lit(0).alias("line_number"), "line", "_places"), "_places")
        return found.withColumn("line_number", F.explode("_places")).select(*FINDINGS)

    def outside_findings(self, lines: DataFrame) -> DataFrame:
        """Findings in lines (path, line_number, line, previous) that stand outside test blocks."""
        return self._found(self._wanted(lines.withColumn("streamed", F.lit(False))))

    def _found(self, lines: DataFrame, *more: str) -> DataFrame:
        c = self.config
        found = find(lines, self.patterns, strict_groups=c.strict_groups)
        if c.entropy:
            found = gated(found, c.threshold, c.bigrams)
        return found.select(*FINDINGS, *more)

    def scan_table(self, files: DataFrame) -> ScanResult:
        """files: path, text; a null text is a file that could not be read."""
        flagged = files.withColumn("success", F.col("text").isNotNull())
        return self._result(flagged)

    def scan_flagged(self, files: DataFrame) -> ScanResult:
        """files: path, text, success, is_binary; files with a null text are counted and not looked at."""
        return self._result(files)

    def scan_files(self, flagged: DataFrame, root: str, include_binary: bool | None = None, errors: DataFrame | None = None, balanced: bool = False, range_bytes: int = RANGE) -> ScanResult:
        """Files of a listing with the flags of sources.files.scannable.

        Files that are streamed are read in ranges by many tasks; this is prepared when called, in one pass over them.
        balanced: the others are dealt out by their bytes.
        """
        binary = self.config.include_binary if include_binary is None else include_binary
        in_parts = streamed(F.col("length"), self.config.whole_mib) & ~skipped()
        rest = decoded(flagged.filter(~in_parts), root, binary, balanced)
        large = flagged.filter(in_parts)
        if large.isEmpty():
            return self._result(rest, errors)
        parts = counted(ranges(large, range_bytes), root)
        states = file_states(parts)
        if binary:
            states = states.join(parts.groupBy("path").agg(F.max("bad").alias("bad")), "path").select("path", (~F.col("bad")).alias("success"), F.lit(False).alias("is_binary"))
        states = written(states)
        known = large.drop("is_binary").join(states, "path").withColumn("text", F.lit(None).cast("string")).select(*rest.columns)
        good = parts.join(states.filter("success and not is_binary").select("path"), "path", "left_semi")
        return self._result(rest, errors, known, lines_of_parts(good, root))

    def _walked(self, spark: SparkSession, root: str, **rules) -> DataFrame:
        c = self.config
        return walk_all(spark, root, follow_symlinks=c.follow_symlinks, **rules)

    def scan_directory(self, spark: SparkSession, root: str, ignore_files: bool = True, global_rules: Sequence[str] = ()) -> ScanResult:
        """All files below a root that ignore files, directory names and the configuration leave.

        Ignore files count as in git: those of every folder, the repository's exclude file, those of parent folders in
        the repository, and last the lines of a global one. A folder that cannot be listed gives a warning. The walk runs
        when this is called, once; its written listing is dealt out to reading tasks by bytes.
        """
        c = self.config
        found = self._walked(spark, root, ignore_files=ignore_files, rules=tuple(global_rules), directories=tuple(c.directories))
        files = found.filter("kind = 'file'").drop("kind", "message")
        errors = found.filter("kind = 'error'").select("path", "message")
        return self.scan_files(scannable(files, c.ignore_paths, c.directories, c.binary_extensions, c.max_file_mib, c.include_binary), root, errors=errors, balanced=True)

    def scan_paths(self, spark: SparkSession, root: str, paths: DataFrame) -> ScanResult:
        """An explicit list of paths (path) below a root: neither ignore files, directory names nor the binary test apply.

        Only these are looked up, once, when this is called; they are dealt out to reading tasks by bytes.
        """
        c = self.config
        return self.scan_files(scannable(written(listed(paths, root)), c.ignore_paths, (), (), c.max_file_mib, True), root, True, balanced=True)

    def scan_file(self, spark: SparkSession, path: str) -> ScanResult:
        """One file, which no rule but the configured ignore paths and size leaves out."""
        folder, _, _ = path.rpartition("/")
        return self.scan_paths(spark, folder or ".", spark.createDataFrame([(pafs.FileSystem.from_uri(as_uri(path))[1],)], "path string"))

    def _result(self, files: DataFrame, errors: DataFrame | None = None, in_parts: DataFrame | None = None, part_lines: DataFrame | None = None) -> ScanResult:
        """in_parts: files like `files`, without texts; part_lines: their lines."""
        every = files if in_parts is None else files.unionByName(in_parts)

        def found(rows: DataFrame) -> DataFrame:
            findings = self.findings(rows.filter(F.col("text").isNotNull()))
            return findings if part_lines is None else findings.unionByName(self.line_findings(part_lines))

        failed = every.filter(~F.col("success")).select("path", F.concat(F.lit("Failed to scan "), F.col("path"), F.lit(": not readable as UTF-8")).alias("message"))
        own = every.sparkSession.createDataFrame([(None, w) for w in self.pattern_warnings], "path string, message string")
        warnings = failed.unionByName(own)
        observed = lambda observation: found(every.observe(observation, *observed_counts(every.columns)))
        return ScanResult(found(every), every, warnings if errors is None else warnings.unionByName(errors), observed)
