"""Findings as JSON, CSV, file lists, text and HTML. Rows are formatted by Spark; a report's frame is put around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import csv_quoted, html_escape, section_id, trim
from ..operators.summaries import by_type
from ..sources.written import written
from .scan import ScanResult

ORDER = ("path", "line_number", "pattern_id", "start_pos")
#: More findings or warnings than this make a text report write files as well.
REPORT_ABOVE = 20


def _match(full: bool = False) -> Column:
    """A finding as a struct, its fields in report order."""
    kept = [F.col("path").alias("file"), F.col("line_number").alias("line"), F.col("secret_type").alias("type"), trim(F.col("line")).alias("content"), "matched_text", "start_pos", "end_pos"]
    return F.struct(*kept, *(["pattern_description"] if full else []))


def json_lines(findings: DataFrame, full: bool = False) -> DataFrame:
    """(path, line_number, pattern_id, start_pos, json): one object a finding. This form has no size limit."""
    return findings.select(*ORDER, F.to_json(_match(full)).alias("json"))


def _pages(findings: DataFrame, warnings: DataFrame, stats: DataFrame, full: bool, head: Column, tail: Column) -> DataFrame:
    """(value), one row a line of a JSON object, in order: head, a line a finding, a line a warning, tail. No value holds more than one of them.

    head and tail may use the columns of stats, n_findings and n_warnings.
    """
    place = F.struct(*ORDER)
    first = findings.agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    least = warnings.agg(F.min("message").alias("first"), F.count(F.lit(1)).alias("n"))
    comma = lambda is_first: F.when(is_first, "").otherwise(",")
    totals = stats.crossJoin(first.select(F.col("n").alias("n_findings"))).crossJoin(least.select(F.col("n").alias("n_warnings")))  # one row each
    at = F.lit(None).cast(findings.select(place).schema[0].dataType).alias("at")
    secrets = findings.crossJoin(F.broadcast(first)).select(F.lit(1), place, F.lit(""), F.concat(comma(place == F.col("first")), F.to_json(_match(full))))
    numbered = warnings.select("message", F.row_number().over(Window.partitionBy("message").orderBy("message")).alias("k"))
    notes = numbered.crossJoin(F.broadcast(least)).select(F.lit(3), F.lit(None), "message", F.concat(comma((F.col("message") == F.col("first")) & (F.col("k") == 1)), F.to_json(F.struct("message"))))
    between = findings.sparkSession.range(1).select(F.lit(2), F.lit(None), F.lit(""), F.lit('],"warnings":['))
    frame = totals.select(F.lit(0).alias("part"), at, F.lit("").alias("note"), head.alias("value")), totals.select(F.lit(4), F.lit(None), F.lit(""), tail)
    return frame[0].union(secrets).union(between).union(notes).union(frame[1]).orderBy("part", "at", "note", F.length("value")).select("value")


def json_document(findings: DataFrame, warnings: DataFrame, stats: DataFrame, duration_ms: int = 0) -> DataFrame:
    """(value), one row a line, in order: an object of results, warnings and statistics."""
    counts = F.struct("files_scanned", "files_skipped", F.col("total_matches").alias("secrets_found"), F.col("n_warnings").alias("warnings_count"), F.lit(duration_ms).alias("scan_duration_ms"))
    return _pages(findings, warnings, stats, False, F.lit('{"results":['), F.concat(F.lit('],"statistics":'), F.to_json(counts), F.lit("}")))


def json_page(findings: DataFrame, warnings: DataFrame, stats: DataFrame, generated_at: int, duration_ms: int = 0, version: str = "1") -> DataFrame:
    """(value), one row a line, in order: the report file with its metadata, summary, secrets and warnings."""
    about = F.struct(F.lit(generated_at).alias("generated_at"), F.lit(version).alias("tool_version"), F.lit(duration_ms).alias("scan_duration_ms"), F.col("files_scanned").alias("total_files_scanned"), F.col("files_skipped").alias("total_files_skipped"))
    summary = F.struct(F.col("n_findings").alias("total_secrets"), F.col("n_warnings").alias("total_warnings"))
    head = F.concat(F.lit('{"report_metadata":'), F.to_json(about), F.lit(',"summary":'), F.to_json(summary), F.lit(',"secrets":['))
    return _pages(findings, warnings, stats, True, head, F.lit("]}"))


CSV_HEADER = "file,line,type,content"


def csv_rows(findings: DataFrame) -> DataFrame:
    """(path, line_number, pattern_id, start_pos, csv): only the content is quoted."""
    return findings.select(*ORDER, F.concat_ws(",", "path", F.col("line_number").cast("string"), "secret_type", csv_quoted(F.col("line"))).alias("csv"))


def text_report(findings: DataFrame, show_content: bool = False) -> DataFrame:
    """(path, line_number, pattern_id, start_pos, text), one row a line of the report, in order: a header for each file, with line_number 0, and its findings."""
    one = F.concat(F.lit("  line "), F.col("line_number").cast("string"), F.lit(": "), F.col("secret_type"), *([F.lit(" "), trim(F.col("line"))] if show_content else []))
    counts = findings.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    headers = counts.select("path", *[F.lit(0).alias(c) for c in ORDER[1:]], F.concat("path", F.lit(" ("), F.col("n").cast("string"), F.lit(" matches)")).alias("text"))
    return headers.unionByName(findings.select(*ORDER, one.alias("text"))).orderBy(*ORDER)


def html_rows(findings: DataFrame) -> DataFrame:
    """(secret_type, section, path, line_number, pattern_id, start_pos, html): one table row a finding, escaped."""
    row = F.concat(F.lit("<tr><td>"), html_escape(F.col("path")), F.lit("</td><td>"), F.col("line_number").cast("string"), F.lit("</td><td><code>"), html_escape(trim(F.col("line"))), F.lit("</code></td></tr>"))
    return findings.select("secret_type", F.concat(F.lit("secrets-"), section_id(F.col("secret_type"))).alias("section"), *ORDER, row.alias("html"))


def html_page(findings: DataFrame, title: str = "Scan report") -> DataFrame:
    """(value), one row a line of the page, in order: sections by type, most findings first. No value holds more than one finding."""
    counts = by_type(findings)  # one row a pattern
    ranked = counts.select("secret_type", "matches", F.row_number().over(Window.orderBy(F.col("matches").desc(), "secret_type")).alias("rank"))
    place = [F.lit(None).cast(t).alias(c) for c, t in zip(ORDER, ("string", "int", "int", "int"), strict=True)]
    one = findings.sparkSession.range(1)
    name = html_escape(F.lit(title))
    head = F.concat(F.lit("<!DOCTYPE html><html><head><meta charset='utf-8'><title>"), name, F.lit("</title></head><body><h1>"), name, F.lit("</h1>"))
    heading = F.concat(F.lit("<h2 id='secrets-"), section_id(F.col("secret_type")), F.lit("'>"), html_escape(F.col("secret_type")), F.lit(" ("), F.col("matches").cast("string"), F.lit(" matches)</h2><table><tr><th>File</th><th>Line</th><th>Context</th></tr>"))
    parts = [
        one.select(F.lit(0).alias("rank"), F.lit(0).alias("kind"), *place, head.alias("value")),
        ranked.select("rank", F.lit(0), *place, heading),
        html_rows(findings).join(F.broadcast(ranked), "secret_type").select("rank", F.lit(1), *[F.col(c) for c in ORDER], "html"),
        ranked.select("rank", F.lit(2), *place, F.lit("</table>")),
        counts.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(1), F.lit(0), *place, F.lit("<p>No findings.</p>")),
        one.select(F.lit(2147483647), F.lit(0), *place, F.lit("</body></html>")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.orderBy("rank", "kind", *ORDER).select("value")


def write_reports(findings: DataFrame, warnings: DataFrame, stats: DataFrame, folder: str, epoch: int, duration_ms: int = 0) -> tuple[str, str]:
    """Write the HTML and the JSON report below a folder, each as a folder of part files that make up the report when put together in the order of their names."""
    html, js = (f"{folder.rstrip('/')}/{name}" for name in report_names(epoch))
    html_page(findings).write.text(html)
    json_page(findings, warnings, stats, epoch, duration_ms).write.text(js)
    return html, js


def wants_report(findings: DataFrame, warnings: DataFrame) -> bool:
    """Whether a text report writes report files as well: more than REPORT_ABOVE findings or warnings. No more rows than that are looked at."""
    return any(rows.limit(REPORT_ABOVE + 1).count() > REPORT_ABOVE for rows in (findings, warnings))


def report(result: ScanResult, folder: str, epoch: int, duration_ms: int = 0, show_content: bool = False) -> tuple[DataFrame | None, tuple[str, str] | None]:
    """(text, None) of a scan with few findings and warnings, or (None, paths of its HTML and JSON report).

    Findings and warnings are each written once; every part of the report starts from them.
    """
    findings, warnings = result.saved, written(result.warnings)
    if not wants_report(findings, warnings):
        return text_report(findings, show_content), None
    return None, write_reports(findings, warnings, result.stats, folder, epoch, duration_ms)


def report_names(epoch: int) -> tuple[str, str]:
    return f"scan-report-{epoch}.html", f"scan-report-{epoch}.json"


def exit_code(findings: DataFrame) -> int:
    return 0 if findings.isEmpty() else 1
