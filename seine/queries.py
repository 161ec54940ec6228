"""The queries of the scanning engine over the test tables and over sample files with planted tokens."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import entropy, text
from .operators import drift, predicates, summaries
from .operators.blocks import test_blocks
from .operators.matcher import find, gate
from .functions.patterns import BUILT_IN, library, pattern_table
from .plans import hooks, reports
from .plans.scan import Scanner
from .samples import BLOCKS, IGNORED, TOKENS, repository_files
from .sources import files as file_source
from .sources import folder_tree, staged, tables, written
from .sources.config import ScanConfig
from .streaming import blocks as blocks_stream


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str, *groups) -> DataFrame:
    """The sample files of a group of templates, from one scan of supplier."""
    key = F.col("s_suppkey").cast("string")
    seeds = tables.spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(key.alias("k"), F.md5(key).alias("h"), F.md5(F.concat(F.lit("g"), key)).alias("g"), F.lit("\n").alias("n"))
    made = F.array(*[F.struct(F.expr(p).alias("path"), F.expr(t).alias("text")) for g in groups for p, t in g])
    return seeds.select(F.inline(made))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return tables.as_files(docs, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and sample files without test blocks."""
    return documents(spark, sf_dir).unionByName(samples(spark, sf_dir, TOKENS, IGNORED))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scanner().findings(corpus(spark, sf_dir))


PLACE = ("path", "line_number", "pattern_id", "start_pos")


def lines_explode(spark, sf_dir):
    return tables.lines(documents(spark, sf_dir)).select("path", "line_number", "line")


def line_stats_by_lang(spark, sf_dir):
    docs = tables.spread(table(spark, sf_dir, "documents").select("lang", "text")).select("lang", F.explode(text.lines_of(F.coalesce("text", F.lit("")))).alias("line"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.max(F.char_length("line")).alias("longest"), F.sum(F.octet_length("line")).alias("bytes"), F.count_if(F.col("line") == "").alias("empty"))


def findings_raw(spark, sf_dir):
    found = find(tables.lines(documents(spark, sf_dir).unionByName(samples(spark, sf_dir, TOKENS))), BUILT_IN)
    return found.select(*PLACE, "secret_type", "matched_text", "end_pos", "secret")


def findings(spark, sf_dir):
    return scanned(spark, sf_dir).select(*PLACE, "secret_type", "matched_text", "end_pos")


def findings_strict_groups(spark, sf_dir):
    found = find(tables.lines(documents(spark, sf_dir).unionByName(samples(spark, sf_dir, TOKENS))), BUILT_IN, strict_groups=True)
    return found.select(*PLACE, "matched_text", "secret")


def findings_per_pattern(spark, sf_dir):
    return summaries.by_pattern(scanned(spark, sf_dir))


def findings_per_file(spark, sf_dir):
    return summaries.by_file(scanned(spark, sf_dir))


def findings_by_type(spark, sf_dir):
    return summaries.by_type(scanned(spark, sf_dir))


def files_with_findings(spark, sf_dir):
    return summaries.files_with_findings(scanned(spark, sf_dir))


def count_only(spark, sf_dir):
    return scanned(spark, sf_dir).agg(F.count(F.lit(1)).alias("matches"))


def first_findings(spark, sf_dir):
    return summaries.first_findings(scanned(spark, sf_dir), 5).select(*PLACE, "matched_text")


def first_per_file(spark, sf_dir):
    return summaries.first_per_file(scanned(spark, sf_dir), 2).select(*PLACE, "place")


def _tokens(spark, sf_dir) -> DataFrame:
    """Words of names and values of sample tokens."""
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_name").alias("token")))
    planted = find(tables.lines(samples(spark, sf_dir, TOKENS)), BUILT_IN).select(F.col("secret").alias("token"))
    return names.unionByName(planted).filter("token != ''").distinct()


def _log(p: Column) -> Column:
    """Six digits of a probability's logarithm, so that both engines' last bits do not matter; null for null, -999 for 0."""
    return F.when(p > 0, F.round(F.log10(p), 6) + F.lit(0.0)).when(p == 0, F.lit(-999.0))


def entropy_probability(spark, sf_dir):
    rows = entropy.with_randomness(_tokens(spark, sf_dir), "token")
    return rows.select("token", "base", entropy.distinct_bytes(F.col("token")).alias("distinct_bytes"), entropy.bigram_count(F.col("token"), entropy.default_bigrams()).alias("bigrams"), *[_log(F.col(f"p_{x}")).alias(f"log_{x}") for x in ("distinct", "class", "bigram")], _log(F.col("p")).alias("log_p"))


def common_bigrams(spark, sf_dir):
    """The 488 most frequent pairs of characters in documents and sample files, as a table for the gate."""
    return entropy.common_bigrams(corpus(spark, sf_dir), "text")


def likely_secret(spark, sf_dir):
    rows = entropy.with_randomness(_tokens(spark, sf_dir), "token")
    return rows.select("token", entropy.likely(F.col("token"), F.col("p"), 1e-5).alias("likely"), entropy.likely(F.col("token"), F.col("p"), 1e-3).alias("likely_strict"))


def line_predicates(spark, sf_dir):
    rows = tables.lines(documents(spark, sf_dir).unionByName(samples(spark, sf_dir, TOKENS, IGNORED, BLOCKS)))
    line = F.col("line")
    return rows.select(
        "path", "line_number", predicates.contains_any(line, predicates.IGNORE_COMMENTS).alias("comment"), predicates.contains_any(line, predicates.IGNORED_SUBSTRINGS).alias("substring"),
        predicates.test_line(line).alias("test_line"), predicates.ignored_next(F.col("previous")).alias("next"), text.indent(line).alias("indent"),
    )


#: Name parts that make paths of every kind: SQL expressions over k, the key of a row of part.
_PATHS = ("'tests/a' || k || '.txt'", "'./tests/a' || k || '.txt'", "'src/x' || k || '_test.rs'", "'src/test_' || k || '.rs'", "'test_' || k || '.py'", "'.env'", "'build/' || k || '.txt'", "'img/A' || k || '.PNG'", "'noext' || k", "'a.b/' || k", "'.png'", "'x/y.tar.gz'", "'app/' || k || '.spec.ts'")


def _paths(spark, sf_dir) -> DataFrame:
    table(spark, sf_dir, "part").select("p_partkey", "p_size").createOrReplaceTempView("part")
    return spark.sql("WITH p AS (SELECT cast(p_partkey AS string) AS k, p_size, p_partkey FROM part) " + " UNION ALL ".join(f"SELECT {p} AS path, cast(p_partkey AS bigint) * 104857 AS length FROM p" for p in _PATHS))


def path_predicates(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select(
        "path", "length", predicates.matches_glob(path, predicates.IGNORED_PATHS).alias("ignored"), predicates.in_filtered_directory(path).alias("filtered"), predicates.binary_extension(path).alias("is_binary"),
        text.extension(path).alias("extension"), predicates.too_large(F.col("length")).alias("large"), predicates.streamed(F.col("length")).alias("streamed"), text.shown_path(path).alias("shown"),
    )


def fast_count(spark, sf_dir):
    return file_source.fast_count(_paths(spark, sf_dir).withColumnRenamed("path", "rel_path"))


def test_block_ranges(spark, sf_dir):
    rows = documents(spark, sf_dir).unionByName(samples(spark, sf_dir, BLOCKS, IGNORED))
    return rows.select("path", F.inline(test_blocks(text.lines_of(F.col("text")), F.col("path"), F.col("text"))))


def findings_outside_tests(spark, sf_dir):
    return Scanner().findings(documents(spark, sf_dir).unionByName(samples(spark, sf_dir, BLOCKS))).select(*PLACE, "matched_text")


#: Files beside the samples in a folder: ignore files, a hidden file, a file of an ignored folder, a binary name, binary content, invalid UTF-8. SQL over n, a line feed.
_BESIDE = (
    ("'.gitignore'", "'logs/' || n || '/src/jwt*' || n || '!src/jwt1.txt' || n || '*.tmp'"),
    ("'src/.gitignore'", "'# kept out' || n || 'github*'"),
    ("'logs/a.txt'", "'token = 0a1b2c3d4e5f60718293a4b5c6d7e8f9'"),
    ("'src/deep/down/x.tmp'", "'token = 0a1b2c3d4e5f60718293a4b5c6d7e8f9'"),
    ("'src/deep/down/x.txt'", "'token = 0a1b2c3d4e5f60718293a4b5c6d7e8f9'"),
    ("'.hidden'", "'key = 9f8e7d6c5b4a39281706f5e4d3c2b1a0'"),
    ("'node_modules/x.txt'", "'token = 0a1b2c3d4e5f60718293a4b5c6d7e8f9'"),
    ("'a.png'", "'token = 0a1b2c3d4e5f60718293a4b5c6d7e8f9'"),
)


def _folder(spark, sf_dir) -> str:
    """A folder on shared storage with the sample files and those beside them."""
    made = F.array(*[F.struct(F.expr(p).alias("path"), F.expr(t).alias("text")) for p, t in _BESIDE])
    rows = samples(spark, sf_dir, TOKENS, IGNORED).unionByName(spark.sql("SELECT '\n' AS n").select(F.inline(made)))
    rows = rows.select(F.col("path").alias("rel_path"), F.col("text").cast("binary").alias("content"))
    odd = spark.sql("SELECT 'bad.txt' AS rel_path, X'746F6BFFFE' AS content UNION ALL SELECT 'bin.dat2', X'007F454C4602'")
    root = file_source.shared_folder(spark)
    file_source.write_files(rows.unionByName(odd), root)
    return root


def _below(root: str) -> Column:
    return F.substring_index("path", f"{root.rsplit('/', 1)[1]}/", -1)


def directory_findings(spark, sf_dir):
    """Findings of a scan of a folder of files that this query writes."""
    root = _folder(spark, sf_dir)
    return Scanner().scan_directory(spark, root).findings.select(_below(root).alias("path"), "line_number", "pattern_id", "start_pos", "matched_text")


def directory_files(spark, sf_dir):
    """The files that such a scan looks at, and what it takes them for."""
    root = _folder(spark, sf_dir)
    files = Scanner().scan_directory(spark, root).files
    return files.select("rel_path", F.octet_length("text").cast("string").alias("bytes"), "is_binary", "is_large", "success")


#: Two shapes of a tree for the same files: one folder, and a single branch of forty folders that holds them at its end. SQL over rel_path.
_SHAPES = {"flat": "replace(rel_path, '/', '-')", "branch": "concat(repeat('b/', 40), replace(rel_path, '/', '-'))"}


def _shaped(spark, sf_dir, shape: str) -> str:
    root = file_source.shared_folder(spark)
    rows = samples(spark, sf_dir, TOKENS).select(F.col("path").alias("rel_path"), F.col("text").cast("binary").alias("content"))
    file_source.write_files(rows.withColumn("rel_path", F.expr(_SHAPES[shape])), root)
    return root


def directory_shapes(spark, sf_dir):
    """Findings by file of folder scans of a flat tree and of one long branch that hold the same files."""
    found = None
    for shape in _SHAPES:
        rows = Scanner().scan_directory(spark, _shaped(spark, sf_dir, shape)).findings
        rows = rows.groupBy(F.lit(shape).alias("shape"), F.substring_index("path", "/", -1).alias("name")).agg(F.count(F.lit(1)).alias("matches"))
        found = rows if found is None else found.unionByName(rows)
    return found


def directory_shares(spark, sf_dir):
    """Files of a folder by path, with the reading task that each is given: a share of the bytes for every task."""
    listed = file_source.walk(spark, _shaped(spark, sf_dir, "flat")).select("rel_path", "path", "length")
    return written.shared_out(listed, ["rel_path", "path"], F.col("length"), open_cost=100, tasks=7).select("rel_path", "length", "task")


#: How often a sample file's text is repeated in a file that is read in ranges of so many bytes.
_REPEATS, _RANGE = 30, 700


def streamed_findings(spark, sf_dir):
    """Findings in files that are read in byte ranges by several tasks; only rules about single lines apply to them."""
    root = file_source.shared_folder(spark)
    rows = samples(spark, sf_dir, TOKENS, IGNORED, BLOCKS)
    file_source.write_files(rows.select(F.col("path").alias("rel_path"), F.repeat(F.concat("text", F.lit("\r\n")), F.lit(_REPEATS)).cast("binary").alias("content")), root)
    result = Scanner(ScanConfig(whole_mib=-1)).scan_files(file_source.scannable(file_source.walk(spark, root), (), ()), root, range_bytes=_RANGE)
    return result.findings.select(_below(root).alias("path"), "line_number", "pattern_id", "start_pos", "matched_text")


def folder_source(spark, sf_dir):
    """Files of a folder as a data source, with conditions that are applied before any file is opened."""
    files = folder_tree.read_tree(spark, _shaped(spark, sf_dir, "flat"))
    return files.filter(F.col("rel_path").startswith("src-g") & (F.col("length") <= 90)).select("rel_path", "length", F.md5("content").alias("digest"))


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Sample files, and a version of some of them of which some are longer."""
    source = samples(spark, sf_dir, TOKENS).select(F.col("path").alias("rel_path"), "text")
    there = source.filter(F.substring(F.md5("rel_path"), 1, 1) < "8").withColumn("text", F.when(F.substring(F.md5("rel_path"), 2, 1) < "8", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return source, there


def sync_copy(spark, sf_dir):
    """A destination folder after a copy of what differs, read back, with what was copied."""
    roots = [file_source.shared_folder(spark) for _ in range(2)]
    for rows, root in zip(_versions(spark, sf_dir), roots, strict=True):
        folder_tree.write_tree(rows.select("rel_path", F.col("text").cast("binary").alias("content")), root)
    copied = folder_tree.sync_copy(spark, *roots).select("rel_path", F.lit(True).alias("copied"))
    after = folder_tree.read_tree(spark, roots[1]).select("rel_path", F.md5("content").alias("digest"))
    return after.join(copied, "rel_path", "left").select("rel_path", "digest", F.coalesce("copied", F.lit(False)).alias("copied"))


def stream_findings(spark, sf_dir):
    """Findings of a stream of files' lines in micro-batches, by the rules about whole files."""
    files = documents(spark, sf_dir).unionByName(samples(spark, sf_dir, BLOCKS, IGNORED))
    rows = tables.lines(files).select("path", "line_number", "line")
    ends = files.select("path", (F.size(text.lines_of(F.col("text"))) + 1).alias("line_number"), F.lit(None).cast("string").alias("line"))
    root = file_source.shared_folder(spark)
    out = f"{root}/findings"
    # lines arrive in three turns by their numbers, ends in the last; each turn goes on from the state of the one before
    turn = F.least(F.floor((F.col("line_number") - 1) / 3), F.lit(2))
    for n in range(3):
        part = rows.filter(turn == n)
        (part.unionByName(ends) if n == 2 else part).write.mode("append").parquet(f"{root}/lines")
        stream = spark.readStream.schema("path string, line_number int, line string").parquet(f"{root}/lines")
        blocks_stream.scan_files_stream(stream).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select(*PLACE, "matched_text")


def staged_files(spark, sf_dir):
    """What is staged in repositories that this query writes, one for each supplier: of five committed files some change, some go, and one is new."""

    def made(batches):
        for batch in batches:
            names, contents = [], []
            for k in batch.column("s_suppkey").to_pylist():
                before = {f"d{i % 2}/f{i}.txt": f"{k}-{i}".encode() for i in range(5)}
                now = {p: body + b"!" * ((k + i) % 5 == 1) for i, (p, body) in enumerate(before.items()) if (k + i) % 5} | {f"new/{k}.txt": b"new"}
                for name, content in repository_files(before, now).items():
                    names.append(f"{k}/{name}")
                    contents.append(content)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["rel_path", "content"])

    suppliers = tables.spread(table(spark, sf_dir, "supplier").select("s_suppkey"))
    root = file_source.shared_folder(spark)
    file_source.write_files(suppliers.mapInArrow(made, "rel_path string, content binary"), root)
    repos = suppliers.select(F.concat(F.lit(f"{root}/"), F.col("s_suppkey").cast("string")).alias("path"))
    return staged.staged_files(repos).select(F.substring_index("repo", "/", -1).alias("repo"), "rel_path", "change")


def directory_walk_errors(spark, sf_dir):
    """Classes of warnings of a scan of a folder in which every supplier has a good file and one of invalid UTF-8, and of a folder that is not there."""
    root = file_source.shared_folder(spark)
    rows = tables.spread(table(spark, sf_dir, "supplier").select("s_suppkey")).selectExpr("inline(array(named_struct('rel_path', 'good/' || s_suppkey, 'content', CAST('fine' AS BINARY)), named_struct('rel_path', 'bad/' || s_suppkey, 'content', X'746F6BFFFE')))")
    file_source.write_files(rows, root)
    found = Scanner().scan_directory(spark, root).warnings.unionByName(Scanner().scan_directory(spark, f"{root}/gone").warnings)
    return summaries.warning_classes(found.select("message"))


def explicit_paths(spark, sf_dir):
    """Findings of an explicit list of paths, with two that a folder scan leaves out and one that is not there, and of a single file."""
    root = _folder(spark, sf_dir)
    top = file_source.as_uri(root).split("://", 1)[1]
    own = samples(spark, sf_dir, TOKENS).select(F.col("path").alias("name"))
    listed = own.unionByName(spark.sql("SELECT explode(array('a.png', 'logs/a.txt', 'not-there')) AS name")).select(F.concat(F.lit(f"{top}/"), "name").alias("path"))
    found = Scanner().scan_paths(spark, root, listed).findings.unionByName(Scanner().scan_file(spark, f"{root}/.hidden").findings)
    return found.select(_below(root).alias("path"), "line_number", "pattern_id", "start_pos", "matched_text")


def _flagged(spark, sf_dir) -> DataFrame:
    """All documents as files, and sample files that stand for unreadable and for binary ones."""
    flag = lambda rows, success, binary: rows.withColumns({"success": F.lit(success), "is_binary": F.lit(binary)})
    unreadable, binary = flag(samples(spark, sf_dir, IGNORED), False, False), flag(samples(spark, sf_dir, BLOCKS), True, True)
    return flag(documents(spark, sf_dir), True, False).unionByName(unreadable).unionByName(binary)


def scan_stats(spark, sf_dir):
    files = _flagged(spark, sf_dir)
    return summaries.scan_stats(files, Scanner().findings(files.filter("success and not is_binary")))


def live_counters(spark, sf_dir):
    files = _flagged(spark, sf_dir)
    counts = summaries.by_file(Scanner().findings(files.filter("success and not is_binary"))).select("path", "matches")
    return summaries.live_counters(files.join(counts, "path", "left").withColumn("matches", F.coalesce("matches", F.lit(0))))


def scan_counters(spark, sf_dir):
    """All counters of a scan, as metrics of the one job that writes its findings."""
    flagged = _flagged(spark, sf_dir)
    files = flagged.withColumn("text", F.when(F.col("success") & ~F.col("is_binary"), F.col("text")))
    counters = Scanner().scan_flagged(files).counters
    names = ("scanned", "with_secrets", "skipped", "binary", "total_matches")
    return spark.createDataFrame([tuple(counters[n] for n in names)], ", ".join(f"{n} long" for n in names))


def warning_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "Failed to scan ").when(F.col("lang") == "de", "Walk error: ").otherwise("Note: ")
    return summaries.warning_classes(docs.select(F.concat(kind, F.col("doc_id").cast("string")).alias("message")))


def json_results(spark, sf_dir):
    return reports.json_lines(scanned(spark, sf_dir))


def csv_results(spark, sf_dir):
    return reports.csv_rows(scanned(spark, sf_dir))


def html_results(spark, sf_dir):
    return reports.html_rows(scanned(spark, sf_dir))


def text_results(spark, sf_dir):
    return reports.text_report(written.written(scanned(spark, sf_dir)), True)


def report_lines(spark, sf_dir):
    """The lines of the JSON report that a scan with many findings writes, read back."""
    flagged = _flagged(spark, sf_dir)
    result = Scanner().scan_flagged(flagged.withColumn("text", F.when(F.col("success") & ~F.col("is_binary"), F.col("text"))))
    _, (_, js) = reports.report(result, file_source.shared_folder(spark), 1)
    return spark.read.text(js)


def html_page_lines(spark, sf_dir):
    # every part of the page starts from findings that are made once
    return reports.html_page(written.written(scanned(spark, sf_dir))).withColumnRenamed("value", "html")


def custom_patterns(spark, sf_dir):
    """Matches of configured expressions, in the engine's own dialect, and the warning about a wrong one."""
    regexes = (r"\p{Lu}{2}_\p{L}+", r"(?P<word_1>[a-z]+)-(?<n>\d+)\z", "(", r"\bkey\b")
    own, warnings = library(regexes)
    found = find(tables.lines(corpus(spark, sf_dir)), own[len(BUILT_IN) :])
    counts = found.groupBy("secret_type").agg(F.count(F.lit(1)).alias("matches"), F.min("secret").alias("least"))
    return counts.unionByName(spark.sql(f"SELECT 'warnings' AS secret_type, CAST({len(warnings)} AS BIGINT) AS matches, '' AS least"))


def _scan_column(spark, sf_dir, name: str, path: Column, column: str) -> DataFrame:
    """Matches by pattern in a table's column and in the sample tokens appended to it, before the gate."""
    rows = tables.as_files(tables.spread(table(spark, sf_dir, name)), path, F.col(column)).unionByName(samples(spark, sf_dir, TOKENS))
    return summaries.by_pattern(find(tables.lines(rows), BUILT_IN))


def scan_pages(spark, sf_dir):
    return _scan_column(spark, sf_dir, "pages", F.col("page_id"), "html")


def scan_conversations(spark, sf_dir):
    return _scan_column(spark, sf_dir, "conversations", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text")


def scan_event_props(spark, sf_dir):
    return _scan_column(spark, sf_dir, "events", F.col("event_id"), "props")


def patterns(spark, sf_dir):
    """The library, and how many lines of documents hold a literal that a match of each expression needs."""
    lines = tables.lines(documents(spark, sf_dir))
    counts = lines.agg(*[F.count_if(gate(F.col("line"), p)).alias(str(i)) for i, p in enumerate(BUILT_IN, 1)])
    counts = counts.unpivot([], [str(i) for i in range(1, len(BUILT_IN) + 1)], "i", "candidate_lines").select(F.col("i").cast("int").alias("pattern_id"), "candidate_lines")
    return pattern_table(spark).join(counts, "pattern_id")


def _listings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts as files of a source; a destination that renames, resizes or rewrites some of them."""
    p = table(spark, sf_dir, "part")
    source = p.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string")).alias("rel_path"), F.col("p_size").cast("long").alias("length"), F.md5("p_name").alias("digest"))
    key = F.col("p_partkey")
    there = p.select(F.concat("p_brand", F.lit("/"), key.cast("string"), F.when(key % 5 == 0, ".old").otherwise("")).alias("rel_path"), (F.col("p_size") + F.when(key % 7 == 0, 1).otherwise(0)).cast("long").alias("length"), F.md5(F.concat("p_name", F.when(key % 11 == 0, "x").otherwise(""))).alias("digest"))
    return source, there


def _shown(changed: DataFrame) -> DataFrame:
    """Lengths as text: a missing one is null, which some readers turn into a floating-point column."""
    return changed.withColumns({c: F.col(c).cast("string") for c in ("source_length", "destination_length")})


def sync_changed_files(spark, sf_dir):
    return _shown(drift.changed_files(*_listings(spark, sf_dir)))


def sync_changed_content(spark, sf_dir):
    return _shown(drift.changed_files(*_listings(spark, sf_dir), by_content=True))


def sync_status(spark, sf_dir):
    """The state of each cached repository, with the list of its changed files in order."""
    changed = drift.changed_files(*_listings(spark, sf_dir)).select(F.substring_index("rel_path", "/", 1).alias("repo"), "rel_path")
    repos = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo")).distinct().unionByName(spark.sql("SELECT 'idle' AS repo")).withColumn("cached", ~F.col("repo").endswith("1"))
    files = changed.groupBy("repo").agg(F.expr("listagg(rel_path, ',') WITHIN GROUP (ORDER BY rel_path)").alias("rel_path"))
    return drift.sync_status(repos, files).select("repo", "status", F.coalesce("changed_file", F.lit("")).alias("changed_files"))


def sync_line_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.select(F.col("p_brand").alias("path"), F.col("p_type").alias("line"))
    changed = F.when(F.col("p_size") % 9 == 0, F.concat("p_type", F.lit("!"))).when(F.col("p_size") % 4 == 0, F.lower("p_type")).otherwise(F.col("p_type"))
    new = p.select(F.col("p_brand").alias("path"), changed.alias("line"))
    return drift.line_set_diff(old, new)


def sync_grouped_diff(spark, sf_dir):
    docs = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return drift.grouped_diff(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("old_text"), F.regexp_replace("text", r"\n(\S)", "\n\n$1").alias("new_text")))


def sync_diff_edits(spark, sf_dir):
    """Lines deleted and inserted by the grouped diff of every document and a version of it that drops, doubles and moves lines; a shortest script has as many as no other has fewer."""
    docs = tables.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x, i: i % 5 != 3)
    doubled = F.flatten(F.transform(kept, lambda x, i: F.when(i % 7 == 2, F.array(x, x)).otherwise(F.array(x))))
    moved = F.array_join(F.concat(F.array(F.element_at(lines, -1)), doubled), "\n")
    hunks = drift.grouped_diff(docs.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("old_text"), moved.alias("new_text")))
    return hunks.groupBy("path").agg(F.count_if(F.col("tag") == "delete").alias("deleted"), F.count_if(F.col("tag") == "insert").alias("inserted")).filter("deleted + inserted > 0")


def commit_checks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("feat", "fix(ui)", "feat(api)!", "docs:", "no type", "chore", "# only a comment")]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    raw = F.concat(F.lit("# head\n"), kind, F.when(F.col("o_orderkey") % 3 == 0, ":").otherwise(": "), F.lower("o_orderpriority"), F.lit("\n# tail\n"))
    return hooks.commit_checks(orders.select("o_orderkey", raw.alias("message"))).select("o_orderkey", "clean", "type", "scope", "verdict", "advice")


def hook_files(spark, sf_dir):
    return hooks.files_for_command(_paths(spark, sf_dir), ["*.rs", "tests/*", "**/A*.{PNG,jpg}"], all_files=True).select("path", "length")


def repository_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    url = F.concat(F.lit("https://host.example/team/"), F.lower(F.regexp_replace("c_name", "#", "-")), F.when(key % 3 == 0, ".git").when(key % 3 == 1, "//").otherwise(".git.git/"))
    version = F.when(key % 4 == 0, F.concat(F.lit("v"), key.cast("string"))).when(key % 4 == 1, F.substring(F.md5(key.cast("string")), F.lit(1), (key % 45).cast("int"))).when(key % 4 == 2, F.concat(key.cast("string"), F.lit(".0"))).otherwise(F.lit("main"))
    return c.select("c_custkey", text.repo_name(url).alias("repo"), version.alias("version"), text.immutable_version(version).alias("immutable"))


def scan_times(spark, sf_dir):
    ms = (F.col("l_orderkey") * 37 + F.col("l_linenumber")).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.scan_time(ms).alias("shown"))


def worker_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, most = F.col("p_partkey") % 150, (F.col("p_size") % 16 + 1)
    return p.select("p_partkey", text.workers(most, F.col("p_size"), F.col("p_size") % 4).alias("workers"), text.adapted_workers(size, most).alias("adapted"), text.adapted_workers(size, most, 0).alias("scanner"), text.hook_workers(size, most).alias("hook"))


def directory_analysis(spark, sf_dir):
    """Known directories of every supplier's repository, against the lines of its ignore file: with or without a slash, commented out, or for something below."""
    known = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("name")) for i, (d, _) in enumerate(file_source.ANALYZED_DIRECTORIES)])
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.inline(known))
    repo = F.col("s_suppkey").cast("string").alias("repo")
    present = rows.filter((F.col("s_suppkey") + F.col("i")) % 3 != 0).select(repo, "name")
    turn = F.col("s_suppkey") * (F.col("i") + 1) % 5
    line = F.when(turn == 0, F.concat("name", F.lit("/"))).when(turn == 1, F.concat(F.lit("# "), "name")).when(turn == 2, F.concat(F.lit(" "), "name", F.lit(" "))).when(turn == 3, F.concat("name", F.lit("/x"))).otherwise("")
    return file_source.directory_analysis(spark, present, rows.select(repo, line.alias("line")), by=["repo"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lines_explode, line_stats_by_lang, findings_raw, findings, findings_strict_groups, findings_per_pattern, findings_per_file, findings_by_type, files_with_findings, count_only, first_findings, first_per_file,
        entropy_probability, common_bigrams, likely_secret, line_predicates, path_predicates, fast_count, test_block_ranges, findings_outside_tests, directory_findings, directory_files, directory_shapes, directory_shares, streamed_findings, stream_findings, folder_source, sync_copy, staged_files, directory_walk_errors, explicit_paths, scan_stats, scan_counters, live_counters, warning_classes, json_results, csv_results, html_results, html_page_lines, report_lines, custom_patterns,
        text_results, scan_pages, scan_conversations, scan_event_props, patterns, sync_changed_files, sync_changed_content, sync_status, sync_line_diff, sync_grouped_diff, sync_diff_edits, commit_checks, hook_files, repository_names,
        scan_times, worker_counts, directory_analysis,
    )
}
