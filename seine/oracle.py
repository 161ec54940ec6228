"""DuckDB SQL for the rows of the queries. Only the expressions, word lists and sample files are shared with the DataFrame code."""

from __future__ import annotations

from .functions.entropy import default_bigrams
from .functions.patterns import BUILT_IN
from .operators.predicates import BINARY_EXTENSIONS, FILTERED_DIRECTORIES, IGNORED_PATHS
from .queries import _BESIDE, _PATHS
from .samples import BLOCKS, IGNORED, TOKENS, files_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def many(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def re2(regex: str) -> str:
    """A library expression with Unicode digits, words and spaces for an engine whose classes are ASCII."""
    out, inside, i = "", False, 0
    classes = {"d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{N}\p{Pc}", "s": r"\s\x{85}\p{Z}\x{0B}"}
    while i < len(regex):
        two = regex[i : i + 2]
        if inside and two == r"\s" and regex[i : i + 4] == r"\s\S":
            out, i = out + r"\s\S", i + 4
        elif two[:1] == "\\" and two[1:] in classes:
            out, i = out + (classes[two[1]] if inside else f"[{classes[two[1]]}]"), i + 2
        elif two == r"\S":
            out, i = out + f"[^{classes['s']}]", i + 2
        elif two[:1] == "\\":
            out, i = out + two, i + 2
        else:
            inside = True if regex[i] == "[" else False if regex[i] == "]" else inside
            out, i = out + regex[i], i + 1
    return out


SPACE = r"[\s\x{85}\p{Z}\x{0B}]"
DOCUMENTS = "SELECT source || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents"


def files(*groups, docs: bool = False) -> str:
    own = f"SELECT path, text FROM ({files_sql(*groups)})"
    return f"({own} UNION ALL {DOCUMENTS})" if docs else f"({own})"


def lines(source: str) -> str:
    """(path, line_number, line, previous)."""
    return f"""(SELECT path, i AS line_number, ls[i] AS line, CASE WHEN i > 1 THEN ls[i - 1] END AS previous FROM (
  SELECT path, ls, unnest(range(1, len(ls) + 1))::INT AS i FROM (
    SELECT path, list_transform(CASE WHEN parts[-1] = '' THEN parts[1:-2] ELSE parts END, lambda s: CASE WHEN ends_with(s, chr(13)) THEN s[:-2] ELSE s END) AS ls
    FROM (SELECT path, string_split(text, chr(10)) AS parts FROM {source}))))"""


def matches(source: str) -> str:
    """(path, line_number, pattern_id, start_pos, secret_type, matched_text, end_pos, secret, line, pattern_description) of lines."""
    marked = " UNION ALL ".join(
        f"SELECT *, {i} AS pattern_id, {q(p.name)} AS secret_type, {q(p.description)} AS pattern_description, "
        f"{'regexp_extract(line, ' + q(re2(p.regex)) + ', 1)' if p.groups else q('')} AS g, "
        f"string_split(regexp_replace(regexp_replace(line, {q('(' + re2(p.regex) + ')')}, chr(64976) || '\\1' || chr(64977), 'g'), '[' || chr(64976) || chr(64977) || ']', chr(64976), 'g'), chr(64976)) AS ps "
        f"FROM src WHERE regexp_matches(line, {q(re2(p.regex))})"
        for i, p in enumerate(BUILT_IN, 1)
    )
    return f"""(WITH src AS MATERIALIZED (SELECT * FROM {source}), marked AS ({marked}),
  spots AS (SELECT *, unnest(range(2, len(ps), 2)) AS k FROM marked)
  SELECT path, line_number, line, previous, pattern_id, secret_type, pattern_description, ps[k] AS matched_text,
         coalesce(list_sum(list_transform(ps[1:k - 1], lambda s: strlen(s))), 0)::INT AS start_pos,
         (coalesce(list_sum(list_transform(ps[1:k - 1], lambda s: strlen(s))), 0) + strlen(ps[k]))::INT AS end_pos,
         CASE WHEN g = '' THEN ps[k] ELSE g END AS secret
  FROM spots WHERE ps[k] <> '')"""


#: The first group of each match in m by its own pattern; a branch with a literal expression for each.
_OWN_GROUP = " UNION ALL ".join(f"SELECT *, regexp_extract(matched_text, {q(re2(p.regex))}, 1) AS own FROM m WHERE pattern_id = {i}" for i, p in enumerate(BUILT_IN, 1) if p.groups)

_TEST_LINE = f"""(SELECT bool_or(x) FROM (SELECT unnest([
  starts_with(b, '#[') AND ends_with(b, 'test]'), b = '#[bench]', b = '#[cfg(test)]', starts_with(b, 'def test_'), starts_with(b, 'class Test'), starts_with(b, '@pytest.'),
  starts_with(b, 'it('), starts_with(b, 'test('), starts_with(b, 'describe('), contains(b, 'mod tests {{'), contains(b, 'mod test {{'), contains(b, 'class Test'), contains(b, 'describe('), contains(b, '__tests__')]) AS x
  FROM (SELECT regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g') AS b)))"""
_KEPT = f"NOT contains(line, 'scan:ignore') AND NOT contains(line, '# TEST_SECRET:') AND NOT contains(line, 'DEMO_KEY_') AND NOT contains(line, 'FAKE_') AND NOT coalesce(contains(previous, 'scan:ignore-next'), false) AND NOT {_TEST_LINE}"

#: The same for lines that come without their files.
_KEPT_ALONE = _KEPT.replace("NOT coalesce(contains(previous, 'scan:ignore-next'), false) AND ", "")


def randomness(source: str, column: str) -> str:
    """source plus base, distinct_bytes, bigrams, p_distinct, p_class, p_bigram and p of a column."""
    tail = lambda x, p: f"(SELECT CASE WHEN {x} < n * {p} THEN sum(m) FILTER (k <= {x}) ELSE sum(m) FILTER (k >= {x}) END FROM (SELECT k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({p}) + (n - k) * ln(1 - {p})) AS m FROM (SELECT unnest(range(n + 1)) AS k)))"
    bigrams = default_bigrams()
    return f"""(WITH RECURSIVE tok AS MATERIALIZED (
    SELECT DISTINCT {column} AS t, strlen({column})::INT AS n FROM {source}),
  feat AS MATERIALIZED (
    SELECT t, n, CASE WHEN regexp_full_match(t, '[0-9a-fA-F]{{16,}}') THEN 16 WHEN regexp_full_match(t, '[0-9A-Z]{{16,}}') THEN 36 ELSE 64 END AS base,
           len(list_distinct(regexp_extract_all(hex(encode(t)), '..'))) AS distinct_bytes,
           len(list_filter(range(1, length(t)), lambda i: list_contains({many(bigrams)}, substr(t, i, 2)))) AS bigrams,
           len(regexp_extract_all(t, '[0-9]')) AS dg, len(regexp_extract_all(t, '[A-Z]')) AS up, len(regexp_extract_all(t, '[a-z]')) AS lo FROM tok),
  occ(ob, step, oq) AS (
    SELECT b, 0, list_concat([1.0::DOUBLE], list_transform(range(170), lambda i: 0.0::DOUBLE)) FROM (SELECT unnest([16, 36, 64]) AS b)
    UNION ALL
    SELECT ob, step + 1, list_transform(range(171), lambda k: CASE WHEN k = 0 THEN 0.0 ELSE oq[k + 1] * k / ob + oq[k] * greatest(ob - k + 1, 0) / ob END) FROM occ WHERE step < 170),
  probs AS (
    SELECT feat.*, list_sum(oq[1:distinct_bytes + 1]) AS p_distinct,
           CASE WHEN feat.n > 170 THEN NULL WHEN feat.base = 16 THEN {tail('dg', '0.625')} WHEN feat.base = 36 THEN least({tail('dg', '(10/36)')}, {tail('up', '(26/36)')})
                ELSE least({tail('dg', '(10/64)')}, {tail('up', '(26/64)')}, {tail('lo', '(26/64)')}) END AS p_class,
           CASE WHEN feat.n <= 170 THEN {tail('bigrams', f'({len(bigrams)}/4096)')} END AS p_bigram
    FROM (SELECT * FROM feat) AS feat LEFT JOIN occ ON ob = feat.base AND step = feat.n)
  SELECT s.*, base, distinct_bytes, bigrams, p_distinct, p_class, p_bigram, p_distinct * p_class * CASE WHEN base = 64 THEN p_bigram ELSE 1 END AS p
  FROM {source} AS s JOIN probs ON s.{column} = probs.t)"""


def likely(column: str, threshold: str) -> str:
    return f"(strlen({column}) > 170 OR coalesce(p >= {threshold} AND (regexp_matches({column}, '[0-9]') OR p >= 10 * {threshold}), false))"


def blocks(source: str) -> str:
    """(path, start_line, end_line): zero-based half-open ranges of test blocks.

    Each start's end comes from running sums of braces or from indents; the walk then goes from block to block.
    """
    bare = f"regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g')"
    return f"""(WITH RECURSIVE l AS MATERIALIZED (
    SELECT path, line_number - 1 AS i, {_TEST_LINE} AS starts, {bare} = '' AS empty, strlen(line) - strlen(regexp_replace(line, '^{SPACE}+', '')) AS depth,
           length(line) - length(replace(line, '{{', '')) AS ups, length(line) - length(replace(line, '}}', '')) AS downs FROM {lines(source)}),
  c AS MATERIALIZED (
    SELECT *, sum(ups - downs) OVER w AS level, sum(ups) OVER w AS all_ups, max(i) OVER (PARTITION BY path) + 1 AS n FROM l WINDOW w AS (PARTITION BY path ORDER BY i)),
  e AS MATERIALIZED (
    SELECT path, i, stop FROM (
      SELECT s.path, s.i, CASE WHEN ends_with(s.path, '.py') THEN coalesce(min(x.i) FILTER (x.i > s.i AND NOT x.empty AND x.depth <= s.depth), any_value(s.n))
                               ELSE min(x.i) FILTER (x.i >= s.i AND x.all_ups > s.all_ups - s.ups AND x.level = s.level - s.ups + s.downs) + 1 END AS stop
      FROM c s JOIN c x USING (path) WHERE s.starts GROUP BY s.path, s.i) WHERE stop IS NOT NULL),
  walk(path, i) AS (
    SELECT path, min(i) FROM e GROUP BY path
    UNION ALL
    SELECT a.path, min(b.i) FROM walk JOIN e a ON a.path = walk.path AND a.i = walk.i JOIN e b ON b.path = a.path AND b.i >= greatest(a.stop, a.i + 1) GROUP BY a.path)
  SELECT path, i::INT AS start_line, stop::INT AS end_line FROM walk JOIN e USING (path, i))"""


def _scanned(source: str, outside: str = "true") -> str:
    return _scanned_lines(source, f"{_KEPT} AND {outside}")


def _scanned_lines(source: str, kept: str) -> str:
    raw = matches(f"(SELECT * FROM {lines(source)} AS src WHERE {kept})")
    return f"(SELECT * FROM {randomness(raw, 'secret')} WHERE {likely('secret', '1e-5')})"


#: The word key between what is no word character; such characters beside it are taken in, and no two keys share one here.
_EDGED = r"(^|[^\p{L}\p{M}\p{N}\p{Pc}])(key)($|[^\p{L}\p{M}\p{N}\p{Pc}])"
CORPUS = files(TOKENS, IGNORED, docs=True)
SCANNED = _scanned(CORPUS)
_BLOCKS = blocks(files(BLOCKS, IGNORED, docs=True))
_WRITTEN = f"(SELECT path, text FROM ({files_sql(TOKENS, IGNORED)}) UNION ALL " + " UNION ALL ".join(f"SELECT {p}, {t} FROM (SELECT chr(10) AS n)" for p, t in _BESIDE) + ")"
_SEEN = f"(SELECT * FROM {_WRITTEN} AS w(path, text) WHERE (NOT starts_with(path, 'src/jwt') OR path = 'src/jwt1.txt') AND NOT starts_with(path, 'src/github') AND NOT starts_with(path, 'logs/') AND NOT starts_with(path, 'node_modules/') AND NOT ends_with(path, '.tmp'))"
_STREAMED = f"(SELECT path, repeat(text || chr(13) || chr(10), 30) AS text FROM ({files_sql(TOKENS, IGNORED, BLOCKS)}))"
PNG = q("a.png")
_LISTED = f"(SELECT path, text FROM ({files_sql(TOKENS)}) UNION ALL SELECT path, text FROM {_WRITTEN} AS w(path, text) WHERE path IN ('a.png', 'logs/a.txt', '.hidden'))"
_OUTSIDE = _scanned(files(BLOCKS, docs=True), f"NOT EXISTS (SELECT 1 FROM {blocks(files(BLOCKS, docs=True))} b WHERE b.path = src.path AND b.start_line < src.line_number AND src.line_number <= b.end_line)")
_OUTSIDE_ALL = _scanned(files(BLOCKS, IGNORED, docs=True), f"NOT EXISTS (SELECT 1 FROM {_BLOCKS} b WHERE b.path = src.path AND b.start_line < src.line_number AND src.line_number <= b.end_line)")
NAMES = "(SELECT unnest([" + ", ".join(f"{{'i': {i}, 'name': {q(p.name)}}}" for i, p in enumerate(BUILT_IN, 1)) + "], recursive := true))"
PER_PATTERN = "SELECT i::INT AS pattern_id, name, count(pattern_id) AS matches FROM {names} LEFT JOIN {found} f ON f.pattern_id = i GROUP BY ALL"
TRIM = f"regexp_replace(line, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _column(path: str, column: str, name: str) -> str:
    source = f"(SELECT path, text FROM ({files_sql(TOKENS)}) UNION ALL SELECT ({path})::VARCHAR, coalesce({column}, '') FROM {name})"
    return PER_PATTERN.format(names=NAMES, found=matches(lines(source)))


_TOKENS = f"""(SELECT DISTINCT token FROM (SELECT unnest(string_split(p_name, ' ')) AS token FROM part UNION ALL SELECT c_name FROM customer
  UNION ALL SELECT secret FROM {matches(lines(files(TOKENS)))}) WHERE token <> '')"""
_log = lambda p: f"CASE WHEN {p} > 0 THEN round(log10({p}), 6) + 0.0 WHEN {p} = 0 THEN -999.0 END"

_PATH_ROWS = "(WITH p AS (SELECT p_partkey::VARCHAR AS k, p_partkey FROM part) " + " UNION ALL ".join(f"SELECT {p} AS path, p_partkey::BIGINT * 104857 AS length FROM p" for p in _PATHS) + ")"
_GLOBBED = " OR ".join(f"regexp_full_match(path, {q('(?s)' + g.replace('.', chr(92) + '.').replace('*', '.*'))})" for g in IGNORED_PATHS)
_EXT = r"CASE WHEN regexp_matches(path, '(?s)[^/]\.[^./]*\z') THEN lower(regexp_extract(path, '(?s)[^/]\.([^./]*)\z', 1)) END"
_FLAGGED = f"(SELECT path, text, true AS success, false AS is_binary FROM ({DOCUMENTS}) UNION ALL SELECT path, text, false, false FROM ({files_sql(IGNORED)}) UNION ALL SELECT path, text, true, true FROM ({files_sql(BLOCKS)}))"
_FLAGGED_FOUND = _scanned(f"(SELECT path, coalesce(text, '') AS text FROM {_FLAGGED} WHERE success AND NOT is_binary)")
_SOURCE = "(SELECT p_brand || '/' || p_partkey AS rel_path, p_size::BIGINT AS length, p_name AS body, p_partkey FROM part)"
_THERE = "(SELECT p_brand || '/' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.old' ELSE '' END AS rel_path, (p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS length, p_name || CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE '' END AS body FROM part)"
_CHANGED = f"SELECT s.rel_path, s.length::VARCHAR AS source_length, d.length::VARCHAR AS destination_length FROM {_SOURCE} s LEFT JOIN {_THERE} d USING (rel_path) WHERE (d.rel_path IS NULL OR s.length <> d.length"
_ADAPT = lambda n, m: f"CASE WHEN {n} <= 10 THEN least(2, {m}) WHEN {n} <= 50 THEN {m} // 2 WHEN {n} <= 100 THEN {m} * 3 // 4 ELSE {m} END"
_NAMED = "lower(replace(c_name, '#', '-'))"

ORACLE: dict[str, str] = {
    "lines_explode": f"SELECT path, line_number, line FROM {lines('(' + DOCUMENTS + ')')}",
    "line_stats_by_lang": f"SELECT lang, count(*) AS lines, max(length(line))::INT AS longest, sum(strlen(line))::BIGINT AS bytes, count(*) FILTER (line = '') AS empty FROM {lines('(SELECT lang AS path, coalesce(text, chr(39) || chr(39)) AS text FROM documents)')} AS x(lang, n, line, p) GROUP BY lang",
    "findings_raw": f"SELECT path, line_number, pattern_id, start_pos, secret_type, matched_text, end_pos, secret FROM {matches(lines(files(TOKENS, docs=True)))}",
    "findings": f"SELECT path, line_number, pattern_id, start_pos, secret_type, matched_text, end_pos FROM {SCANNED}",
    "findings_strict_groups": f"WITH m AS MATERIALIZED (SELECT path, line_number, pattern_id, start_pos, matched_text FROM {matches(lines(files(TOKENS, docs=True)))}), o AS MATERIALIZED ({_OWN_GROUP}) SELECT path, line_number, pattern_id, start_pos, matched_text, coalesce(nullif(own, ''), matched_text) AS secret FROM o UNION ALL SELECT *, matched_text FROM m WHERE pattern_id NOT IN (SELECT pattern_id FROM o)",
    "findings_per_pattern": PER_PATTERN.format(names=NAMES, found=SCANNED),
    "findings_per_file": f"SELECT path, count(*) AS matches, min(line_number) AS first_line, count(DISTINCT secret_type) AS types FROM {SCANNED} GROUP BY path",
    "findings_by_type": f"SELECT secret_type, count(*) AS matches FROM {SCANNED} GROUP BY secret_type",
    "files_with_findings": f"SELECT DISTINCT path FROM {SCANNED}",
    "count_only": f"SELECT count(*) AS matches FROM {SCANNED}",
    "first_findings": f"SELECT path, line_number, pattern_id, start_pos, matched_text FROM {SCANNED} ORDER BY path, line_number, pattern_id, start_pos LIMIT 5",
    "first_per_file": f"SELECT path, line_number, pattern_id, start_pos, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_number, pattern_id, start_pos) AS place FROM {SCANNED}) WHERE place <= 2",
    "entropy_probability": f"SELECT token, base, distinct_bytes::INT AS distinct_bytes, bigrams::INT AS bigrams, {_log('p_distinct')} AS log_distinct, {_log('p_class')} AS log_class, {_log('p_bigram')} AS log_bigram, {_log('p')} AS log_p FROM {randomness(_TOKENS, 'token')}",
    "common_bigrams": f"SELECT pair, times::BIGINT AS times, (row_number() OVER (ORDER BY times DESC, pair))::INT AS place FROM (SELECT pair, count(*) AS times FROM (SELECT unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) AS pair FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_./=-]{{2,}}')) AS word FROM {CORPUS})) GROUP BY pair) QUALIFY place <= 488",
    "likely_secret": f"SELECT token, {likely('token', '1e-5')} AS likely, {likely('token', '1e-3')} AS likely_strict FROM {randomness(_TOKENS, 'token')}",
    "line_predicates": f"SELECT path, line_number, contains(line, 'scan:ignore') AS comment, contains(line, '# TEST_SECRET:') OR contains(line, 'DEMO_KEY_') OR contains(line, 'FAKE_') AS substring, {_TEST_LINE} AS test_line, coalesce(contains(previous, 'scan:ignore-next'), false) AS next, (strlen(line) - strlen(regexp_replace(line, '^{SPACE}+', '')))::INT AS indent FROM {lines(files(TOKENS, IGNORED, BLOCKS, docs=True))}",
    "path_predicates": f"SELECT path, length, {_GLOBBED} AS ignored, len(list_intersect(string_split(path, '/'), {many(FILTERED_DIRECTORIES)})) > 0 AS filtered, coalesce(list_contains({many(BINARY_EXTENSIONS)}, {_EXT}), false) AS is_binary, {_EXT} AS extension, length // 1048576 > 10 AS large, length // 1048576 > 5 AS streamed, CASE WHEN strlen(path) > 40 THEN '...' || right(path, 37) ELSE path END AS shown FROM {_PATH_ROWS}",
    "fast_count": f"SELECT count(*) AS files FROM {_PATH_ROWS} WHERE len(list_intersect(string_split(path, '/')[:-2], {many(FILTERED_DIRECTORIES)})) = 0 AND length // 1048576 <= 10",
    "test_block_ranges": f"SELECT path, start_line, end_line FROM {_BLOCKS}",
    "findings_outside_tests": f"SELECT path, line_number, pattern_id, start_pos, matched_text FROM {_OUTSIDE}",
    "directory_findings": f"SELECT path, line_number, pattern_id, start_pos, matched_text FROM {_scanned(f'(SELECT * FROM {_SEEN} WHERE path <> {PNG})')}",
    "directory_files": f"SELECT path AS rel_path, CASE WHEN path <> 'a.png' THEN strlen(text)::VARCHAR END AS bytes, path = 'a.png' AS is_binary, false AS is_large, true AS success FROM {_SEEN} UNION ALL SELECT 'bad.txt', NULL, false, false, false UNION ALL SELECT 'bin.dat2', NULL, true, false, true",
    "directory_shapes": f"SELECT shape, replace(path, '/', '-') AS name, count(*) AS matches FROM {_scanned(files(TOKENS))}, (SELECT unnest(['flat', 'branch']) AS shape) GROUP BY ALL",
    "directory_shares": f"""WITH f AS (SELECT replace(path, '/', '-') AS rel_path, strlen(text)::BIGINT AS length FROM {files(TOKENS)}),
      s AS (SELECT rel_path, length, sum(length + 100) OVER (ORDER BY rel_path) - length - 100 AS before, sum(length + 100) OVER () AS total FROM f)
      SELECT rel_path, length, (before // greatest(least(67108864, -(-total // 7)), 1))::INT AS task FROM (SELECT rel_path, length, before::BIGINT AS before, ceil(total / 7)::BIGINT * 7 AS total FROM s)""",
    "streamed_findings": f"SELECT path, line_number, pattern_id, start_pos, matched_text FROM {_scanned_lines(_STREAMED, _KEPT_ALONE)}",
    "stream_findings": f"SELECT path, line_number, pattern_id, start_pos, matched_text FROM {_OUTSIDE_ALL}",
    "folder_source": f"SELECT replace(path, '/', '-') AS rel_path, strlen(text)::BIGINT AS length, md5(text) AS digest FROM {files(TOKENS)} WHERE starts_with(path, 'src/g') AND strlen(text) <= 90",
    "sync_copy": f"SELECT path AS rel_path, md5(text) AS digest, substr(md5(path), 1, 1) >= '8' OR substr(md5(path), 2, 1) < '8' AS copied FROM {files(TOKENS)}",
    "staged_files": "SELECT s_suppkey::VARCHAR AS repo, 'd' || (i % 2) || '/f' || i || '.txt' AS rel_path, CASE (s_suppkey + i) % 5 WHEN 0 THEN 'D' ELSE 'M' END AS change FROM supplier, (SELECT unnest(range(5)) AS i) WHERE (s_suppkey + i) % 5 < 2 UNION ALL SELECT s_suppkey::VARCHAR, 'new/' || s_suppkey || '.txt', 'A' FROM supplier",
    "scan_counters": f"SELECT count(*) FILTER (success AND NOT is_binary) AS scanned, (SELECT count(DISTINCT path) FROM {_FLAGGED_FOUND}) AS with_secrets, count(*) FILTER (NOT success) AS skipped, count(*) FILTER (is_binary) AS binary, (SELECT count(*) FROM {_FLAGGED_FOUND}) AS total_matches FROM {_FLAGGED}",
    "directory_walk_errors": "SELECT 'Directory Walk Errors' AS warning_type, 1::BIGINT AS warnings UNION ALL SELECT 'Scan Failures', count(*) FROM supplier",
    "explicit_paths": f"SELECT path, line_number, pattern_id, start_pos, matched_text FROM {_scanned(_LISTED)}",
    "scan_stats": f"SELECT count(*) FILTER (success) AS files_scanned, count(*) FILTER (NOT success) AS files_skipped, (SELECT count(*) FROM {_FLAGGED_FOUND}) AS total_matches FROM {_FLAGGED}",
    "live_counters": f"SELECT count(*) FILTER (success AND NOT is_binary) AS scanned, count(*) FILTER (success AND NOT is_binary AND path IN (SELECT path FROM {_FLAGGED_FOUND})) AS with_secrets, count(*) FILTER (NOT success) AS skipped, count(*) FILTER (is_binary) AS binary FROM {_FLAGGED}",
    "warning_classes": "SELECT CASE lang WHEN 'en' THEN 'Scan Failures' WHEN 'de' THEN 'Directory Walk Errors' ELSE 'Other Warnings' END AS warning_type, count(*) AS warnings FROM documents GROUP BY 1",
    "json_results": f"SELECT path, line_number, pattern_id, start_pos, to_json(struct_pack(file := path, line := line_number, type := secret_type, content := {TRIM}, matched_text := matched_text, start_pos := start_pos, end_pos := end_pos))::VARCHAR AS json FROM {SCANNED}",
    "csv_results": f"SELECT path, line_number, pattern_id, start_pos, path || ',' || line_number || ',' || secret_type || ',\"' || replace({TRIM}, '\"', '\"\"') || '\"' AS csv FROM {SCANNED}",
    "html_results": f"SELECT secret_type, 'secrets-' || lower(replace(secret_type, ' ', '-')) AS section, path, line_number, pattern_id, start_pos, '<tr><td>' || path || '</td><td>' || line_number || '</td><td><code>' || replace(replace(replace({TRIM}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</code></td></tr>' AS html FROM {SCANNED}",
    "html_page_lines": f"""WITH f AS MATERIALIZED (SELECT * FROM {SCANNED}), n AS (SELECT secret_type AS t, count(*) AS c FROM f GROUP BY 1)
      SELECT '<!DOCTYPE html><html><head><meta charset=''utf-8''><title>Scan report</title></head><body><h1>Scan report</h1>' AS html
      UNION ALL SELECT '<h2 id=' || chr(39) || 'secrets-' || lower(replace(t, ' ', '-')) || chr(39) || '>' || t || ' (' || c || ' matches)</h2><table><tr><th>File</th><th>Line</th><th>Context</th></tr>' FROM n
      UNION ALL SELECT '<tr><td>' || path || '</td><td>' || line_number || '</td><td><code>' || replace(replace(replace({TRIM}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</code></td></tr>' FROM f
      UNION ALL SELECT '</table>' FROM n UNION ALL SELECT '</body></html>'""",
    "custom_patterns": rf"""WITH l AS MATERIALIZED (SELECT line FROM {lines(CORPUS)}),
      m AS (SELECT 'Custom Pattern 1' AS secret_type, unnest(regexp_extract_all(line, '\p{{Lu}}{{2}}_\p{{L}}+')) AS hit, '' AS g FROM l
        UNION ALL SELECT 'Custom Pattern 2', 'x', regexp_extract(line, '([a-z]+)-([0-9]+)\z', 1) FROM l WHERE regexp_matches(line, '([a-z]+)-([0-9]+)\z')
        UNION ALL SELECT 'Custom Pattern 4', unnest(regexp_extract_all(line, '{_EDGED}', 2)), '' FROM l)
      SELECT secret_type, count(*) AS matches, min(CASE WHEN g = '' THEN hit ELSE g END) AS least FROM m GROUP BY 1 UNION ALL SELECT 'warnings', 1, ''""",
    "text_results": f"WITH f AS MATERIALIZED (SELECT * FROM {SCANNED}) SELECT path, line_number, pattern_id, start_pos, '  line ' || line_number || ': ' || secret_type || ' ' || {TRIM} AS text FROM f UNION ALL SELECT path, 0, 0, 0, path || ' (' || count(*) || ' matches)' FROM f GROUP BY path",
    "report_lines": f"""WITH f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY path, line_number, pattern_id, start_pos) AS k FROM {_FLAGGED_FOUND}),
      w AS (SELECT 'Failed to scan ' || path || ': not readable as UTF-8' AS message, row_number() OVER (ORDER BY path) AS k FROM {_FLAGGED} WHERE NOT success)
      SELECT '{{"report_metadata":{{"generated_at":1,"tool_version":"1","scan_duration_ms":0,"total_files_scanned":' || (SELECT count(*) FROM {_FLAGGED} WHERE success) || ',"total_files_skipped":' || (SELECT count(*) FROM w)
             || '}},"summary":{{"total_secrets":' || (SELECT count(*) FROM f) || ',"total_warnings":' || (SELECT count(*) FROM w) || '}},"secrets":[' AS value
      UNION ALL SELECT CASE WHEN k = 1 THEN '' ELSE ',' END || to_json(struct_pack(file := path, line := line_number, type := secret_type, content := {TRIM}, matched_text := matched_text, start_pos := start_pos, end_pos := end_pos, pattern_description := pattern_description))::VARCHAR FROM f
      UNION ALL SELECT '],"warnings":[' UNION ALL SELECT CASE WHEN k = 1 THEN '' ELSE ',' END || to_json(struct_pack(message := message))::VARCHAR FROM w UNION ALL SELECT ']}}'""",
    "scan_pages": _column("page_id", "html", "pages"),
    "scan_conversations": _column("conv_id || '/' || turn", "text", "conversations"),
    "scan_event_props": _column("event_id", "props", "events"),
    "patterns": "WITH l AS MATERIALIZED (SELECT line FROM " + lines("(" + DOCUMENTS + ")") + "), p AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(p.name)}, {q(p.regex)}, {p.groups}, {q(p.description)}, {many(p.anchors) if p.anchors else many([''])})" for i, p in enumerate(BUILT_IN, 1)) + ") t(pattern_id, name, regex, n_groups, description, anchors)), "
    "a AS (SELECT DISTINCT unnest(anchors) AS anchor FROM p), h AS MATERIALIZED (SELECT rid, anchor FROM (SELECT line, row_number() OVER () AS rid FROM l) JOIN a ON contains(line, anchor)) "
    "SELECT pattern_id, name, regex, n_groups, description, (SELECT count(DISTINCT rid) FROM h WHERE list_contains(anchors, anchor)) AS candidate_lines FROM p",
    "sync_changed_files": _CHANGED + ")",
    "sync_changed_content": _CHANGED + " OR s.body <> d.body)",
    "sync_status": f"SELECT repo, CASE WHEN files IS NULL THEN 'InSync' ELSE 'OutOfSync' END AS status, coalesce(files, '') AS changed_files FROM (SELECT DISTINCT p_brand AS repo FROM part UNION ALL SELECT 'idle') r LEFT JOIN (SELECT split_part(rel_path, '/', 1) AS repo, string_agg(rel_path, ',' ORDER BY rel_path) AS files FROM ({_CHANGED})) GROUP BY 1) c USING (repo) WHERE NOT ends_with(repo, '1')",
    "sync_line_diff": "SELECT path, line, CASE WHEN d > 0 THEN 'insert' ELSE 'delete' END AS tag, abs(d)::BIGINT AS n FROM (SELECT path, line, sum(d) AS d FROM (SELECT p_brand AS path, p_type AS line, -1 AS d FROM part UNION ALL SELECT p_brand, CASE WHEN p_size % 9 = 0 THEN p_type || '!' WHEN p_size % 4 = 0 THEN lower(p_type) ELSE p_type END, 1 FROM part) GROUP BY ALL) WHERE d <> 0",
    "sync_diff_edits": """WITH RECURSIVE raw AS (
        SELECT doc_id::VARCHAR AS path, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
      pair AS (
        SELECT path, ls AS a, [ls[-1]] || flatten(list_transform(list_filter(ls, lambda x, i: (i - 1) % 5 <> 3), lambda x, i: CASE WHEN (i - 1) % 7 = 2 THEN [x, x] ELSE [x] END)) AS b FROM raw),
      f AS MATERIALIZED (
        SELECT path, list_transform(CASE WHEN a[-1] = '' THEN a[1:-2] ELSE a END, lambda s: rtrim(s, chr(13))) AS a, list_transform(CASE WHEN b[-1] = '' THEN b[1:-2] ELSE b END, lambda s: rtrim(s, chr(13))) AS b FROM pair),
      dp(path, i, r) AS (
        SELECT path, 0, list_transform(range(len(b) + 1), lambda x: 0) FROM f
        UNION ALL
        SELECT dp.path, i + 1, [0] || list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda t: greatest(r[t + 1], r[t] + CASE WHEN a[i + 1] = b[t] THEN 1 ELSE 0 END))))
        FROM dp JOIN f USING (path) WHERE i < len(a))
      SELECT path, (len(a) - r[-1])::BIGINT AS deleted, (len(b) - r[-1])::BIGINT AS inserted FROM dp JOIN f USING (path) WHERE i = len(a) AND len(a) + len(b) > 2 * r[-1]""",
    "commit_checks": r"""WITH m AS (SELECT o_orderkey, ['feat', 'fix(ui)', 'feat(api)!', 'docs:', 'no type', 'chore', '# only a comment'][o_orderkey % 7 + 1] || CASE WHEN o_orderkey % 3 = 0 THEN ':' ELSE ': ' END || lower(o_orderpriority) AS body FROM orders),
      c AS (SELECT o_orderkey, CASE WHEN starts_with(body, '#') THEN '' ELSE trim(body) END AS clean FROM m),
      t AS (SELECT *, regexp_extract(clean, '^([A-Za-z][A-Za-z0-9_-]*)(\(([^()]+)\))?(!)?: *([^ ].*)$', ['type', 'x', 'scope', 'b', 'd']) AS g FROM c)
      SELECT o_orderkey, clean, nullif(lower(g.type), '') AS type, CASE WHEN g.type <> '' THEN nullif(g.scope, '') END AS scope, CASE WHEN clean = '' THEN 'empty' WHEN g.type = '' THEN 'invalid' ELSE 'valid' END AS verdict,
             CASE WHEN lower(g.type) = 'feat' AND g.scope = '' THEN 'Consider adding a scope to feat commits' END AS advice FROM t""",
    "hook_files": f"SELECT path, length FROM {_PATH_ROWS} WHERE ends_with(path, '.rs') OR starts_with(path, 'tests/') OR regexp_full_match(path, '(?s)(.*/)?A.*\\.(PNG|jpg)')",
    "repository_names": f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN {_NAMED} WHEN 1 THEN {_NAMED} ELSE {_NAMED} END AS repo, version,
      regexp_matches(version, '^v[0-9]') OR regexp_full_match(version, '[0-9a-fA-F]{{7,40}}') OR (regexp_matches(version, '^[0-9]') AND contains(version, '.')) AS immutable
      FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'v' || c_custkey WHEN 1 THEN substr(md5(c_custkey::VARCHAR), 1, c_custkey % 45) WHEN 2 THEN c_custkey || '.0' ELSE 'main' END AS version FROM customer)""",
    "scan_times": "SELECT l_orderkey, l_linenumber, CASE WHEN ms < 10000 THEN ms || 'ms' ELSE CASE WHEN ms >= 60000 THEN ms // 60000 || 'm ' ELSE '' END || (ms // 1000) % 60 || '.' || lpad((ms % 1000)::VARCHAR, 3, '0') || 's' END AS shown FROM (SELECT *, l_orderkey * 37 + l_linenumber AS ms FROM lineitem)",
    "worker_counts": f"SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN least(greatest(1, m * p_size // 100), p_size % 4) ELSE greatest(1, m * p_size // 100) END::INT AS workers, greatest(1, {_ADAPT('n', 'm')})::INT AS adapted, greatest(0, {_ADAPT('n', 'm')})::INT AS scanner, least(greatest(1, {_ADAPT('n', 'm')}), n, 8)::INT AS hook FROM (SELECT *, p_partkey % 150 AS n, p_size % 16 + 1 AS m FROM part)",
    "directory_analysis": """WITH k AS (SELECT unnest(['target', 'node_modules', 'dist', 'build', '__pycache__', 'venv', '.venv', 'vendor']) AS name, unnest(range(8)) AS i,
        unnest(['Rust build directory', 'Node.js dependencies', 'Build output directory', 'Build output directory', 'Python cache directory', 'Python virtual environment', 'Python virtual environment', 'Go dependencies']) AS description)
      SELECT s_suppkey::VARCHAR AS repo, name || '/' AS dir, description, CASE WHEN (s_suppkey * (i + 1)) % 5 IN (0, 2) THEN 'properly_ignored' ELSE 'needs_gitignore' END AS status FROM supplier, k WHERE (s_suppkey + i) % 3 <> 0""",
}
