"""DuckDB SQL for the rows of the queries, where SQL can express them. Written apart from the DataFrame code."""

from __future__ import annotations

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(w)::BIGINT AS size, clean, sqrt(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END) AS varied
  FROM (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               length(translate(coalesce(text, ''), '#*$%&|<>', '')) / greatest(length(coalesce(text, '')), 1) AS clean FROM documents)),
k AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
            / greatest(clean * clean * varied, 0.01) AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
fill(step, source, source_size, w, target, is_full) AS (
  SELECT 0, source, source_size, w, 0::DOUBLE, false FROM s
  UNION ALL
  SELECT step + 1, source, source_size, w,
         CASE WHEN is_full OR level * w >= 2.0 * source_size THEN 2.0 * source_size ELSE level * w END,
         is_full OR level * w >= 2.0 * source_size
  FROM (SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) FILTER (is_full) OVER (), 0))
                  / sum(w) FILTER (NOT is_full) OVER () AS level FROM fill)
  WHERE step <= (SELECT count(*) FROM s)),
t AS (SELECT source, source_size, target FROM fill WHERE step = (SELECT max(step) FROM fill)),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM p
"""

_RACE = "-ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)"
OP6 = rf"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
race AS (
  SELECT DISTINCT doc_id, s::INT AS s, {_RACE} AS t FROM documents, (SELECT unnest(range(25)) AS s)),
won AS (
  SELECT doc_id, arg_min(s, t) FILTER (s < 24) AS shard, arg_min(s, t) AS grown FROM race GROUP BY doc_id),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (
  SELECT doc_id, size, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, size - 8), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
         lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT AS text_crc32
  FROM d, crc_table)
SELECT c.doc_id, c.size::BIGINT AS size, c.text_crc32, 'key' AS law, won.shard,
       (row_number() OVER (PARTITION BY won.shard ORDER BY c.doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, won.grown AS grown_shard
FROM c JOIN won ON c.doc_id IS NOT DISTINCT FROM won.doc_id
"""

OP7 = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.*, (SELECT max_by(struct_pack(rule := r.h || r.p, verdict := r.verdict), length(r.h || r.p)) FROM r
               WHERE (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)) AS hit
  FROM u)
SELECT page_id, host, path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN regexp_matches(host, '(^|[.-])(' || words || ')(s|24|365|online|club)?([.-]|\z)')
           OR regexp_matches(path, '/(' || words || ')s?(/|\z)')
           OR regexp_matches(host, '^(ad|ads|adserver|banner|banners|beacon|click|clicks|pixel|stats|track|tracker)([0-9]|[1-9][0-9])\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM m, (SELECT 'adult|bet|betting|bingo|bitcoin|blackjack|bonus|cam|camgirl|casino|cialis|cracked|crypto|dating|doubleclick|escort|forex|gamble|gambling|hentai|jackpot|keygen|loan|lottery|malware|milf|nude'
  || '|payday|phishing|pill|pills|pirate|poker|porn|pornhub|roulette|serial|sex|slot|spam|sportsbet|steroid|torrent|viagra|warez|wager|webcam|xanax|xxx' AS words)
"""

OP8 = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i:i + 9] AS ws FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(ws) AS n FROM win),
grams AS (
  SELECT rid, i, n, w[i:i + n - 1] AS ws FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, lens WHERE len(w) >= n)),
found AS (SELECT g.rid, g.i, g.n, win.item_id FROM grams g JOIN win ON g.ws = win.ws),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found) GROUP BY rid),
term AS (SELECT ws, unnest(ws) AS x, unnest(range(len(ws))) AS off FROM (SELECT DISTINCT ws FROM win)),
words AS MATERIALIZED (SELECT rid, p, x FROM (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS p FROM t) WHERE x IN (SELECT x FROM term)),
rare AS MATERIALIZED (
  SELECT ws, x, off, row_number() OVER (PARTITION BY ws ORDER BY coalesce(n, 0), off) AS k FROM term LEFT JOIN (SELECT x, count(*) AS n FROM words GROUP BY x) USING (x)),
two AS (SELECT a.ws, a.x AS x1, b.x AS x2, abs(a.off - b.off) + 5 AS reach FROM rare a JOIN rare b ON a.ws = b.ws AND a.k = 1 AND b.k = 2),
near AS (
  SELECT DISTINCT p.rid, win.item_id FROM two JOIN words p ON p.x = two.x1 JOIN words q ON q.x = two.x2 AND q.rid = p.rid AND p.p <> q.p AND abs(p.p - q.p) <= reach JOIN win ON win.ws = two.ws),
nears AS (SELECT rid, count(*) AS n_near FROM near GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM t LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid) LEFT JOIN nears USING (rid)
"""

_BIN = "(greatest(length(bin({v})) - 6, 0) * 32 + ({v} >> greatest(length(bin({v})) - 6, 0)))"
#: measure: (low %, high %, spread, the least distance by the group's upper quantile and median lengths, whether it has a lower limit)
_MEASURES = {
    "symbol_rate": (25, 75, 6, "10000 // greatest(med_words, 1)", False),
    "dup_line_rate": (50, 95, 3, "10000 // greatest(med_lines, 1)", False),
    "repeat_rate": (50, 95, 8, "60000 // greatest(med_words, 1)", False),
    "mean_chars": (10, 90, 3, "high // 32", True),
}


def _op10() -> str:
    long = " UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{m}' AS measure, {m} AS v FROM rates" for m in (*_MEASURES, "n_words", "n_lines"))
    fences = ", ".join(f"('{m}', {a}, {b}, {c}, {e})" for m, (a, b, c, _, e) in _MEASURES.items())
    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {d}" for m, (_, _, _, d, _) in _MEASURES.items()) + " END"
    return rf"""
WITH t AS (
  SELECT doc_id, lang, source, row_number() OVER () AS rid, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT rid, i, w[i:i + 2] AS ws FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (
  SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, ws) AS c FROM g) WHERE c > 1) GROUP BY rid),
base AS (
  SELECT t.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM t JOIN l USING (rid) LEFT JOIN r USING (rid)),
rates AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN n_words > 0 THEN n_symbols * 10000 // n_words ELSE 0 END AS symbol_rate,
         CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS dup_line_rate,
         CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS repeat_rate,
         CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS mean_chars FROM base),
long AS ({long}),
fence(measure, p_low, p_high, spread, two_sided) AS (VALUES {fences}, ('n_words', 50, 50, 0, false), ('n_lines', 50, 50, 0, false)),
cells AS (
  SELECT lang, source, measure, {_BIN.format(v="v")} AS cell, any_value((((v >> greatest(length(bin(v)) - 6, 0)) + 1) << greatest(length(bin(v)) - 6, 0)) - 1) AS top, count(*)::HUGEINT AS c
  FROM long WHERE NOT base_failed GROUP BY ALL),
by_lang AS (SELECT lang, measure, cell, any_value(top) AS top, sum(c)::HUGEINT AS c FROM cells GROUP BY lang, measure, cell),
by_all AS (SELECT measure, cell, any_value(top) AS top, sum(c)::HUGEINT AS c FROM cells GROUP BY measure, cell),
grp AS (
  SELECT d.lang, d.source, coalesce(n_l, 0)::HUGEINT AS n_l, (SELECT count(*) FROM rates WHERE NOT base_failed)::HUGEINT AS n_a
  FROM (SELECT DISTINCT lang, source FROM rates) d LEFT JOIN (SELECT lang, count(*) AS n_l FROM rates WHERE NOT base_failed GROUP BY lang) x ON d.lang IS NOT DISTINCT FROM x.lang),
mix AS (
  SELECT grp.lang, grp.source, measure, cell, top, c * greatest(n_l, 1) * greatest(n_a, 1) AS c FROM grp JOIN cells ON grp.lang IS NOT DISTINCT FROM cells.lang AND grp.source IS NOT DISTINCT FROM cells.source
  UNION ALL
  SELECT grp.lang, grp.source, measure, cell, top, c * least(n_l, 100) * greatest(n_a, 1) FROM grp JOIN by_lang ON grp.lang IS NOT DISTINCT FROM by_lang.lang
  UNION ALL
  SELECT grp.lang, grp.source, measure, cell, top, c * (100 - least(n_l, 100)) * greatest(n_l, 1) FROM grp, by_all),
ranked AS (
  SELECT *, sum(c) OVER (PARTITION BY lang, source, measure ORDER BY cell) AS below, sum(c) OVER (PARTITION BY lang, source, measure) AS n
  FROM (SELECT lang, source, measure, cell, any_value(top) AS top, sum(c)::HUGEINT AS c FROM mix GROUP BY ALL)),
read AS (
  SELECT lang, source, measure, any_value(spread) AS spread, any_value(two_sided) AS two_sided,
         min(top) FILTER (below * 100 >= n * p_low) AS low, min(top) FILTER (below * 100 >= n * p_high) AS high
  FROM ranked JOIN fence USING (measure) GROUP BY lang, source, measure),
quant AS (
  SELECT *, {least} AS least FROM (
    SELECT *, max(low) FILTER (measure = 'n_words') OVER g AS med_words, max(low) FILTER (measure = 'n_lines') OVER g AS med_lines FROM read WINDOW g AS (PARTITION BY lang, source))
  WHERE measure NOT IN ('n_words', 'n_lines')),
over AS (
  SELECT rid, max(coalesce(v > high + spread * greatest(high - low, least) OR (two_sided AND v < low - spread * greatest(high - low, least)), false)) AS out
  FROM long LEFT JOIN quant ON long.lang IS NOT DISTINCT FROM quant.lang AND long.source IS NOT DISTINCT FROM quant.source AND long.measure = quant.measure GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT out AS kept
FROM rates JOIN over USING (rid)
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
                regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN least USING (t) LEFT JOIN lab USING (doc_id)),
cell AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, fails),
letter AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
perm AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
step AS (
  SELECT part, o, s, o[s] AS i,
         sum(n) FILTER (len(list_filter(o[1:s], lambda j: fails[j])) = 0) AS kept,
         sum(n) FILTER (fails[o[s]] AND len(list_filter(o[1:s - 1], lambda j: fails[j])) = 0) AS removed,
         sum(n) FILTER (fails[o[s]] AND len(list_filter(o[1:s - 1], lambda j: fails[j])) > 0) AS redundant,
         sum(n) FILTER (fails[o[s]] AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails,
         sum(g) FILTER (fails[o[s]] AND len(list_filter(o[1:s - 1], lambda j: fails[j])) = 0) AS good_lost,
         sum(x) FILTER (fails[o[s]] AND len(list_filter(o[1:s - 1], lambda j: fails[j])) = 0) AS toxic_lost
  FROM cell, perm, (SELECT unnest([1, 2, 3, 4, 5]) AS s) GROUP BY part, o, s)
SELECT part, array_to_string(list_transform(o, lambda j: 'ABCDE'[j]), '') AS filter_order, s::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
       coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM step
"""

ORACLE: dict[str, str] = {
    "op4_mixing": OP4,
    "op6_sharding": OP6,
    "op7_url_filter": OP7,
    "op8_decontamination": OP8,
    "op10_quality": _op10(),
    "op12_filter_audit": OP12,
}
