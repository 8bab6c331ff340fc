"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import re

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS bound, 2.0::DOUBLE * source_size / weight AS ratio FROM s
), f AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS budget, (SELECT sum(weight) FROM s) AS all_weights,
    coalesce(sum(bound) OVER w, 0) AS bound_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, ratio <= (budget - bound_before) / (all_weights - weight_before) AS is_full FROM f
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN bound ELSE least((budget - (SELECT coalesce(sum(bound), 0) FROM g WHERE is_full))
    / (all_weights - (SELECT coalesce(sum(weight), 0) FROM g WHERE is_full)) * weight, bound) END AS target
  FROM g
), p AS (
  SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM p
)
SELECT doc_id, size, source_size, target,
  CAST(passes * size + greatest(0, least(size, budget - passes * source_size - before)) AS BIGINT) AS taken
FROM q
"""

DECONTAM = r"""
WITH low AS (
  SELECT doc_id AS id, false AS item, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT item_id, true, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT id, item, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low
), items AS (
  SELECT DISTINCT id AS item_id, least(13, len(ws)) AS k, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM w WHERE item AND len(ws) > 0)
), spots AS (
  SELECT id AS doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM items) WHERE NOT item)
), hits AS (
  SELECT doc_id, item_id, i, k FROM spots JOIN items USING (k, win)
), places AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM hits) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
)
SELECT id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN places ON places.doc_id = id LEFT JOIN names ON names.doc_id = id WHERE NOT item
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT h, min(page_id) AS first FROM p GROUP BY h
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(p.h, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""

def _quality() -> str:
    """Word statistics, votes and EM, spelled in DuckDB's lists; only the rules and constants are shared with the operator."""
    from pricelens.llm.quality import FIRST, KEEP, LEAST_GOOD, LEAST_RIGHT, MAX_REPEAT_PERCENT, MIN_WORDS, MOST_GOOD, ROUNDS, RULES

    def vote(measure: str, good: str, bad: str) -> str:
        good, bad = (re.sub(r"\bx\b", f"({measure.replace('/', '::DOUBLE /')})", x) for x in (good, bad))
        return f"CASE WHEN {good} THEN 1 WHEN {bad} THEN 0 ELSE -1 END"

    k = len(RULES)
    part = lambda v, first, vote: " * ".join(f"CASE {v}[{i + 1}] WHEN {vote} THEN acc[{first + i}] WHEN {1 - vote} THEN 1 - acc[{first + i}] ELSE 1.0::DOUBLE END" for i in range(k))
    good = lambda v: f"(acc[1] * {part(v, 2, 1)})"
    bad = lambda v: f"((1 - acc[1]) * {part(v, 2 + k, 0)})"
    soft = f"list_transform(p, lambda e: e.n * CASE WHEN len(acc) = 0 THEN CASE WHEN list_contains(e.v, 0) THEN {1 - FIRST}::DOUBLE ELSE {FIRST}::DOUBLE END ELSE {good('e.v')} / ({good('e.v')} + {bad('e.v')}) END)"
    total = lambda what: f"list_sum(list_transform(range(1, len(p) + 1), lambda j: {what}))"
    count = lambda i, vote, of: total(f"CASE WHEN p[j].v[{i + 1}] = {vote} THEN {of} ELSE 0.0::DOUBLE END")
    rate = lambda i, vote, of: f"({count(i, vote, of)} + 1) / ({count(i, 0, of)} + {count(i, 1, of)} + 2)"
    new = [f"greatest({LEAST_GOOD}::DOUBLE, least({MOST_GOOD}::DOUBLE, ({total('s[j]')} + 1) / ({total('p[j].n')} + 2)))"]
    new += [f"greatest({LEAST_RIGHT}::DOUBLE, {rate(i, 1, 's[j]')})" for i in range(k)] + [rate(i, 0, "(p[j].n - s[j])") for i in range(k)]
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), g AS (
  SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8)) AS fresh FROM r
), c AS (SELECT doc_id, sum(fresh) AS n_repeat FROM g GROUP BY doc_id
), f AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]')) AS n_letters,
    len(regexp_extract_all(t, '[.!?]')) AS n_ends, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutters, len(list_distinct(ws)) AS n_distinct_words, len(regexp_extract_all(t, '[A-Z]{{2,}}')) AS n_capital_words, len(regexp_extract_all(t, '!+')) AS n_bangs
  FROM w LEFT JOIN c USING (doc_id)
), v AS (
  SELECT *, [{', '.join(vote(*rule) for rule in RULES.values())}] AS v FROM f
), p AS (
  SELECT list({{'v': v, 'n': n}} ORDER BY v) AS p FROM (SELECT v, count(*)::DOUBLE AS n FROM v GROUP BY v)
), a AS (
  SELECT list_reduce(list_transform(range({ROUNDS}), lambda i: []::DOUBLE[]), lambda acc, i: list_transform([{soft}], lambda s: [{', '.join(new)}])[1], []::DOUBLE[]) AS acc FROM p
), j AS (
  SELECT *, {good("v")} / ({good("v")} + {bad("v")}) AS q, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM v, a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= {KEEP} AS kept, round(q, 6) AS quality FROM j
"""


#: CRC-32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda acc, b:
  list_reduce(list_concat([xor(acc, b)], range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"""

TRIE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(concat(strlen(r), ':', r, x))) AS l FROM t GROUP BY conv_id
), c AS (
  SELECT conv_id, l, conv_id - conv_id % 100 AS base, {_CRC.format(x="CAST(conv_id AS VARCHAR)")} % 6 AS h FROM l
), r AS (
  SELECT c.conv_id, list_concat(CASE WHEN b.l IS NULL THEN c.l[1:0] ELSE b.l[1:c.h] END, c.l[c.h + 1:]) AS s FROM c LEFT JOIN l b ON b.conv_id = c.base
), p AS (
  SELECT conv_id, d, s[1:d] AS k, len(s) = d AS ended FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)
), n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256 FROM p GROUP BY k, d
), f AS (
  SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), o AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.k[n.d].x) END AS own FROM n LEFT JOIN f ON f.k = n.k AND f.d = n.d
), u AS (
  SELECT k[1:a] AS k, a AS d, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM o) GROUP BY ALL
)
SELECT o.conv_id, o.d AS depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM o JOIN u ON u.k = o.k AND u.d = o.d LEFT JOIN n q ON o.d > 0 AND q.d = o.d - 1 AND q.k = o.k[1:o.d - 1]
"""


ORACLES = {"op1_quality": _quality(), "op9_warc": WARC, "op5_decontam": DECONTAM, "op8_mixing": MIXING, "op11_trie": TRIE}
