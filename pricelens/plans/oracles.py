"""The same answers in DuckDB SQL, written apart from the operators: a name here is a query's name in capitals."""

from __future__ import annotations

from pricelens.plans.views import CAT, HIST, RAWS, SNAP

#: Date columns of results that have some; they are compared as ISO text.
DATES = {
    **dict.fromkeys("trend_days change_events change_counts change_digest churn source_counts snapshot_roundtrip snapshot_dates json_history_roundtrip previous_snapshot".split(), ("snapshot_date",)),
    "trend_series": ("d",),
    "trend_floor_change": ("first_day", "last_day"),
    "trend_gaps": ("snapshot_date", "before"),
    "change_summary": ("snapshot_date", "before"),
}


def with_text_dates(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DATES.get(name, ()))
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


_NORM = "(log10(greatest({x}, {lo})) - log10({lo})) / (log10({hi}) - log10({lo}))"


def _leg(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN 0.5 ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_NORM.format(x=x, lo=f'{lo}::DOUBLE', hi=f'{hi}::DOUBLE')})) END"


_PRICE = "coalesce(CASE WHEN price_blended > 0 THEN price_blended END, (2 * price_input + price_output) / 3, price_input, (2 * openrouter_price_input + openrouter_price_output) / 3, openrouter_price_input)"
_FLOORED = "CASE WHEN price IS NOT NULL THEN greatest(price, 0.05) END"


def _composite(value: str, coding: str) -> str:
    return f"CASE WHEN {value} IS NULL AND {coding} IS NULL THEN NULL ELSE round(0.5 * {_leg(value, *_ENDS[value])} + 0.3 * {_leg(coding, *_ENDS[coding])} + 0.2 * {_leg('output_speed_tps', 20.0, 1000.0)}, 4) END"


_ENDS = {"value_score": (5.0, 500.0), "coding_value": (5.0, 500.0), "arena_value": (50.0, 10000.0), "arena_coding_value": (50.0, 10000.0)}
_SCORED = f"""cat AS ({CAT}), priced AS (SELECT *, {_PRICE} AS price FROM cat), ratios AS (
  SELECT *, round(intelligence_score / {_FLOORED}, 4) AS value_score, round(coding_index / {_FLOORED}, 4) AS coding_value,
    round(arena_elo / {_FLOORED}, 4) AS arena_value, round(arena_coding_elo / {_FLOORED}, 4) AS arena_coding_value,
    coalesce(greatest(uptime_30m, uptime_1d) >= 95, true) AS gated_in FROM priced
), scored AS (
  SELECT *, {_composite("value_score", "coding_value")} AS composite_deal_score, {_composite("arena_value", "arena_coding_value")} AS arena_composite_score FROM ratios
)"""


def _frontier(view: str, quality: str, near: float, composite: str) -> str:
    """CTEs f_<view>: the frontier by pairwise dominance, near repeats dropped one after the other, knee scores and ranks."""
    return f"""c_{view} AS (SELECT model_id, name, price, {quality} AS quality, {composite} AS comp FROM scored WHERE gated_in AND price > 0 AND {quality} IS NOT NULL
), d_{view} AS (SELECT *, row_number() OVER (PARTITION BY price, quality ORDER BY coalesce(comp, 0) DESC, name, model_id) AS twin FROM c_{view} a WHERE NOT EXISTS (
    SELECT 1 FROM c_{view} b WHERE b.price <= a.price AND b.quality >= a.quality AND (b.price < a.price OR b.quality > a.quality))
), o_{view} AS (SELECT *, row_number() OVER (ORDER BY price, model_id) AS i FROM d_{view} WHERE twin = 1
), k_{view} AS (
  SELECT i, price, quality, true AS kept, log10(price) AS lp, quality AS lq FROM o_{view} WHERE i = 1
  UNION ALL
  SELECT o.i, o.price, o.quality, NOT (log10(o.price) - k.lp < 0.02 AND abs(o.quality - k.lq) < {near}),
    CASE WHEN log10(o.price) - k.lp < 0.02 AND abs(o.quality - k.lq) < {near} THEN k.lp ELSE log10(o.price) END,
    CASE WHEN log10(o.price) - k.lp < 0.02 AND abs(o.quality - k.lq) < {near} THEN k.lq ELSE o.quality END
  FROM k_{view} k JOIN o_{view} o ON o.i = k.i + 1
), s_{view} AS (
  SELECT o.model_id, o.name, o.price, o.quality, round(coalesce((o.quality - min(o.quality) OVER ()) / nullif(max(o.quality) OVER () - min(o.quality) OVER (), 0), 0)
    - coalesce((log10(o.price) - min(log10(o.price)) OVER ()) / nullif(max(log10(o.price)) OVER () - min(log10(o.price)) OVER (), 0), 0), 4) AS frontier_score
  FROM o_{view} o JOIN k_{view} USING (i) WHERE kept
), f_{view} AS (SELECT *, CAST(row_number() OVER (ORDER BY frontier_score DESC, name, model_id) AS INTEGER) AS frontier_rank FROM s_{view})"""


_BOTH = f"{_SCORED}, {_frontier('intel', 'intelligence_score', 0.5, 'composite_deal_score')}, {_frontier('arena', 'coalesce(coding_index, arena_elo, arena_coding_elo)', 5.0, 'arena_composite_score')}"

BEST_VALUE_FRONTIER = f"WITH RECURSIVE {_BOTH} SELECT model_id, name, round(price, 6) AS price, quality, frontier_score, frontier_rank FROM f_intel"

FRONTIER_FLAGS = f"""WITH RECURSIVE {_BOTH} SELECT s.model_id, i.frontier_rank IS NOT NULL AS is_frontier_intel, i.frontier_rank AS frontier_rank_intel, i.frontier_score AS frontier_score_intel,
  a.frontier_rank IS NOT NULL AS is_frontier_arena, a.frontier_rank AS frontier_rank_arena, a.frontier_score AS frontier_score_arena
FROM scored s LEFT JOIN f_intel i USING (model_id) LEFT JOIN f_arena a ON a.model_id = s.model_id"""

TOP_DEALS = f"""WITH RECURSIVE {_BOTH} SELECT model_id, composite_deal_score, frontier_rank AS frontier_rank_intel FROM scored LEFT JOIN f_intel USING (model_id)
WHERE CASE WHEN EXISTS (SELECT 1 FROM f_intel) THEN frontier_rank IS NOT NULL ELSE composite_deal_score IS NOT NULL AND gated_in END
ORDER BY frontier_rank NULLS LAST, composite_deal_score DESC NULLS LAST, coalesce(intelligence_score, 0) DESC, model_id LIMIT 4"""

PARETO_FRONTIER_LARGE = """WITH o AS (SELECT o_orderkey, o_totalprice, o_totalprice + o_orderkey % 1000 AS q FROM orders WHERE o_totalprice > 0),
p AS (SELECT o_totalprice, max(q) AS q FROM o GROUP BY o_totalprice),
r AS (SELECT *, max(q) OVER (ORDER BY o_totalprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p)
SELECT o.* FROM o JOIN r ON o.o_totalprice = r.o_totalprice AND o.q = r.q WHERE before IS NULL OR r.q > before"""

EFFECTIVE_PRICE = f"""WITH cat AS ({CAT}), p AS (SELECT model_id, {_PRICE} AS price FROM cat)
SELECT model_id, round(price, 6) AS price, round(CASE WHEN price IS NOT NULL THEN greatest(price, 0.05) END, 6) AS scoring_price,
  CASE WHEN price IS NULL THEN 'n/a' WHEN round(price, 3) < 1 THEN printf('$%.3f', round(price, 3)) ELSE concat('$', CAST(round(CAST(round(price, 3) AS DECIMAL(12, 3)), 2) AS DECIMAL(12, 2))) END AS label FROM p"""

COMPOSITE_SCORES = f"""WITH {_SCORED} SELECT model_id, value_score, coding_value, arena_value, arena_coding_value, composite_deal_score, arena_composite_score, gated_in, composite_deal_score IS NOT NULL AND gated_in AS candidate FROM scored"""

def _tier(name: str) -> str:
    """A size tier by billions (a column) or by the first size word of a name."""
    word = rf"regexp_extract(lower(regexp_replace({name}, '\([^)]*\)', '', 'g')), '\b(nano|tiny|micro|mini|xs|small|medium|large|xl|xxl)\b', 1)"
    return f"""CASE WHEN billions < 3 THEN 'nano' WHEN billions < 15 THEN 'small' WHEN billions < 70 THEN 'medium' WHEN billions IS NOT NULL THEN 'large'
  WHEN {word} IN ('nano', 'tiny') THEN 'nano' WHEN {word} IN ('micro', 'mini', 'xs', 'small') THEN 'small' WHEN {word} = 'medium' THEN 'medium' WHEN {word} IN ('large', 'xl', 'xxl') THEN 'large' ELSE 'unknown' END"""


SIZE_TIERS = rf"""WITH n AS (SELECT p_partkey, concat(p_name, ' ', CAST(CAST(p_size * 1.5 AS DECIMAL(6, 1)) AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN 'B' ELSE 'x' END, CASE WHEN p_partkey % 3 = 0 THEN ' mini (large)' ELSE '' END) AS name FROM part),
m AS (SELECT *, list_max(list_transform(regexp_extract_all(name, '(\d+(?:\.\d+)?)\s*[Bb](?:\b|$)', 1), lambda x: CAST(x AS DOUBLE))) AS billions FROM n)
SELECT p_partkey, billions, {_tier("name")} AS tier FROM m"""

NORMALISED_NAMES = r"""WITH n AS (SELECT p_partkey, concat('vendor-x/', p_name, CASE WHEN p_partkey % 2 = 0 THEN ' (Nov ''24)' ELSE ' (xhigh)' END, CASE WHEN p_partkey % 3 = 0 THEN ' V3.1 turbo' ELSE '-20250219' END) AS name,
  concat(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' xhigh' END, CASE WHEN p_partkey % 3 = 0 THEN ' turbo' ELSE '' END) AS norm FROM part)
SELECT p_partkey, norm, replace(norm, ' ', '-') AS slug, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS name_slug, trim(regexp_replace(lower(substr(name, 10)), '[^a-z0-9]+', '-', 'g'), '-') AS path_slug FROM n"""

RANKED_CATALOG_TOP = f"WITH {_SCORED} SELECT model_id, composite_deal_score, intelligence_score FROM scored ORDER BY composite_deal_score DESC NULLS LAST, coalesce(intelligence_score, 0) DESC, model_id LIMIT 50"

LEADERBOARD = f"WITH {_SCORED} SELECT model_id, composite_deal_score, {_tier("name")} AS size_tier FROM (SELECT *, CAST(NULL AS DOUBLE) AS billions FROM scored) WHERE composite_deal_score IS NOT NULL AND gated_in AND intelligence_score >= 20"

_ELIGIBLE = f"""{_SCORED}, e AS (SELECT *, CASE WHEN intelligence_score >= 40 THEN 'flagship' WHEN intelligence_score >= 25 THEN 'workhorse' WHEN intelligence_score >= 0 THEN 'budget' END AS band
  FROM scored WHERE intelligence_score IS NOT NULL AND composite_deal_score IS NOT NULL), m AS (
  SELECT *, row_number() OVER (PARTITION BY band ORDER BY composite_deal_score DESC, intelligence_score DESC, model_id) AS place,
    row_number() OVER (PARTITION BY band, gated_in ORDER BY composite_deal_score DESC, intelligence_score DESC, model_id) AS gate_place,
    row_number() OVER (PARTITION BY band ORDER BY CASE WHEN price > 0 THEN price ELSE 'inf'::DOUBLE END, composite_deal_score DESC, intelligence_score DESC, model_id) AS price_place
  FROM e WHERE band IS NOT NULL)"""

BAND_MEMBERS = f"WITH {_ELIGIBLE} SELECT band, CAST(place AS INTEGER) AS place, model_id FROM m WHERE place <= 8"

BAND_LEADERBOARD = f"""WITH {_ELIGIBLE}, b(band, label) AS (VALUES ('flagship', 'Frontier-class'), ('workhorse', 'Workhorse'), ('budget', 'Budget'))
SELECT band, label, count(model_id) AS n, coalesce(max(model_id) FILTER (gated_in AND gate_place = 1), max(model_id) FILTER (place = 1)) AS leader_id, max(model_id) FILTER (price_place = 1) AS cheapest_id,
  round(min(price) FILTER (price > 0), 6) AS cheapest_price, coalesce(string_agg(model_id, ',' ORDER BY place) FILTER (place <= 8), '') AS member_ids
FROM b LEFT JOIN m USING (band) GROUP BY band, label"""

CHEAPEST_ABOVE = f"""WITH {_ELIGIBLE}, w(threshold) AS (VALUES (25.0::DOUBLE), (40.0::DOUBLE), (50.0::DOUBLE), (1000.0::DOUBLE)), t AS (SELECT threshold, model_id, round(price, 4) AS price,
  row_number() OVER (PARTITION BY threshold ORDER BY CASE WHEN e.price > 0 THEN e.price ELSE 'inf'::DOUBLE END, composite_deal_score DESC, intelligence_score DESC, model_id) AS n FROM e, w WHERE price IS NOT NULL AND band IS NOT NULL AND intelligence_score >= threshold)
SELECT w.threshold, model_id, price FROM w LEFT JOIN (SELECT * FROM t WHERE n = 1) b ON b.threshold = w.threshold"""

_DAYS = f"""hist AS ({HIST}), days AS (SELECT snapshot_date, count(*) FILTER (price > 0 AND intelligence_score IS NOT NULL) AS priced, threshold, min(price) FILTER (price > 0 AND intelligence_score >= threshold) AS cheapest,
  median(price) FILTER (price > 0 AND intelligence_score >= threshold) AS median, count(price) FILTER (price > 0 AND intelligence_score >= threshold) AS n
  FROM hist, (VALUES (25), (40), (50)) v(threshold) GROUP BY snapshot_date, threshold)"""

TREND_DAYS = f"WITH {_DAYS} SELECT snapshot_date, priced, CAST(threshold AS VARCHAR) AS threshold, cheapest, round(median, 7) AS median, n FROM days"

TREND_FLOOR_CHANGE = f"""WITH {_DAYS} SELECT CAST(threshold AS DOUBLE) AS threshold, min(snapshot_date) FILTER (cheapest IS NOT NULL) AS first_day, arg_min(cheapest, snapshot_date) FILTER (cheapest IS NOT NULL) AS first_price,
  max(snapshot_date) FILTER (cheapest IS NOT NULL) AS last_day, arg_max(cheapest, snapshot_date) FILTER (cheapest IS NOT NULL) AS last_price FROM days GROUP BY threshold"""

_SERIES = f"""hist AS ({HIST}), s AS (SELECT model_id, name, snapshot_date AS d, intelligence_score AS i, price AS p, count(*) OVER (PARTITION BY model_id) AS n, row_number() OVER (PARTITION BY model_id ORDER BY snapshot_date DESC) AS r
  FROM hist WHERE intelligence_score IS NOT NULL AND price > 0), series AS (SELECT * FROM s WHERE n >= 14 AND r <= 180)"""

TREND_SERIES = f"WITH {_SERIES} SELECT model_id, name, d, i, p FROM series"

SPARKLINE = f"""WITH {_SERIES}, l AS (SELECT * FROM series WHERE r <= 30) SELECT model_id, CAST(count(*) AS INTEGER) AS n, arg_min(p, d) AS first, arg_max(p, d) AS last, arg_max(p, d) < arg_min(p, d) AS falling FROM l GROUP BY model_id"""

TREND_GAPS = f"""WITH hist AS ({HIST}), d AS (SELECT DISTINCT snapshot_date FROM hist), l AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before FROM d)
SELECT snapshot_date, before, coalesce(date_diff('day', before, snapshot_date) > 30, false) AS gap FROM l"""

_SNAP = f"""raw AS ({SNAP}), snap AS (SELECT *, list_distinct([concat('src', low_source), concat('src', top_source)]) AS pages FROM raw),
days AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT snapshot_date FROM snap)),
cmp AS (SELECT coalesce(t.snapshot_date, p.snapshot_date) AS snapshot_date, coalesce(t.model_id, p.model_id) AS model_id, t.model_id IS NOT NULL AS has_t, p.model_id IS NOT NULL AS has_p,
  t.intelligence_score AS ti, p.intelligence_score AS pi, t.price AS tp, p.price AS pp, t.output_speed_tps AS ts, p.output_speed_tps AS ps, p.pages AS ppages, coalesce(t.name, p.name) AS name
  FROM (SELECT s.* FROM snap s JOIN days USING (snapshot_date) WHERE before IS NOT NULL) t FULL OUTER JOIN (
    SELECT days.snapshot_date, s.* EXCLUDE (snapshot_date) FROM snap s JOIN days ON s.snapshot_date = days.before) p ON t.model_id = p.model_id AND t.snapshot_date = p.snapshot_date),
src AS (SELECT snapshot_date, source, count(*) AS n FROM (SELECT snapshot_date, unnest(pages) AS source FROM snap) GROUP BY ALL),
lost AS (SELECT days.snapshot_date, list(source) AS gone FROM src JOIN days ON src.snapshot_date = days.before WHERE n >= 50 AND NOT EXISTS (
  SELECT 1 FROM src x WHERE x.snapshot_date = days.snapshot_date AND x.source = src.source) GROUP BY days.snapshot_date),
gone AS (SELECT cmp.*, coalesce(lost.gone, []) AS lost, NOT has_t AND NOT (len(ppages) > 0 AND len(list_filter(ppages, lambda x: NOT list_contains(coalesce(lost.gone, []), x))) = 0) AS open_removal FROM cmp LEFT JOIN lost USING (snapshot_date)),
guard AS (SELECT snapshot_date, count(*) FILTER (has_p) AS n_before, count(*) FILTER (open_removal) AS n_left, max(len(lost)) AS n_lost FROM gone GROUP BY snapshot_date)"""

_EVENTS = f"""{_SNAP}, both_days AS (SELECT * FROM cmp WHERE has_t AND has_p), fast AS (
  SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY abs((ts - ps) / ps) DESC, model_id) AS n FROM both_days WHERE ts <> 0 AND ps <> 0 AND abs((ts - ps) / ps) >= 0.25),
ev AS (
  SELECT snapshot_date, model_id, 'new' AS kind, NULL AS direction, NULL::DOUBLE AS old, ti AS new, NULL::DOUBLE AS pct, NULL::DOUBLE AS delta, name, tp AS price, NULL::DOUBLE AS composite FROM cmp WHERE NOT has_p
  UNION ALL SELECT snapshot_date, model_id, 'removed', NULL, pi, NULL, NULL, NULL, name, pp, NULL FROM gone JOIN guard USING (snapshot_date) WHERE open_removal AND NOT n_left > greatest(20, floor(0.05 * n_before))
  UNION ALL SELECT snapshot_date, model_id, 'price', CASE WHEN tp > pp THEN 'hike' ELSE 'cut' END, round(pp, 6), round(tp, 6), round(round(100 * ((tp - pp) / pp), 6), 1), NULL, name, NULL, NULL FROM both_days WHERE tp <> 0 AND pp > 0 AND abs((tp - pp) / pp) >= 0.05
  UNION ALL SELECT snapshot_date, model_id, 'intelligence', CASE WHEN ti > pi THEN 'up' ELSE 'down' END, pi, ti, NULL, round(round(ti - pi, 6), 1), name, NULL, NULL FROM both_days WHERE abs(ti - pi) >= 0.5
  UNION ALL SELECT snapshot_date, model_id, 'speed', CASE WHEN ts > ps THEN 'up' ELSE 'down' END, round(ps), round(ts), round(round(100 * ((ts - ps) / ps), 6), 1), NULL, name, NULL, NULL FROM fast WHERE n <= 15)"""

CHANGE_EVENTS = f"WITH {_EVENTS} SELECT * FROM ev"
CHANGE_COUNTS = f"WITH {_EVENTS} SELECT snapshot_date, kind, direction, count(*) AS n FROM ev GROUP BY ALL"
_QUALITY = "CASE WHEN before IS NULL THEN 'first_run' WHEN n_left > greatest(20, floor(0.05 * n_before)) THEN 'degraded' WHEN n_lost > 0 THEN 'partial' ELSE 'ok' END"
_SUMMARY = f"""summed AS (SELECT days.snapshot_date, before, coalesce(n_before, 0) AS n_before, coalesce(n_left, 0) AS n_left, {_QUALITY} AS data_quality,
  CASE WHEN {_QUALITY} = 'partial' THEN array_to_string(list_sort(lost.gone), ', ') ELSE '' END AS sources_out, false AS scoring_changed FROM days LEFT JOIN guard ON guard.snapshot_date = days.snapshot_date LEFT JOIN lost ON lost.snapshot_date = days.snapshot_date)"""
CHANGE_SUMMARY = f"WITH {_SNAP}, {_SUMMARY} SELECT * FROM summed"
_LABEL = "CASE WHEN {x} IS NULL THEN 'n/a' WHEN round({x}, 3) < 1 THEN printf('$%.3f', round({x}, 3)) ELSE concat('$', CAST(round(CAST(round({x}, 3) AS DECIMAL(12, 3)), 2) AS DECIMAL(12, 2))) END"
CHANGE_DIGEST = f"""WITH {_EVENTS}, {_SUMMARY}, o AS (
  SELECT *, row_number() OVER (PARTITION BY snapshot_date, kind ORDER BY CASE kind WHEN 'price' THEN abs(pct) WHEN 'speed' THEN abs(pct) WHEN 'intelligence' THEN abs(delta) ELSE 0 END DESC, model_id) AS place FROM ev
), l AS (
  SELECT snapshot_date, CAST(place AS INTEGER) AS place, CASE kind WHEN 'price' THEN 1 WHEN 'new' THEN 2 WHEN 'intelligence' THEN 3 WHEN 'removed' THEN 5 ELSE 6 END AS section_no,
    CASE kind WHEN 'price' THEN concat(name, ': ', {_LABEL.format(x="old")}, ' -> ', {_LABEL.format(x="new")}, ' (', CASE WHEN round_even(pct, 0) >= 0 THEN '+' ELSE '' END, CAST(CAST(round_even(pct, 0) AS INTEGER) AS VARCHAR), '%, ', direction, ')')
      WHEN 'new' THEN concat(name, ': intelligence ', CAST(new AS VARCHAR), ', price ', {_LABEL.format(x="price")}, ', deal None')
      WHEN 'intelligence' THEN concat(name, ': ', CAST(old AS VARCHAR), ' -> ', CAST(new AS VARCHAR), ' (', CASE WHEN delta >= 0 THEN '+' ELSE '' END, printf('%.1f', delta), ' pts, ', direction, ')')
      WHEN 'removed' THEN concat(name, ' (was intelligence ', CAST(old AS VARCHAR), ', ', {_LABEL.format(x="price")}, ')')
      ELSE concat(name, ': ', CAST(CAST(old AS INTEGER) AS VARCHAR), ' -> ', CAST(CAST(new AS INTEGER) AS VARCHAR), ' t/s (', CASE WHEN round_even(pct, 0) >= 0 THEN '+' ELSE '' END, CAST(CAST(round_even(pct, 0) AS INTEGER) AS VARCHAR), '%)') END AS line
  FROM o WHERE kind <> 'speed' OR place <= 5
), k(section_no, section) AS (VALUES (1, 'PRICE CHANGES'), (2, 'NEW MODELS'), (3, 'INTELLIGENCE CHANGES'), (4, 'RANK / FRONTIER MOVES'), (5, 'REMOVED MODELS'), (6, 'SPEED CHANGES'))
SELECT d.snapshot_date, k.section_no, section, coalesce(place, 0) AS place, coalesce(line, 'none') AS line FROM summed d CROSS JOIN k LEFT JOIN l ON l.snapshot_date = d.snapshot_date AND l.section_no = k.section_no
UNION ALL SELECT snapshot_date, 0, 'STATUS', 1, concat('Changes since ', coalesce(CAST(before AS VARCHAR), 'N/A'), '. Data quality: ', CASE WHEN data_quality = 'first_run' THEN 'ok' ELSE data_quality END,
  CASE WHEN sources_out <> '' THEN concat(', unavailable sources: ', sources_out) ELSE '' END, '.', CASE WHEN before IS NULL THEN ' First snapshot.' ELSE '' END) FROM summed"""
CHURN = f"""WITH {_SNAP} SELECT snapshot_date, count(*) FILTER (has_p) AS n_before, count(*) FILTER (has_t) AS n_now, count(*) FILTER (has_t AND has_p) AS common, count(*) FILTER (NOT has_p) AS added, count(*) FILTER (NOT has_t) AS removed FROM cmp GROUP BY snapshot_date"""
SOURCE_COUNTS = f"WITH {_SNAP} SELECT snapshot_date, source, n FROM src"
FIELD_NOISE = f"""WITH {_SNAP}, f AS (SELECT 'intelligence_score' AS field, ti AS new, pi AS old FROM cmp UNION ALL SELECT 'price', tp, pp FROM cmp UNION ALL SELECT 'output_speed_tps', ts, ps FROM cmp),
m AS (SELECT field, abs(100 * (new - old) / old) AS move FROM f WHERE new IS NOT NULL AND old IS NOT NULL AND old <> 0)
SELECT field, count(*) AS pairs, round(100.0 * count(*) FILTER (move > 0) / count(*), 2) AS changed_pct, round(quantile_cont(move, 0.5) FILTER (move > 0), 4) AS median, round(quantile_cont(move, 0.9) FILTER (move > 0), 4) AS p90, round(quantile_cont(move, 0.95) FILTER (move > 0), 4) AS p95, round(quantile_cont(move, 0.99) FILTER (move > 0), 4) AS p99, round(max(move), 4) AS largest FROM m GROUP BY field"""

MERGED_CATALOG = f"""WITH raws AS ({RAWS}), r AS (SELECT *, CASE source WHEN 'leaderboard' THEN 0 WHEN 'coding' THEN 1 WHEN 'arena-text' THEN 3 WHEN 'openrouter' THEN 5 ELSE 50 END AS prio,
  trim(regexp_replace(lower(regexp_replace(regexp_replace(name, ' \\(Nov 24\\)', ''), ' v1\\.2', '')), '[^a-z0-9 ]', '', 'g')) AS norm FROM raws),
f AS (SELECT norm, arg_min(model_id, ingest_seq) AS id FROM r GROUP BY norm), g AS (SELECT r.*, CASE WHEN regexp_matches(id, '[a-z]') THEN id ELSE replace(norm, ' ', '-') END AS slug FROM r JOIN f USING (norm))
SELECT slug, arg_min(price_input, prio::BIGINT * 1000000000 + ingest_seq) FILTER (price_input IS NOT NULL) AS price_input, arg_min(intelligence_score, prio::BIGINT * 1000000000 + ingest_seq) FILTER (intelligence_score IS NOT NULL) AS intelligence_score,
  arg_min(creator, prio::BIGINT * 1000000000 + ingest_seq) FILTER (creator IS NOT NULL) AS creator, arg_min(name, ingest_seq - length(name)::BIGINT * 1000000000) AS name, min(ingest_seq) AS ingest_seq,
  (SELECT string_agg(source, ',' ORDER BY prio, source) FROM (SELECT DISTINCT source, prio FROM g x WHERE x.slug = g.slug)) AS source_pages FROM g GROUP BY slug"""

PAGE_LINKS = """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hrefs FROM pages), p AS (SELECT page_id, unnest(range(0, len(hrefs))) AS place, unnest(hrefs) AS href FROM l)
SELECT page_id, CAST(place AS INTEGER) AS place, href, nullif(regexp_extract(href, '^/([^/?#]+)', 1), '') AS slug FROM p"""

EVENT_PROPS = "SELECT user_id, event_type, max(value) AS max_value FROM events GROUP BY user_id, event_type"

PARSED_CELLS = """SELECT p_partkey, 1000 + p_partkey AS score, CASE p_partkey % 3 WHEN 0 THEN p_partkey % 9 WHEN 1 THEN (10 + p_partkey % 7) // 2 END AS ci, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 50 AS DOUBLE) END AS price_input,
  CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 90 AS DOUBLE) END AS price_output, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey * 1000 END AS context_k FROM part"""

COVERAGE_PROFILE = f"""WITH cat AS ({CAT}) SELECT field, known, rows FROM (SELECT count(*) AS rows, count(intelligence_score) AS intelligence_score, count(price_blended) AS price_blended, count(price_input) AS price_input,
  count(openrouter_price_input) AS openrouter_price_input, count(uptime_30m) AS uptime_30m, count(arena_elo) AS arena_elo FROM cat) UNPIVOT (known FOR field IN (intelligence_score, price_blended, price_input, openrouter_price_input, uptime_30m, arena_elo))"""
SCORE_HISTOGRAM = f"WITH cat AS ({CAT}) SELECT floor(intelligence_score / 5) * 5 AS low, count(*) AS n FROM cat WHERE intelligence_score IS NOT NULL GROUP BY low"
SCORE_PERCENTILES = f"WITH cat AS ({CAT}) SELECT part::DOUBLE AS part, round((SELECT quantile_cont(intelligence_score, [0.25, 0.5, 0.9]) FROM cat)[i], 6) AS value FROM (VALUES (1, 0.25), (2, 0.5), (3, 0.9)) v(i, part)"

SNAPSHOT_ROUNDTRIP = f"WITH raw AS ({SNAP}) SELECT snapshot_date, model_id, intelligence_score, price, CASE WHEN low_source = top_source THEN concat('src', low_source) ELSE concat('src', low_source, ',src', top_source) END AS source_pages FROM raw"
SNAPSHOT_DATES = f"WITH raw AS ({SNAP}) SELECT DISTINCT snapshot_date FROM raw"
JSON_HISTORY_ROUNDTRIP = f"WITH raw AS ({SNAP}) SELECT snapshot_date, count(*) AS n, round(sum(price), 3) AS price FROM raw GROUP BY snapshot_date"
PREVIOUS_SNAPSHOT = f"WITH raw AS ({SNAP}) SELECT snapshot_date, model_id, price FROM raw WHERE snapshot_date = (SELECT max(snapshot_date) FROM raw WHERE snapshot_date < DATE '2000-06-15')"

API_ITEMS = """SELECT concat(['openai/', 'Anthropic/', 'z-ai/', 'nobody/', 'openai', 'tülu3/'][p_partkey % 6 + 1], 'p', p_partkey) AS item_id, p_name AS name,
  CASE p_partkey % 6 WHEN 0 THEN 'OpenAI' WHEN 1 THEN 'Anthropic' WHEN 2 THEN 'Z.ai' WHEN 5 THEN 'Ai2' END AS creator, round((p_partkey % 90) * 1e6, 4)::DOUBLE AS price_input, NULL::DOUBLE AS price_output,
  CASE WHEN p_partkey > 0 THEN p_partkey END AS context_k FROM part WHERE p_partkey % 7 > 1 AND p_partkey % 90 > 0"""

MARKDOWN_LEADERBOARD = """SELECT concat('p-', p_partkey) AS model_id, concat('Part ', p_partkey) AS name, p_brand AS creator, 1000 + p_partkey % 700 AS score, p_partkey % 9 AS ci, 1.0::DOUBLE AS price_input, (p_partkey % 30)::DOUBLE AS price_output FROM part"""

RESCORED_HISTORY = f"""WITH raw AS ({SNAP}), v AS (SELECT *, round(intelligence_score / greatest(price, 0.05), 4) AS value_score FROM raw), s AS (
  SELECT *, round(0.5 * {_leg("value_score", 5.0, 500.0)} + 0.3 * 0.5 + 0.2 * {_leg("output_speed_tps", 20.0, 1000.0)}, 4) AS comp FROM v
), d AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date, price, intelligence_score ORDER BY comp DESC, name, model_id) AS twin FROM s a WHERE price > 0 AND NOT EXISTS (
    SELECT 1 FROM s b WHERE b.snapshot_date = a.snapshot_date AND b.price > 0 AND b.price <= a.price AND b.intelligence_score >= a.intelligence_score AND (b.price < a.price OR b.intelligence_score > a.intelligence_score))
), o AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date ORDER BY price, model_id) AS i FROM d WHERE twin = 1
), k AS (
  SELECT snapshot_date, i, true AS kept, log10(price) AS lp, intelligence_score AS lq FROM o WHERE i = 1
  UNION ALL
  SELECT o.snapshot_date, o.i, NOT (log10(o.price) - k.lp < 0.02 AND abs(o.intelligence_score - k.lq) < 0.5),
    CASE WHEN log10(o.price) - k.lp < 0.02 AND abs(o.intelligence_score - k.lq) < 0.5 THEN k.lp ELSE log10(o.price) END,
    CASE WHEN log10(o.price) - k.lp < 0.02 AND abs(o.intelligence_score - k.lq) < 0.5 THEN k.lq ELSE o.intelligence_score END
  FROM k JOIN o ON o.snapshot_date = k.snapshot_date AND o.i = k.i + 1
), z AS (
  SELECT o.snapshot_date, o.model_id, o.name, round(coalesce((intelligence_score - min(intelligence_score) OVER w) / nullif(max(intelligence_score) OVER w - min(intelligence_score) OVER w, 0), 0)
    - coalesce((log10(price) - min(log10(price)) OVER w) / nullif(max(log10(price)) OVER w - min(log10(price)) OVER w, 0), 0), 4) AS fs
  FROM o JOIN k ON o.snapshot_date = k.snapshot_date AND o.i = k.i WHERE kept WINDOW w AS (PARTITION BY o.snapshot_date)
), f AS (SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_date ORDER BY fs DESC, name, model_id) AS INTEGER) AS frontier_rank_intel FROM z)
SELECT s.snapshot_date, s.model_id, comp AS composite_deal_score, frontier_rank_intel FROM s LEFT JOIN f ON f.snapshot_date = s.snapshot_date AND f.model_id = s.model_id"""
RESCORED_HISTORY = RESCORED_HISTORY.replace("WITH raw AS", "WITH RECURSIVE raw AS", 1)
DATES["rescored_history"] = ("snapshot_date",)

RENAMED_ITEMS = f"""WITH raw AS ({SNAP}), p AS (SELECT snapshot_date, year(snapshot_date) AS y, model_id FROM raw WHERE CAST(substr(model_id, 2) AS INTEGER) % 100 = 0)
SELECT a.snapshot_date, CASE WHEN b.y % 2 = 1 THEN concat(b.model_id, 'b') ELSE b.model_id END AS old_id, CASE WHEN a.y % 2 = 1 THEN concat(a.model_id, 'b') ELSE a.model_id END AS new_id FROM p a JOIN p b ON a.model_id = b.model_id AND a.y = b.y + 1"""
DATES["renamed_items"] = ("snapshot_date",)

FRONTIER_AND_RANK_EVENTS = (
    RESCORED_HISTORY.rpartition("\nSELECT s.snapshot_date")[0]
    + """, days AS (SELECT snapshot_date, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT snapshot_date FROM raw)
), x AS (
  SELECT days.snapshot_date, b.model_id, a.model_id IS NOT NULL AS here, a.intelligence_score AS ti, a.price AS tp, coalesce(a.name, b.name) AS name, t.frontier_rank_intel AS place, q.frontier_rank_intel AS was FROM days JOIN raw b ON b.snapshot_date = days.before
  LEFT JOIN raw a ON a.snapshot_date = days.snapshot_date AND a.model_id = b.model_id LEFT JOIN f t ON t.snapshot_date = days.snapshot_date AND t.model_id = b.model_id LEFT JOIN f q ON q.snapshot_date = days.before AND q.model_id = b.model_id
), y AS (
  SELECT *, coalesce(place <= 20 AND was IS NOT NULL AND ((place <= 10 AND was > 10) OR abs(place - was) >= 3), false) AS moved, coalesce(was <= 10 AND coalesce(place > 10, true), false) AS dropped FROM x
)
SELECT snapshot_date, model_id, 'frontier' AS kind, CASE WHEN place IS NOT NULL THEN 'entered' ELSE 'left' END AS direction, NULL::DOUBLE AS old, ti AS new FROM x WHERE here AND (place IS NULL) <> (was IS NULL)
UNION ALL
SELECT snapshot_date, model_id, 'rank', CASE WHEN dropped AND NOT moved THEN 'left_top' WHEN place <= 10 AND was > 10 THEN 'entered_top' WHEN place < was THEN 'up' ELSE 'down' END, was::DOUBLE, place::DOUBLE FROM y WHERE moved OR dropped"""
)
DATES["frontier_and_rank_events"] = ("snapshot_date",)


EVENT_TOTALS = f"""WITH {_EVENTS} SELECT d.snapshot_date, count(kind) AS total, count(*) FILTER (kind = 'new') AS new, count(*) FILTER (kind = 'removed') AS removed, count(*) FILTER (kind = 'price') AS price,
  count(*) FILTER (kind = 'intelligence') AS intelligence, count(*) FILTER (kind = 'speed') AS speed, count(*) FILTER (kind = 'rank') AS rank, count(*) FILTER (kind = 'frontier') AS frontier
FROM days d LEFT JOIN ev USING (snapshot_date) GROUP BY d.snapshot_date"""
DATES["event_totals"] = ("snapshot_date",)

#: Days of even years are of scoring version 2, those of odd years of none, but from 1996 on all are of 2.
_RANKED = (
    FRONTIER_AND_RANK_EVENTS.rpartition("\nSELECT snapshot_date, model_id, 'frontier'")[0].replace("), days AS (SELECT snapshot_date, lag(snapshot_date)", "), rdays AS (SELECT snapshot_date, lag(snapshot_date)", 1).replace("FROM days JOIN raw b ON b.snapshot_date = days.before", "FROM rdays AS days JOIN raw b ON b.snapshot_date = days.before")
    + f""", {_EVENTS.partition("raw AS (" + SNAP + "), ")[2]}, versions AS (
  SELECT snapshot_date, before, CASE WHEN year(snapshot_date) >= 1996 OR year(snapshot_date) % 2 = 0 THEN 2 END AS v, CASE WHEN year(before) >= 1996 OR year(before) % 2 = 0 THEN 2 END AS w FROM days
), same AS (SELECT snapshot_date, before IS NOT NULL AND v IS NOT DISTINCT FROM w AS same_scoring FROM versions
), every AS (
  SELECT ev.* EXCLUDE (composite), CASE WHEN kind = 'new' THEN s.comp END AS composite FROM ev LEFT JOIN s ON s.snapshot_date = ev.snapshot_date AND s.model_id = ev.model_id
  UNION ALL SELECT x.snapshot_date, model_id, 'frontier', CASE WHEN place IS NOT NULL THEN 'entered' ELSE 'left' END, NULL, ti, NULL, NULL, name, tp, NULL FROM x JOIN same USING (snapshot_date) WHERE same_scoring AND here AND (place IS NULL) <> (was IS NULL)
  UNION ALL SELECT y.snapshot_date, model_id, 'rank', CASE WHEN dropped AND NOT moved THEN 'left_top' WHEN place <= 10 AND was > 10 THEN 'entered_top' WHEN place < was THEN 'up' ELSE 'down' END, was, place, NULL, NULL, name, NULL, NULL FROM y JOIN same USING (snapshot_date) WHERE same_scoring AND (moved OR dropped)
)"""
)
_PLUS = "CASE WHEN {x} >= 0 THEN '+' ELSE '' END, {y}"
CHANGE_DIGEST_RANKED = f"""{_RANKED}, {_SUMMARY}, told AS (SELECT summed.* EXCLUDE (scoring_changed), before IS NOT NULL AND NOT same_scoring AS scoring_changed FROM summed JOIN same USING (snapshot_date)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY snapshot_date, kind ORDER BY CASE kind WHEN 'price' THEN abs(pct) WHEN 'speed' THEN abs(pct) WHEN 'intelligence' THEN abs(delta) WHEN 'rank' THEN abs(coalesce(new, 99) - coalesce(old, 99)) WHEN 'new' THEN coalesce(composite, 0)
    WHEN 'frontier' THEN CASE direction WHEN 'entered' THEN 1 ELSE 0 END ELSE 0 END DESC, CASE kind WHEN 'frontier' THEN name END NULLS FIRST, model_id) AS place FROM every
), lines AS (
  SELECT snapshot_date, kind, place, CASE kind WHEN 'price' THEN 1 WHEN 'new' THEN 2 WHEN 'intelligence' THEN 3 WHEN 'rank' THEN 4 WHEN 'frontier' THEN 4 WHEN 'removed' THEN 5 ELSE 6 END AS section_no,
    CASE kind WHEN 'price' THEN concat(name, ': ', {_LABEL.format(x="old")}, ' -> ', {_LABEL.format(x="new")}, ' (', {_PLUS.format(x="round_even(pct, 0)", y="CAST(CAST(round_even(pct, 0) AS INTEGER) AS VARCHAR)")}, '%, ', direction, ')')
      WHEN 'new' THEN concat(name, ': intelligence ', CAST(new AS VARCHAR), ', price ', {_LABEL.format(x="price")}, ', deal ', coalesce(CAST(composite AS VARCHAR), 'None'))
      WHEN 'intelligence' THEN concat(name, ': ', CAST(old AS VARCHAR), ' -> ', CAST(new AS VARCHAR), ' (', {_PLUS.format(x="delta", y="printf('%.1f', delta)")}, ' pts, ', direction, ')')
      WHEN 'rank' THEN concat(name, ': #', CAST(CAST(old AS INTEGER) AS VARCHAR), ' -> ', CASE WHEN new IS NULL THEN 'out' ELSE concat('#', CAST(CAST(new AS INTEGER) AS VARCHAR)) END, ' (', CASE direction WHEN 'entered_top' THEN 'entered top 10' WHEN 'left_top' THEN 'left top 10' ELSE direction END, ')')
      WHEN 'frontier' THEN concat(name, ': ', direction, ' the intelligence frontier')
      WHEN 'removed' THEN concat(name, ' (was intelligence ', CAST(old AS VARCHAR), ', ', {_LABEL.format(x="price")}, ')')
      ELSE concat(name, ': ', CAST(CAST(old AS INTEGER) AS VARCHAR), ' -> ', CAST(CAST(new AS INTEGER) AS VARCHAR), ' t/s (', {_PLUS.format(x="round_even(pct, 0)", y="CAST(CAST(round_even(pct, 0) AS INTEGER) AS VARCHAR)")}, '%)') END AS line
  FROM ordered WHERE kind <> 'speed' OR place <= 5
), numbered AS (SELECT snapshot_date, section_no, CAST(row_number() OVER (PARTITION BY snapshot_date, section_no ORDER BY kind = 'frontier', place) AS INTEGER) AS place, line FROM lines
), sections(section_no, section) AS (VALUES (1, 'PRICE CHANGES'), (2, 'NEW MODELS'), (3, 'INTELLIGENCE CHANGES'), (4, 'RANK / FRONTIER MOVES'), (5, 'REMOVED MODELS'), (6, 'SPEED CHANGES')
), best AS (SELECT s.*, CAST(row_number() OVER (PARTITION BY s.snapshot_date ORDER BY frontier_rank_intel NULLS LAST, comp DESC NULLS LAST, coalesce(s.intelligence_score, 0) DESC, s.model_id) AS INTEGER) AS place FROM s LEFT JOIN f ON f.snapshot_date = s.snapshot_date AND f.model_id = s.model_id)
SELECT d.snapshot_date, q.section_no, section, coalesce(place, 0) AS place, coalesce(line, 'none') AS line FROM told d CROSS JOIN sections q LEFT JOIN numbered l ON l.snapshot_date = d.snapshot_date AND l.section_no = q.section_no
UNION ALL SELECT snapshot_date, 7, 'TOP VALUE', place, concat(name, ', intelligence ', printf('%.1f', round(intelligence_score, 1)), ', ', {_LABEL.format(x="price")}, '/1M, deal ', printf('%.2f', round(comp, 2))) FROM best WHERE place <= 5
UNION ALL SELECT snapshot_date, 0, 'STATUS', 1, concat('Changes since ', coalesce(CAST(before AS VARCHAR), 'N/A'), '. Data quality: ', CASE WHEN data_quality = 'first_run' THEN 'ok' ELSE data_quality END,
  CASE WHEN sources_out <> '' THEN concat(', unavailable sources: ', sources_out) ELSE '' END, '.', CASE WHEN before IS NULL THEN ' First snapshot.' ELSE '' END, CASE WHEN scoring_changed THEN ' Scoring changed: no rank and frontier moves.' ELSE '' END) FROM told"""
DATES["change_digest_ranked"] = ("snapshot_date",)

MEMBER_LOOKUP = f"WITH {_ELIGIBLE} SELECT band, CAST(place AS INTEGER) AS place, model_id, name, round(price, 6) AS price, composite_deal_score FROM m WHERE place <= 8"

BRIEF_SEED = f"""WITH {_ELIGIBLE} SELECT CAST(CASE band WHEN 'flagship' THEN 0 WHEN 'workhorse' THEN 1 ELSE 2 END AS INTEGER) AS band_order, model_id, name, composite_deal_score FROM m
WHERE gated_in AND gate_place = 1 OR place = 1 AND NOT EXISTS (SELECT 1 FROM m g WHERE g.band = m.band AND g.gated_in)"""

HERO_AND_RUNNERS_UP = f"""WITH RECURSIVE {_BOTH} SELECT model_id, arena_composite_score, frontier_rank AS frontier_rank_arena FROM scored LEFT JOIN f_arena USING (model_id)
WHERE CASE WHEN EXISTS (SELECT 1 FROM f_arena) THEN frontier_rank IS NOT NULL ELSE arena_composite_score IS NOT NULL AND gated_in END
ORDER BY frontier_rank NULLS LAST, arena_composite_score DESC NULLS LAST, composite_deal_score DESC NULLS LAST, coalesce(intelligence_score, 0) DESC, model_id LIMIT 4"""

CHART_ORDER = f"WITH RECURSIVE {_BOTH} SELECT model_id, round(price, 6) AS price, CAST(row_number() OVER (ORDER BY price, model_id) AS BIGINT) AS step FROM f_arena"

SNAPSHOT_ON = f"WITH raw AS ({SNAP}) SELECT model_id, intelligence_score, price FROM raw WHERE snapshot_date = DATE '1995-01-01'"

ENDPOINT_UPTIMES = """WITH u AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS uptime_30m, max(CASE WHEN event_type = 'view' THEN value END) AS uptime_1d FROM events WHERE user_id % 7 > 0 GROUP BY user_id),
i AS (SELECT user_id, event_id AS ingest_seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id % 10 = 0)
SELECT concat('u', i.user_id) AS item_id, ingest_seq, CASE WHEN n = 1 THEN uptime_30m END AS uptime_30m, CASE WHEN n = 1 THEN uptime_1d END AS uptime_1d FROM i LEFT JOIN u USING (user_id)"""

HISTORY_DAYS = TREND_DAYS.replace("SELECT snapshot_date, priced", "SELECT snapshot_date, priced", 1) + """ UNION ALL SELECT DATE '1990-01-01', 0, v, NULL, NULL, 0 FROM (VALUES ('25'), ('40'), ('50')) e(v)"""
DATES["history_days"] = ("snapshot_date",)

REJECTED_RECORDS = f"""WITH raws AS ({RAWS}), r AS (SELECT CASE WHEN price_input IS NULL THEN 'no price' WHEN price_input > 300000 THEN 'too dear' WHEN creator LIKE '%7' THEN 'creator' END AS reason FROM raws)
SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM r GROUP BY ALL"""

SOURCE_UNION = """WITH a AS (SELECT concat('part ', p_partkey) AS name, CAST(p_retailprice AS DOUBLE) AS price, row_number() OVER (ORDER BY p_brand, p_partkey) AS ingest_seq FROM part),
b AS (SELECT concat('supplier ', s_suppkey) AS name, NULL::DOUBLE AS price, 2 * 4503599627370496 + row_number() OVER (ORDER BY s_suppkey) AS ingest_seq FROM supplier) SELECT * FROM a UNION ALL SELECT * FROM b"""

PAGE_SLUGS = """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hrefs FROM pages), s AS (SELECT page_id, list_filter(list_transform(list_filter(hrefs, lambda h: NOT contains(h, 'the')), lambda h: regexp_extract(h, '^/([^/?#]+)', 1)), lambda x: x <> '') AS slugs FROM l)
SELECT page_id, slugs[1] AS slug FROM s WHERE len(slugs) > 0"""

HTML_LEADERBOARD = """SELECT p_partkey // 40 AS page_id, concat('p-', p_partkey) AS model_id, concat('Part ', p_partkey) AS name, p_brand AS creator, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 70 AS DOUBLE) END AS intelligence_score,
  CAST(p_partkey % 90 AS DOUBLE) AS price_blended, CAST(p_partkey % 30 * 1000 AS BIGINT) AS context_window_k FROM part"""

FAQ_ITEMS = """SELECT p_partkey // 40 AS page_id, concat('part-', p_partkey) AS model_id, concat('Part ', p_partkey) AS name, CAST(p_partkey % 70 AS DOUBLE) AS intelligence_score FROM part"""

MERGED_LISTS = f"""WITH raws AS ({RAWS}), r AS (SELECT *, concat('cust-', regexp_extract(name, '#0*([1-9][0-9]*)', 1)) AS k, CASE source WHEN 'leaderboard' THEN 0 WHEN 'coding' THEN 1 WHEN 'arena-text' THEN 3 WHEN 'openrouter' THEN 5 ELSE 50 END AS prio FROM raws)
SELECT k, coalesce(arg_min(concat('in-', ingest_seq % 4, CASE WHEN ingest_seq % 3 = 0 THEN ',text' ELSE '' END), prio::BIGINT * 1000000000 + ingest_seq) FILTER (ingest_seq % 5 > 0), '') AS modalities FROM r GROUP BY k"""

THIN_DAYS = f"WITH {_DAYS} SELECT snapshot_date, CAST(threshold AS VARCHAR) AS threshold, n, n < 3 AS low FROM days"
DATES["thin_days"] = ("snapshot_date",)

PRICE_QUANTILES = f"""WITH cat AS ({CAT}), f AS (UNPIVOT (SELECT price_blended, price_input, price_output FROM cat) ON price_blended, price_input, price_output INTO NAME field VALUE v)
SELECT field, part, round(CASE part WHEN 0.1 THEN quantile_cont(v, 0.1) WHEN 0.5 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.95) END, 6) AS value FROM f, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) q(part) WHERE v > 0 GROUP BY field, part"""

SNAPSHOT_DOCUMENTS = f"""WITH {_EVENTS}, m AS (SELECT snapshot_date, count(*) AS total_models, round(sum(price), 3) AS price, CAST(ceil(count(*) / 100) AS BIGINT) AS model_parts, arg_max(model_id, (intelligence_score, model_id)) AS hero FROM snap GROUP BY snapshot_date),
e AS (SELECT snapshot_date, count(*) AS total_events, CAST(ceil(count(*) / 100) AS BIGINT) AS event_parts, round(sum(new), 3) AS news FROM ev GROUP BY snapshot_date), {_SUMMARY}
SELECT m.snapshot_date, total_models, coalesce(total_events, 0) AS total_events, model_parts, coalesce(event_parts, 0) AS event_parts, hero, price, news, data_quality, total_models AS read_models, least(total_models, 100) AS largest_document
FROM m LEFT JOIN e USING (snapshot_date) JOIN summed USING (snapshot_date)"""
DATES["snapshot_documents"] = ("snapshot_date",)


def _day_catalog(n: int, where: str) -> str:
    """CTE c<n>: the merged, scored catalog of the records that a day has; records of the first source arrive first."""
    order = "prio::BIGINT * 1000000000000000 + seen"
    first = lambda c: f"arg_min({c}, {order}) FILTER ({c} IS NOT NULL) AS {c}"
    return f"""r{n} AS (SELECT * EXCLUDE (price_input), price_input / 100000 AS price_input, CASE WHEN source IN ('leaderboard', 'coding') THEN 0 ELSE 1000000000000 END + ingest_seq AS seen,
    CASE source WHEN 'leaderboard' THEN 0 WHEN 'coding' THEN 1 WHEN 'arena-text' THEN 3 WHEN 'openrouter' THEN 5 ELSE 50 END AS prio,
    trim(regexp_replace(lower(regexp_replace(regexp_replace(name, ' \\(Nov 24\\)', ''), ' v1\\.2', '')), '[^a-z0-9 ]', '', 'g')) AS norm FROM raws WHERE {where}
  ), f{n} AS (SELECT norm, arg_min(model_id, seen) AS id FROM r{n} GROUP BY norm
  ), g{n} AS (SELECT r.*, CASE WHEN regexp_matches(id, '[a-z]') THEN id ELSE replace(norm, ' ', '-') END AS slug FROM r{n} r JOIN f{n} USING (norm)
  ), m{n} AS (SELECT slug AS model_id, {first("price_input")}, {first("intelligence_score")} FROM g{n} GROUP BY slug
  ), v{n} AS (SELECT *, CASE WHEN price_input IS NOT NULL THEN round(intelligence_score / greatest(price_input, 0.05), 4) END AS value_score FROM m{n}
  ), c{n} AS (SELECT *, CASE WHEN value_score IS NOT NULL THEN round(0.5 * {_leg("value_score", 5.0, 500.0)} + 0.3 * 0.5 + 0.2 * 0.5, 4) END AS comp FROM v{n})"""


DAILY_RUN = f"""WITH raws AS ({RAWS}), {_day_catalog(1, "ingest_seq % 4 < 3")}, {_day_catalog(2, "ingest_seq % 5 > 0")}, b AS (
  SELECT *, CASE WHEN intelligence_score >= 40 THEN 'flagship' WHEN intelligence_score >= 25 THEN 'workhorse' ELSE 'budget' END AS band FROM c2 WHERE comp IS NOT NULL
), p AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY comp DESC, intelligence_score DESC, model_id) AS place FROM b
), j AS (SELECT coalesce(t.model_id, p.model_id) AS model_id, t.model_id IS NOT NULL AS has_t, p.model_id IS NOT NULL AS has_p, t.price_input AS tp, p.price_input AS pp, t.intelligence_score AS ti, p.intelligence_score AS pi FROM c2 t FULL OUTER JOIN c1 p ON t.model_id = p.model_id
), e AS (
  SELECT 'new' AS what FROM j WHERE NOT has_p UNION ALL SELECT 'price' FROM j WHERE tp <> 0 AND pp > 0 AND abs((tp - pp) / pp) >= 0.05 UNION ALL SELECT 'intelligence' FROM j WHERE abs(ti - pi) >= 0.5
  UNION ALL SELECT 'removed' FROM j WHERE NOT has_t AND (SELECT count(*) FROM j WHERE NOT has_t) <= greatest(20, floor(0.05 * (SELECT count(*) FROM c1))))
SELECT band AS what, count(*) AS n, max(model_id) FILTER (place = 1) AS id FROM p GROUP BY band UNION ALL SELECT what, count(*), NULL FROM e GROUP BY what"""
