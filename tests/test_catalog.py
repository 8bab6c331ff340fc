"""Catalog operators on small frames and against brute force."""

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from pricelens.functions import cells, names, pricing
from pricelens.operators import bands, changes, resolve, scoring, skyline, trends
from pricelens.sources import landed, store

PRICES = "id int, price_blended double, price_input double, price_output double, openrouter_price_input double, openrouter_price_output double"


def values(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_price_ladder(spark):
    rows = [(1, None, None, None, 0.3, 1.2), (2, 0.0, 0.4, 1.0, None, None), (3, 2.5, 1.0, 1.0, None, None), (4, None, 0.9, None, None, None), (5, None, 1.0, 4.0, None, None), (6, None, None, 5.0, None, None), (7, None, None, None, None, None), (8, 0.0, None, None, None, None), (9, None, 0.0, None, None, None)]
    got = dict(values(spark.createDataFrame(rows, PRICES), "id", pricing.effective_price()))
    assert {k: v if v is None else round(v, 9) for k, v in got.items()} == {1: 0.6, 2: 0.6, 3: 2.5, 4: 0.9, 5: 2.0, 6: None, 7: None, 8: None, 9: 0.0}


def test_floor_gate_and_log(spark):
    one = spark.createDataFrame([(14.0, 1 / 60, None, 37.0)], "q double, p double, none double, x double")
    assert one.select(pricing.value_ratio("q", F.col("p"))).first()[0] == 280.0
    got = one.select(*[scoring.normalize_log(c, (5.0, 500.0)) for c in ("x", "none", "q")]).first()
    assert got[0] == pytest.approx(0.435, abs=1e-3) and got[1] == 0.5
    rows = spark.createDataFrame([(None, None), (95.0, None), (92.65, None), (90.0, 99.0)], "uptime_30m double, uptime_1d double")
    assert [r[0] for r in rows.select(scoring.passes_gate()).collect()] == [True, True, False, True]


def test_names_and_sizes(spark):
    rows = spark.createDataFrame([("GPT-5.5 (xhigh)",), ("claude-3-7-sonnet-20250219",), ("DeepSeek V3.1",), ("x/Qwen 7B A2B",), ("Big 70B",), ("Flash (medium)",), ("A mini",)], "n string")
    assert values(rows, names.normalised_name("n"))[:3] == [("gpt 5 5 xhigh",), ("claude 3 7 sonnet",), ("deepseek",)]
    assert [t for _, t in values(rows, names.param_billions("n"), names.size_tier("n"))] == ["unknown", "unknown", "unknown", "small", "large", "unknown", "small"]
    assert values(rows.limit(1), names.provider_name(F.lit("Mistralai/x")), names.provider_name(F.lit("none/x"))) == [("Mistral", None)]


def test_cells(spark):
    rows = spark.createDataFrame([("1502±4",), ("1567+10/-10",), ("1400 Preliminary",), ("x",)], "c string").select(cells.score("c").alias("s")).select("s.*")
    assert values(rows, "score", "ci") == [(1502, 4), (1567, 10), (1400, None), (None, None)]
    one = spark.createDataFrame([('[GPT (codex-harness)](http://x "gpt-5") OpenVendor · MIT', "$5 / $25", "1m", "inf", "1,234.5%")], "a string, b string, c string, d string, e string")
    got = one.select(cells.linked_name("a").alias("n"), cells.prices("b").alias("p"), cells.context_k("c").alias("c"), cells.number("d").alias("d"), cells.number("e").alias("e")).first()
    assert tuple(got.n) == ("GPT", "gpt-5", "OpenVendor") and tuple(got.p) == (5.0, 25.0) and got.c == 1000 and got.d is None and got.e == 1234.5


def brute_frontier(points):
    return {p for p in points if not any(o[0] <= p[0] and o[1] >= p[1] and (o[0] < p[0] or o[1] > p[1]) for o in points)}


def test_pareto_matches_brute_force_by_group(spark):
    draw = random.Random(1)
    rows = [(draw.choice("ab"), i, round(10 ** draw.uniform(-2, 2), 2), float(draw.randint(0, 60))) for i in range(600)] + [(None, 1, 1.0, 1.0), ("a", 2, 0.0, 99.0), ("a", 3, 1.0, None)]
    frame = spark.createDataFrame(rows, "g string, i int, p double, q double")
    got = {(r.g, r.p, r.q) for r in skyline.pareto(frame, "p", "q", ("g",)).collect()}
    want = {(g, *x) for g in ("a", "b", None) for x in brute_frontier([(p, q) for h, _, p, q in rows if h == g and p > 0 and q is not None])}
    assert got == want


def test_near_repeats_go_and_knee_ranks(spark):
    schema = "model_id string, name string, price double, quality double, s double"
    near = spark.createDataFrame([("a", "a", 1.0, 40.0, 0.5), ("b", "b", 10**0.01, 40.2, 0.9), ("c", "c", 10.0, 55.0, 0.1), ("d", "d", 10.0, 55.0, 0.2)], schema)
    got = skyline.collapse_near(near, "price", "quality", 0.5, "s", "name")
    assert {r.model_id for r in got.collect()} == {"a", "d"}
    knee = skyline.frontier_scores(spark.createDataFrame([("a", "a", 0.02, 14.0, 0.0), ("b", "b", 0.13, 40.0, 0.0), ("c", "c", 23.0, 60.0, 0.0)], schema), "price", "quality", "name")
    assert {r.model_id: r.frontier_rank for r in knee.collect()} == {"b": 1, "a": 2, "c": 3}
    assert [r.frontier_score for r in skyline.frontier_scores(near.limit(1), "price", "quality", "name").collect()] == [0.0]


def test_bands_leader_cheapest_and_thresholds(spark):
    schema = "model_id string, name string, intelligence_score double, composite_deal_score double, price double, uptime_30m double, uptime_1d double"
    rows = [("a", "a", 45.0, 0.9, 0.1, 90.0, None), ("b", "b", 41.0, 0.7, 2.0, 99.0, None), ("c", "c", 37.0, 0.5, 0.187, None, None), ("z", "z", 30.0, None, 1.0, None, None), ("n", "n", -1.0, 0.5, 1.0, None, None)]
    got = {r.band: r for r in bands.band_leaderboard(spark.createDataFrame(rows, schema)).collect()}
    assert (got["flagship"].leader_id, got["flagship"].cheapest_id, got["flagship"].n) == ("b", "a", 2)
    assert got["budget"].n == 0 and got["budget"].member_ids == [] and got["workhorse"].member_ids == ["c"]
    above = {r.threshold: r.model_id for r in bands.cheapest_above(spark.createDataFrame(rows[1:], schema)).collect()}
    assert above == {25.0: "c", 40.0: "b", 50.0: None}


def day(n):
    return datetime.date(2026, 1, 1) + datetime.timedelta(days=n)


def test_trends(spark):
    schema = "snapshot_date date, model_id string, name string, intelligence_score double, price double"
    one = spark.createDataFrame([(day(0), str(i), "n", q, p) for i, (q, p) in enumerate([(45.0, 2.0), (42.0, 0.5), (30.0, 0.1), (10.0, 0.01), (50.0, 0.0)])] + [(day(3), "x", "n", None, 1.0)], schema)
    got = {(r.snapshot_date, r.threshold): (r.cheapest, r.median, r.n, r.priced) for r in trends.trend_days(one).collect()}
    assert got[day(0), 40.0] == (0.5, 1.25, 2, 4) and got[day(0), 25.0][2] == 3 and got[day(3), 50.0] == (None, None, 0, 0)
    assert [r.gap for r in trends.day_gaps(one).orderBy("snapshot_date").collect()] == [False, True]
    long = spark.createDataFrame([(day(i), k, f"n{i}", 1.0, float(i + 1)) for k, n in (("few", 10), ("many", 200)) for i in range(n)], schema)
    series = trends.trend_series(long).collect()
    assert [(r.model_id, r.name, len(r.points), r.points[0].p, r.points[-1].p) for r in series] == [("many", "n199", 180, 21.0, 200.0)]


SNAP = "snapshot_date date, model_id string, name string, intelligence_score double, price double, output_speed_tps double, source_pages array<string>"


def snap(n, rows):
    return [(day(n), *r) for r in rows]


def test_change_thresholds_and_gaps(spark):
    before = [("p1", "p1", 45.0, 0.28, 100.0, ["a"]), ("p2", "p2", 45.0, 1.0, 100.0, ["a"]), ("gone", "g", 1.0, 1.0, 1.0, ["a"])]
    now = [("p1", "p1", 47.0, 0.21, 140.0, ["a"]), ("p2", "p2", 45.2, 0.99, 112.0, ["a"]), ("new", "n", 1.0, 1.0, 1.0, ["a"])]
    history = spark.createDataFrame(snap(0, before) + snap(5, now), SNAP)
    got = {(r.model_id, r.kind): (r.direction, r.pct, r.delta) for r in changes.change_events(history).collect()}
    assert got == {("p1", "price"): ("cut", -25.0, None), ("p1", "intelligence"): ("up", None, 2.0), ("p1", "speed"): ("up", 40.0, None), ("gone", "removed"): (None, None, None), ("new", "new"): (None, None, None)}
    assert {r.snapshot_date: r.data_quality for r in changes.change_summary(history).collect()} == {day(0): "first_run", day(5): "ok"}
    assert changes.churn(history).collect()[0].asDict() == {"snapshot_date": day(5), "n_before": 3, "n_now": 3, "common": 2, "added": 1, "removed": 1}


def test_outage_guards(spark):
    item = lambda i, s: (f"i{i}", "n", 1.0, 1.0, 1.0, [s])
    history = spark.createDataFrame(snap(0, [item(i, "one") for i in range(300)] + [item(999, "two")]) + snap(1, [item(999, "two")]), SNAP)
    assert changes.change_events(history).count() == 0
    assert [r.data_quality for r in changes.change_summary(history).orderBy("snapshot_date").collect()] == ["first_run", "partial"]
    many = spark.createDataFrame(snap(0, [item(i, f"s{i % 5}") for i in range(500)]) + snap(1, [item(i, f"s{i % 5}") for i in range(400)]), SNAP)
    assert changes.change_events(many).count() == 0
    assert [r.data_quality for r in changes.change_summary(many).orderBy("snapshot_date").collect()] == ["first_run", "degraded"]


def test_a_gone_item_of_the_top_ten_has_left_it(spark):
    """m3 has no row today; under another scoring version there are no rank events at all."""
    day = lambda n: datetime.date(2026, 1, 1 + n)
    today = [m for m in ("m%d" % i for i in range(1, 14)) if m != "m3"]
    schema = "snapshot_date date, model_id string, name string, intelligence_score double, price double, output_speed_tps double, source_pages array<string>, frontier_rank_intel int, is_frontier_intel boolean, scoring_version int"
    for version in (2, 3):
        rows = [(day(0), f"m{i}", f"m{i}", 1.0, 1.0, 1.0, ["a"], i, True, 2) for i in range(1, 13)]
        rows += [(day(1), m, m, 1.0, 1.0, 1.0, ["a"], i + 1, True, version) for i, m in enumerate(today)]
        got = {(r.model_id, r.kind): (r.direction, r.old, r.new) for r in changes.change_events(spark.createDataFrame(rows, schema)).collect()}
        want = {("m3", "removed"): (None, 1.0, None), ("m13", "new"): (None, None, 1.0)}
        if version == 2:
            want |= {("m3", "rank"): ("left_top", 3.0, None), ("m11", "rank"): ("entered_top", 11.0, 10.0)}
        assert got == want


def test_digest_has_all_sections_on_quiet_days_too(spark):
    day = lambda n: datetime.date(2026, 1, 1 + n)
    rows = [(day(n), "a", "Model A", 40.0, p, s, ["x"]) for n, p, s in ((0, 0.5, 10.0), (1, 0.5, 10.0), (2, 2.0, 20.0))] + [(day(2), "b", "Model B", 30.5, 1.25, 1.0, ["x"])]
    rows = spark.createDataFrame(rows, "snapshot_date date, model_id string, name string, intelligence_score double, price double, output_speed_tps double, source_pages array<string>")
    found = changes.digest(changes.change_events(rows), changes.change_summary(rows)).orderBy("snapshot_date", "section_no", "place").collect()
    by_day = {n: [r.line for r in found if r.snapshot_date == day(n)] for n in range(3)}
    assert by_day[0] == ["Changes since N/A. Data quality: ok. First snapshot.", *["none"] * 6]
    assert by_day[1] == ["Changes since 2026-01-01. Data quality: ok.", *["none"] * 6]
    assert by_day[2] == ["Changes since 2026-01-02. Data quality: ok.", "Model A: $0.500 -> $2.00 (+300%, hike)", "Model B: intelligence 30.5, price $1.25, deal None", "none", "none", "none", "Model A: 10 -> 20 t/s (+100%)"]
    assert [r.section for r in found[:7]] == ["STATUS", *[name for name, _ in changes.SECTIONS]]


def test_rank_moves(spark):
    order = [["m%d" % i for i in range(1, 13)], "m1 m2 m4 m6 m7 m5 m8 m12 m9 m10 m11".split()]
    rows = [(day(n), m, m, 1.0, 1.0, 1.0, ["a"], i + 1, True) for n, ms in enumerate(order) for i, m in enumerate(ms)] + [(day(1), "m3", "m3", 1.0, 1.0, 1.0, ["a"], None, False)]
    history = spark.createDataFrame(rows, SNAP + ", frontier_rank_intel int, is_frontier_intel boolean")
    got = {(r.model_id, r.kind): r.direction for r in changes.change_events(history).collect()}
    assert got[("m12", "rank")] == "entered_top" and got[("m3", "rank")] == "left_top" and ("m5", "rank") not in got and got[("m3", "frontier")] == "left"
    other = history.withColumn("scoring_version", F.when(F.col("snapshot_date") == F.lit(day(1)), 2))
    assert changes.change_events(other).where("kind in ('rank', 'frontier')").count() == 0


@pytest.mark.parametrize("with_column", [True, False])
def test_rank_moves_of_snapshots_without_ranks(spark, with_column):
    """Older snapshots are ordered by the composite score of the frontier tier; the one with ranks by those."""
    order = [["m%d" % i for i in range(1, 13)], "m1 m2 m4 m6 m7 m5 m8 m12 m9 m10 m11 m3".split()]
    rows = [(day(n), m, m, 1.0, 1.0, 1.0, ["a"], 100.0 - i, "frontier") for n, ms in enumerate(order) for i, m in enumerate(ms)]
    rows += [(day(n), "x%d" % i, "x", 1.0, 1.0, 1.0, ["a"], score, tier) for n in (0, 1) for i, (score, tier) in enumerate([(999.0, "large"), (None, "frontier")])]
    history = spark.createDataFrame(rows, SNAP + ", composite_deal_score double, size_tier string")
    if with_column:  # a third snapshot, as the second one, but ranked; its scores say otherwise
        last = [(day(2), m, m, 1.0, 1.0, 1.0, ["a"], float(i), "frontier", i + 1) for i, m in enumerate(order[1])]
        history = history.withColumn("frontier_rank_intel", F.lit(None).cast("int")).unionByName(spark.createDataFrame(last, SNAP + ", composite_deal_score double, size_tier string, frontier_rank_intel int")).withColumn("is_frontier_intel", F.lit(False))
    got = {(r.snapshot_date, r.model_id): r.direction for r in changes.change_events(history).where("kind = 'rank'").collect()}
    assert got == {(day(1), "m12"): "entered_top", (day(1), "m3"): "down"}


RAW = "ingest_seq long, model_id string, name string, source_pages array<string>, price double, tags array<string>"


def test_entities_and_priorities(spark):
    rows = [(1, "gpt-5", "GPT 5", ["openrouter"], 9.0, []), (2, "777", "gpt-5 (Nov '24)", ["leaderboard"], None, ["x"]), (3, "888", "GPT 5 (high)", ["coding"], 2.0, []), (4, "999", "Zzz unique", [], 1.0, []), (5, "b", "gpt 5", ["coding"], 4.0, ["y"])]
    slugged = resolve.canonical_slugs(spark.createDataFrame(rows, RAW), fuzzy=False)
    assert {r.ingest_seq: r.slug for r in slugged.collect()} == {1: "gpt-5", 2: "gpt-5", 3: "gpt-5-high", 4: "zzz-unique", 5: "gpt-5"}
    got = {r.slug: r for r in resolve.coalesce_fields(slugged, ("price",), ("tags",)).collect()}["gpt-5"]
    assert (got.price, got.tags, got["name"], got.source_pages) == (4.0, ["x"], "gpt-5 (Nov '24)", ["leaderboard", "coding", "openrouter"])


def plain_slugs(rows):
    """The reference's resolution, one record after the other; names are their own keys."""
    known, out = {}, {}
    for seq, model_id, name in rows:
        if name not in known:
            near = difflib.get_close_matches(name, list(known), 1, 0.82)
            known[name] = model_id if any(c.islower() for c in model_id) else known[near[0]] if near else name.replace(" ", "-")
        out[seq] = known[name]
    return out


def test_chains_of_open_names_end_in_one_entity(spark):
    chain = ["abcdefghij", "abcdefghixy", "abcdefghixyzw", "abcdefghixyzwqrst", "abcdefghixyzwqrstuvmno"]
    draw = random.Random(6)
    others = ["".join(draw.choices("klmnop", k=draw.randint(6, 14))) for _ in range(30)]
    others += [o[:-1] + draw.choice("klmnop") for o in others for _ in range(3)]
    rows = [(i, "slug%d" % i if i > 4 and i % 4 == 0 else str(i), n) for i, n in enumerate(chain + others)]
    frame = spark.createDataFrame([(*r, ["coding"], None, []) for r in rows], RAW)
    got = {r.ingest_seq: r.slug for r in resolve.canonical_slugs(frame).collect()}
    assert got == plain_slugs(rows) and {got[i] for i in range(5)} == {chain[0]}


def test_whole_merge_is_registered(spark):
    from pricelens.plans import registry, views

    sf = "/root/testdata/sf0.001"
    first = {}
    for r in views.records(spark, sf).select("ingest_seq", "model_id", resolve.normalised_name("name").alias("norm")).orderBy("ingest_seq").collect():
        first.setdefault(r.norm, (r.ingest_seq, r.model_id, r.norm))
    assert {r.slug for r in registry.QUERIES["merged_catalog_fuzzy"](spark, sf).collect()} == set(plain_slugs(first.values()).values())


@pytest.mark.parametrize("short, long", [(45, 64), (89, 128), (90, 128), (90, 129), (127, 182)])
def test_fuzzy_matches_of_far_lengths(spark, short, long):
    word = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz", k=long))
    pair = [word[:short], word]
    assert difflib.get_close_matches(word, pair[:1], 1, 0.82)
    frame = spark.createDataFrame([(n, i, True) for i, n in enumerate(pair)], "norm string, first_seen long, open boolean")
    assert [tuple(r) for r in resolve.fuzzy_matches(frame).select("norm", "match").collect()] == [(word, word[:short])]


def test_fuzzy_matches_equal_all_pairs(spark):
    draw = random.Random(4)
    base = ["".join(draw.choices("abcde ", k=draw.randint(5, 16))).strip() or "a" for _ in range(120)]
    names_ = list(dict.fromkeys(base + [b[:2] + b[3:] for b in base if len(b) > 5]))
    frame = spark.createDataFrame([(n, i, True) for i, n in enumerate(names_)], "norm string, first_seen long, open boolean")
    got = {r["norm"]: r.match for r in resolve.fuzzy_matches(frame).collect()}
    want = {n: m[0] for i, n in enumerate(names_) if (m := difflib.get_close_matches(n, names_[:i], 1, 0.82))}
    assert got == want


def test_store_and_drifting_history(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    history = spark.createDataFrame(snap(0, [("a", "a", 1.0, 1.0, 1.0, ["s"])]) + snap(2, [("b", "b", 1.0, 1.0, 1.0, ["s"])]), SNAP)
    store.write_snapshots(history, folder)
    store.write_snapshots(history.where("model_id = 'b'").withColumn("model_id", F.lit("c")), folder)
    back = store.read_snapshots(spark, folder)
    assert {r.model_id for r in back.collect()} == {"a", "c"} and {r.model_id for r in store.latest(back).collect()} == {"c"}
    assert {r.model_id for r in store.previous_snapshot(back, "2026-01-03").collect()} == {"a"} and store.previous_snapshot(back, "2026-01-01").count() == 0
    (tmp_path / "h").mkdir()
    (tmp_path / "h/2026-01-01.json").write_text('{"date": "2026-01-01", "models": [{"name": "x", "openrouter_price_input": 1.0, "odd": 3}]}\n')
    (tmp_path / "h/2026-01-02.json").write_text('{"date": "2026-01-02", "models": [{"na\n')
    (tmp_path / "h/2026-01-03.json").write_text('{"models": [{"name": "y"}]}\n')
    got = landed.read_history(spark, f"file://{tmp_path}/h").collect()
    assert [(str(r.snapshot_date), r["name"], r.model_id, r.source_pages, r.openrouter_price_input) for r in got] == [("2026-01-01", "x", None, [], 1.0)]


def test_landed_tables(spark):
    md = "# Board\n| Rank | Model | Score | Price | Votes | Context |\n|---|---|---|---|---|---|\n| 1 | [GPT](u \"gpt\") Vendor · MIT | 1502±4 | $5 / $25 | 1,000 | 1M |\n| 2 | Plain Name | 1400 | N/A | 10 | 8K |\nend\n| 3 | no |"
    got = landed.markdown_leaderboard(spark.createDataFrame([(1, md), (2, "nothing")], "doc_id int, body string")).orderBy("place").collect()
    assert [(r.model_id, r.score, r.ci, r.price_input, r.price_output, r.votes, r.context_k) for r in got] == [("gpt", 1502, 4, 5.0, 25.0, 1000, 1000), ("plain-name", 1400, None, None, None, 10, 8)]
    api = '{"data":[{"id":"openai/x","name":"X","context_length":128000,"pricing":{"prompt":"0.000001","completion":"0.000002"}},{"id":"free/y","pricing":{"prompt":"0"}},{"id":"bad/z","pricing":{"prompt":"oops"}},{"id":" "}]}'
    assert [tuple(r) for r in landed.api_items(spark.createDataFrame([(api,)], "body string")).collect()] == [("openai/x", "X", "OpenAI", 1.0, 2.0, 128)]
    page = '<table><tr><th>Model</th><th>Creator</th><th>Intelligence Index</th><th>Blended price</th></tr><tr><td><a href="/models/gpt-x">GPT X</a></td><td>Acme.svg</td><td>60</td><td>$1.5</td></tr></table><script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"acceptedAnswer":{"text":"are: 1. Alpha (xhigh) (60), 2. Beta (55)"}}]}</script>'
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    table, faq = landed.html_leaderboard(pages), landed.faq_items(pages)
    assert [(r.model_id, r["name"], r.creator, r.intelligence_score, r.price_blended) for r in table.collect()] == [("gpt-x", "GPT X", "Acme", 60.0, 1.5)]
    assert {(r.model_id, r.intelligence_score) for r in faq.collect()} == {("alpha-xhigh", 60.0), ("beta", 55.0)}
    assert landed.with_faq_where_short(table, faq).count() == 3
    both = landed.union_sources([(table, ["model_id"]), (None, []), (faq, ["model_id"])])
    assert both.select("ingest_seq").distinct().count() == 3


def test_plans_stay_distributed(spark):
    """No window over all rows in one task, no product, no Python but where it is meant."""
    from pricelens.plans import registry

    for name in ("best_value_frontier", "band_leaderboard", "cheapest_above", "trend_days", "churn", "merged_catalog", "composite_scores"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan, name
