"""Every catalog query with its SQL oracle: thin bindings of operators to the given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.functions import cells, names, pricing
from pricelens.operators import bands, changes, ranges, reports, resolve, scoring, skyline, trends
from pricelens.plans import daily, oracles, views
from pricelens.sources import landed, store

FLAGSHIP = "best_value_frontier"
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable) -> Callable:
    """Registers a query and its oracle. Dates leave both as ISO text, which all clients read alike."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(spark, sf_dir)
        return out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "date"})

    QUERIES[f.__name__] = run
    if sql := getattr(oracles, f.__name__.upper(), None):
        ORACLES[f.__name__] = oracles.with_text_dates(f.__name__, sql)
    return run


def scored(spark, sf_dir) -> DataFrame:
    return scoring.score_catalog(views.catalog(spark, sf_dir))


def ranked_snapshots(spark, sf_dir) -> DataFrame:
    """Yearly snapshots with the frontier of each."""
    rows = views.snapshots(spark, sf_dir).withColumns({"value_score": pricing.value_ratio("intelligence_score", F.col("price"))})
    rows = scoring.with_missing(rows, {"coding_value": "double", "uptime_30m": "double", "uptime_1d": "double"})
    rows = rows.withColumn("composite_deal_score", scoring.composite("intel"))
    found = skyline.view_frontier(rows, "intel", ("snapshot_date",)).select("snapshot_date", "model_id", F.col("frontier_rank").alias("frontier_rank_intel"))
    return rows.join(found, ["snapshot_date", "model_id"], "left").withColumn("is_frontier_intel", F.col("frontier_rank_intel").isNotNull())


@query
def best_value_frontier(spark, sf_dir):
    return skyline.view_frontier(scored(spark, sf_dir), "intel").select("model_id", "name", F.round("price", 6).alias("price"), "quality", "frontier_score", "frontier_rank")


@query
def pareto_frontier_large(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") + F.col("o_orderkey") % 1000).alias("q"))
    return skyline.pareto(rows, "o_totalprice", "q")


@query
def effective_price(spark, sf_dir):
    price = pricing.effective_price()
    return views.catalog(spark, sf_dir).select("model_id", F.round(price, 6).alias("price"), F.round(pricing.scoring_price(price), 6).alias("scoring_price"), pricing.price_label(pricing.rounded(price, 3)).alias("label"))


@query
def composite_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("model_id", "value_score", "coding_value", "arena_value", "arena_coding_value", "composite_deal_score", "arena_composite_score", scoring.passes_gate().alias("gated_in"), scoring.is_deal_candidate("intel").alias("candidate"))


@query
def size_tiers(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat_ws(" ", F.col("p_name"), F.concat((F.col("p_size") * 1.5).cast("decimal(6,1)").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit("B")).otherwise(F.lit("x"))), F.when(F.col("p_partkey") % 3 == 0, F.lit("mini (large)")))
    return part.select("p_partkey", names.param_billions(name).alias("billions"), names.size_tier(name).alias("tier"))


@query
def normalised_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat(F.lit("vendor-x/"), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" (Nov '24)")).otherwise(F.lit(" (xhigh)")), F.when(F.col("p_partkey") % 3 == 0, F.lit(" V3.1 turbo")).otherwise(F.lit("-20250219")))
    key = names.normalised_name(name)
    return docs.select("p_partkey", key.alias("norm"), names.slug_of_key(key).alias("slug"), names.slug_of_name(name).alias("name_slug"), names.slug_of_path(name).alias("path_slug"))


@query
def ranked_catalog_top(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.orderBy(*scoring.rank_order()).limit(50).select("model_id", "composite_deal_score", "intelligence_score")


@query
def top_deals(spark, sf_dir):
    return scoring.top_deals(skyline.annotate_frontier(scored(spark, sf_dir)), 4).select("model_id", "composite_deal_score", "frontier_rank_intel")


@query
def frontier_flags(spark, sf_dir):
    flags = [f"{c}_{v}" for v in ("intel", "arena") for c in ("is_frontier", "frontier_rank", "frontier_score")]
    return skyline.annotate_frontier(scored(spark, sf_dir)).select("model_id", *flags)


@query
def leaderboard(spark, sf_dir):
    return reports.leaderboard(scored(spark, sf_dir), least_quality=20.0).select("model_id", "composite_deal_score", "size_tier")


@query
def band_leaderboard(spark, sf_dir):
    found = bands.band_leaderboard(scored(spark, sf_dir))
    return found.select("band", "label", "n", "leader_id", "cheapest_id", F.round("cheapest_price", 6).alias("cheapest_price"), F.concat_ws(",", "member_ids").alias("member_ids"))


@query
def band_members(spark, sf_dir):
    return bands.band_members(scored(spark, sf_dir))


@query
def cheapest_above(spark, sf_dir):
    return bands.cheapest_above(scored(spark, sf_dir), (*bands.THRESHOLDS, 1000.0))


@query
def trend_days(spark, sf_dir):
    days = trends.trend_days(views.history(spark, sf_dir))
    return days.select("snapshot_date", "priced", trends.threshold_key(F.col("threshold")).alias("threshold"), "cheapest", F.round("median", 7).alias("median"), "n")


@query
def trend_series(spark, sf_dir):
    found = trends.trend_series(views.history(spark, sf_dir))
    return found.select("model_id", "name", F.explode("points").alias("x")).select("model_id", "name", F.col("x.d").alias("d"), F.col("x.i").alias("i"), F.col("x.p").alias("p"))


@query
def trend_floor_change(spark, sf_dir):
    return trends.floor_change(trends.trend_days(views.history(spark, sf_dir)))


@query
def trend_gaps(spark, sf_dir):
    return trends.day_gaps(views.history(spark, sf_dir), step=30)


@query
def sparkline(spark, sf_dir):
    return trends.sparklines(trends.trend_series(views.history(spark, sf_dir)))


@query
def change_events(spark, sf_dir):
    return changes.change_events(views.snapshots(spark, sf_dir))


@query
def frontier_and_rank_events(spark, sf_dir):
    folder = store.scratch(spark)  # reports read written snapshots: ranks are computed once
    store.write_snapshots(ranked_snapshots(spark, sf_dir).drop("coding_value", "uptime_30m", "uptime_1d"), folder)
    return changes.change_events(store.read_snapshots(spark, folder)).where("kind in ('rank', 'frontier')").select("snapshot_date", "model_id", "kind", "direction", "old", "new")


@query
def change_counts(spark, sf_dir):
    return changes.change_counts(changes.change_events(views.snapshots(spark, sf_dir)))


@query
def change_digest(spark, sf_dir):
    tracked = changes.track(views.snapshots(spark, sf_dir))
    return changes.digest(changes.events_of(tracked), changes.summary_of(tracked))


@query
def change_digest_ranked(spark, sf_dir):
    """With frontiers, scores, the five best of each snapshot, and a scoring version that changes in some years."""
    rows = ranked_snapshots(spark, sf_dir).drop("coding_value", "uptime_30m", "uptime_1d")
    year = F.year("snapshot_date")
    rows = store.lineage_cut(rows.withColumn("scoring_version", F.when((year >= 1996) | (year % 2 == 0), 2)))
    tracked = changes.track(rows)
    return changes.digest(changes.events_of(tracked), changes.summary_of(tracked), top=changes.top_of_days(rows))


@query
def event_totals(spark, sf_dir):
    tracked = changes.track(views.snapshots(spark, sf_dir))
    return changes.event_totals(changes.events_of(tracked), changes.summary_of(tracked))


@query
def change_summary(spark, sf_dir):
    return changes.change_summary(views.snapshots(spark, sf_dir))


@query
def churn(spark, sf_dir):
    return changes.churn(views.snapshots(spark, sf_dir))


@query
def field_noise(spark, sf_dir):
    return changes.field_noise(views.snapshots(spark, sf_dir), ("intelligence_score", "price", "output_speed_tps"))


@query
def source_counts(spark, sf_dir):
    return changes.source_counts(views.snapshots(spark, sf_dir), "snapshot_date")


@query
def merged_catalog(spark, sf_dir):
    slugged = resolve.canonical_slugs(views.records(spark, sf_dir), fuzzy=False)
    merged = resolve.coalesce_fields(slugged, ("price_input", "intelligence_score", "creator"))
    return merged.withColumn("source_pages", F.concat_ws(",", "source_pages"))


@query
def merged_catalog_fuzzy(spark, sf_dir):
    """The whole merge: records without a slug of their own follow the most similar earlier name. No SQL can express that."""
    slugged = resolve.canonical_slugs(views.records(spark, sf_dir))
    merged = resolve.coalesce_fields(slugged, ("price_input", "intelligence_score", "creator"))
    return merged.withColumn("source_pages", F.concat_ws(",", "source_pages"))


@query
def fuzzy_names(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    base = part.groupBy(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("norm")).agg(F.min("p_partkey").alias("first_seen"))
    near = base.select(F.concat(F.substring("norm", 1, 3), F.expr("substring(norm, 5)")).alias("norm"), (F.col("first_seen") + 10**9).alias("first_seen"), F.lit(True).alias("open"))
    return resolve.fuzzy_matches(base.withColumn("open", F.lit(False)).unionByName(near).dropDuplicates(["norm"]))


@query
def page_links(spark, sf_dir):
    return landed.links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def event_props(spark, sf_dir):
    return landed.best_value(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "value", "event_type")


@query
def parsed_cells(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    score = F.when(k % 3 == 0, F.concat((1000 + k).cast("string"), F.lit("±"), (k % 9).cast("string"))).when(k % 3 == 1, F.concat((1000 + k).cast("string"), F.lit("+10/-"), (k % 7).cast("string"))).otherwise(F.concat((1000 + k).cast("string"), F.lit(" Preliminary")))
    price = F.when(k % 4 == 0, F.lit("N/A")).otherwise(F.concat(F.lit("$"), (k % 50).cast("string"), F.lit(" / $"), (k % 90).cast("string")))
    size = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("k"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("M"))).otherwise(F.lit("—"))
    return part.select("p_partkey", cells.score(score).alias("s"), cells.prices(price).alias("p"), cells.context_k(size).alias("context_k")).select("p_partkey", "s.score", "s.ci", "p.price_input", "p.price_output", "context_k")


@query
def coverage_profile(spark, sf_dir):
    return reports.coverage(views.catalog(spark, sf_dir), ("intelligence_score", "price_blended", "price_input", "openrouter_price_input", "uptime_30m", "arena_elo"))


@query
def score_histogram(spark, sf_dir):
    return reports.histogram(views.catalog(spark, sf_dir), "intelligence_score", 5.0)


@query
def score_percentiles(spark, sf_dir):
    found = reports.percentiles(views.catalog(spark, sf_dir), "intelligence_score", (0.25, 0.5, 0.9))
    return found.select(F.col("at").alias("part"), F.round("value", 6).alias("value"))


@query
def snapshot_roundtrip(spark, sf_dir):
    folder = store.scratch(spark)
    store.write_snapshots(views.snapshots(spark, sf_dir), folder)
    back = store.read_snapshots(spark, folder)
    return back.select("snapshot_date", "model_id", "intelligence_score", "price", F.concat_ws(",", "source_pages").alias("source_pages"))


@query
def snapshot_dates(spark, sf_dir):
    return store.manifest(views.snapshots(spark, sf_dir)).select("snapshot_date")


@query
def json_history_roundtrip(spark, sf_dir):
    folder = store.scratch(spark)
    store.export_json(views.snapshots(spark, sf_dir), folder)
    return landed.read_history(spark, folder).groupBy("snapshot_date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 3).alias("price"))


@query
def previous_snapshot(spark, sf_dir):
    rows = views.snapshots(spark, sf_dir)
    return store.previous_snapshot(rows, "2000-06-15").select("snapshot_date", "model_id", "price")


@query
def api_items(spark, sf_dir):
    """API documents of up to 50 items each, made of the parts, read back."""
    k = F.col("p_partkey")
    price = F.when(k % 7 == 0, F.lit("oops")).when(k % 7 == 1, F.lit("0")).otherwise((k % 90).cast("string"))
    maker = F.element_at(F.array(*map(F.lit, ("openai/", "Anthropic/", "z-ai/", "nobody/", "openai", "tülu3/"))), (k % 6 + 1).cast("int"))
    item = F.struct(F.concat(maker, F.lit("p"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), (k * 1000.0).alias("context_length"), F.struct(price.alias("prompt"), F.lit("0").alias("completion")).alias("pricing"))
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.floor(k / 50).alias("doc")).agg(F.collect_list(item).alias("data"))
    return landed.api_items(docs.select(F.to_json(F.struct("data")).alias("body")))


@query
def markdown_leaderboard(spark, sf_dir):
    """Ranking tables of up to 50 rows each, made of the parts, read back."""
    k = F.col("p_partkey")
    line = F.concat(F.lit("| "), k.cast("string"), F.lit(' | [Part '), k.cast("string"), F.lit('](http://x "p-'), k.cast("string"), F.lit('") '), F.col("p_brand"), F.lit(" · Open | "), (1000 + k % 700).cast("string"), F.lit("±"), (k % 9).cast("string"), F.lit(" | $1 / $"), (k % 30).cast("string"), F.lit(" |"))
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.floor(k / 50).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))).alias("all"))
    head = "# Ranking\n| Rank | Model | Score | Price |\n|---|---|---|---|\n"
    docs = rows.select("doc_id", F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\nend")).alias("body"))
    return landed.markdown_leaderboard(docs).select("model_id", "name", "creator", "score", "ci", "price_input", "price_output")


@query
def rescored_history(spark, sf_dir):
    """Every snapshot scored anew from its raw columns."""
    rows = views.snapshots(spark, sf_dir).withColumn("price_blended", F.col("price")).drop("price")
    return reports.rescore(rows, ("snapshot_date",)).select("snapshot_date", "model_id", "composite_deal_score", "frontier_rank_intel")


@query
def renamed_items(spark, sf_dir):
    """Removed and new items of one snapshot that carry the same name: every hundredth part has another id in odd years."""
    moved = (F.year("snapshot_date") % 2 == 1) & (F.substring("model_id", 2, 9).cast("int") % 100 == 0)
    rows = views.snapshots(spark, sf_dir).withColumn("model_id", F.when(moved, F.concat(F.col("model_id"), F.lit("b"))).otherwise(F.col("model_id")))
    return changes.renames(changes.arrivals(rows))


@query
def member_lookup(spark, sf_dir):
    """The members of each band as whole rows."""
    rows = store.lineage_cut(scored(spark, sf_dir))
    return bands.member_rows(bands.band_leaderboard(rows), rows).select("band", "place", "model_id", "name", F.round("price", 6).alias("price"), "composite_deal_score")


@query
def brief_seed(spark, sf_dir):
    rows = store.lineage_cut(scored(spark, sf_dir))
    return reports.band_seed(bands.band_leaderboard(rows), rows).select("band_order", "model_id", "name", "composite_deal_score")


@query
def hero_and_runners_up(spark, sf_dir):
    return reports.hero_and_runners_up(skyline.annotate_frontier(scored(spark, sf_dir)), "arena").select("model_id", "arena_composite_score", "frontier_rank_arena")


@query
def chart_order(spark, sf_dir):
    """The arena frontier as steps by rising price."""
    found = skyline.view_frontier(scored(spark, sf_dir), "arena")
    return ranges.numbered(reports.chart_order(found), [], ["price", "model_id"], "step").select("model_id", F.round("price", 6).alias("price"), "step")


@query
def snapshot_on(spark, sf_dir):
    """One snapshot of a written history: its date is a partition filter."""
    folder = store.scratch(spark)
    store.write_snapshots(views.snapshots(spark, sf_dir), folder)
    return reports.snapshot_on(store.read_snapshots(spark, folder), "snapshot_date", "1995-01-01").select("model_id", "intelligence_score", "price")


@query
def endpoint_uptimes(spark, sf_dir):
    """Endpoint documents made of users' events, and items that repeat a user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    item = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    end = F.struct(of("click").alias("uptime_last_30m"), of("view").alias("uptime_last_1d"))
    docs = events.where("user_id % 7 > 0").groupBy(item.alias("item_id")).agg(F.to_json(F.struct(F.struct(F.collect_list(end).alias("endpoints")).alias("data"))).alias("body"))
    items = events.where("event_id % 10 = 0").select(item.alias("item_id"), F.col("event_id").alias("ingest_seq"))
    return landed.with_uptimes(items, landed.endpoint_uptimes(docs)).select("item_id", "ingest_seq", "uptime_30m", "uptime_1d")


@query
def history_days(spark, sf_dir):
    """Days of landed documents, one of them without items."""
    folder = store.scratch(spark)
    store.export_json(views.history(spark, sf_dir), folder)
    spark.range(1).select(F.lit('{"date": "1990-01-01", "models": []}').alias("value")).write.mode("append").text(folder)
    days, items = landed.history_tables(spark, folder)
    found = trends.trend_days(items, days=days)
    return found.select("snapshot_date", "priced", trends.threshold_key(F.col("threshold")).alias("threshold"), "cheapest", F.round("median", 7).alias("median"), "n")


@query
def rejected_records(spark, sf_dir):
    checks = {"no price": F.col("price_input").isNotNull(), "too dear": F.col("price_input") <= 300000, "creator": F.coalesce(~F.col("creator").like("%7"), F.lit(True))}
    valid, rejected = resolve.split_valid(views.records(spark, sf_dir), checks)
    return resolve.rejections(rejected).unionByName(valid.groupBy().agg(F.lit("valid").alias("reason"), F.count(F.lit(1)).alias("n")))


@query
def source_union(spark, sf_dir):
    """Parts, a source that is missing, and suppliers, numbered by arrival."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_partkey", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_retailprice").cast("double").alias("price"))
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("name"))
    return landed.union_sources([(part, ["p_brand", "p_partkey"]), (None, []), (supplier, ["s_suppkey"])]).select("name", "price", "ingest_seq")


@query
def page_slugs(spark, sf_dir):
    return landed.page_slugs(spark.read.parquet(f"{sf_dir}/pages.parquet"), skip="the")


def _part_pages(spark, sf_dir, row, head: str, tail: str, sep: str):
    """Pages of up to 40 parts each, by their keys."""
    k = F.col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.floor(k / 40).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("row")))).alias("all"))
    return rows.select("page_id", F.concat(F.lit(head), F.array_join(F.transform("all", lambda x: x["row"]), sep), F.lit(tail)).alias("html"))


@query
def html_leaderboard(spark, sf_dir):
    """Tables with titles, icons, links of providers and of items."""
    k = F.col("p_partkey")
    text = lambda x: x.cast("string")
    links = F.concat(F.lit('<a href="/providers/models/no">host</a> <a href="/models/p-'), text(k), F.lit('?x=1">more</a>'))
    row = F.concat(F.lit("<tr><td>Part "), text(k), F.lit(" ★ new</td><td>"), F.col("p_brand"), F.lit(".svg</td><td>"), F.when(k % 5 > 0, text(k % 70)).otherwise("—"), F.lit("</td><td>$"), text(k % 90), F.lit("</td><td>"), text(k % 30), F.lit("m</td><td>"), links, F.lit("</td></tr>"))
    head = "<table><tr><th>Model</th><th>Creator</th><th>Artificial Intelligence Index</th><th>Blended price</th><th>Context window</th><th>Links</th></tr>"
    return landed.html_leaderboard(_part_pages(spark, sf_dir, row, head, "</table>", "")).select("page_id", "model_id", "name", "creator", "intelligence_score", "price_blended", "context_window_k")


@query
def faq_items(spark, sf_dir):
    k = F.col("p_partkey")
    row = F.concat(F.lit("1. Part "), k.cast("string"), F.lit(" ("), (k % 70).cast("string"), F.lit(")"))
    head, tail = '<script type="application/ld+json">{"@type": "FAQPage", "mainEntity": [{"acceptedAnswer": {"text": "', '"}}]}</script>'
    return landed.faq_items(_part_pages(spark, sf_dir, row, head, tail, ", ")).select("page_id", "model_id", "name", "intelligence_score")


@query
def merged_lists(spark, sf_dir):
    """Of each customer the first list that isn't empty."""
    n = F.col("ingest_seq")
    some = F.array_compact(F.array(F.concat(F.lit("in-"), (n % 4).cast("string")), F.when(n % 3 == 0, "text")))
    rows = views.records(spark, sf_dir).withColumn("modalities", F.when(n % 5 > 0, some).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("k", F.concat(F.lit("cust-"), F.regexp_extract("name", "#0*([1-9][0-9]*)", 1)))
    return resolve.coalesce_fields(rows, (), ("modalities",), by="k").select("k", F.array_join("modalities", ",").alias("modalities"))


@query
def thin_days(spark, sf_dir):
    found = trends.thin_days(trends.trend_days(views.history(spark, sf_dir)))
    return found.select("snapshot_date", trends.threshold_key(F.col("threshold")).alias("threshold"), "n", "low")


@query
def price_quantiles(spark, sf_dir):
    found = reports.price_quantiles(views.catalog(spark, sf_dir), ("price_blended", "price_input", "price_output"), (0.1, 0.5, 0.95))
    return found.select("field", F.col("at").alias("part"), F.round("value", 6).alias("value"))


@query
def snapshot_documents(spark, sf_dir):
    """Every snapshot as documents of at most 100 rows, read back."""
    folder, day = store.scratch(spark), "snapshot_date"
    rows = store.lineage_cut(views.snapshots(spark, sf_dir))
    tracked = changes.track(rows)
    hero = rows.groupBy(day).agg(F.max_by(F.struct("model_id", "intelligence_score"), F.struct("intelligence_score", "model_id")).alias("h")).select(day, "h.*")
    events = changes.events_of(tracked)
    store.export_documents(rows, {"hero": hero}, events, changes.summary_of(tracked), folder, per_part=100)
    header = "date string, total_models long, total_events long, parts struct<models:long,events:long>, hero array<struct<model_id:string>>, changelog struct<data_quality:string>"
    head, models, told = store.read_documents(spark, folder, header, "model_id:string,price:double", "kind:string,new:double")
    sums = models.groupBy(day).agg(F.count(F.lit(1)).alias("read_models"), F.round(F.sum("price"), 3).alias("price"))
    news = told.groupBy(day).agg(F.round(F.sum("new"), 3).alias("news"))
    sizes = spark.read.schema("date string, models array<struct<model_id:string>>").json(f"{folder}/models").groupBy(F.col("date").cast("date").alias(day)).agg(F.max(F.size("models")).cast("long").alias("largest_document"))
    flat = head.select(F.col("date").cast("date").alias(day), "total_models", "total_events", F.col("parts.models").alias("model_parts"), F.col("parts.events").alias("event_parts"), F.get("hero", F.lit(0))["model_id"].alias("hero"), "changelog.data_quality")
    return flat.join(sums, day).join(news, day, "left").join(sizes, day)


@query
def daily_run(spark, sf_dir):
    """Two days of records in two sources; of the second day its bands and how many events of each kind there are."""
    folder = store.scratch(spark)
    rows = views.records(spark, sf_dir).withColumn("price_input", F.col("price_input") / 100000)
    first = F.array_contains("source_pages", "leaderboard") | F.array_contains("source_pages", "coding")
    for day, part in (("2026-01-01", F.col("ingest_seq") % 4 < 3), ("2026-01-02", F.col("ingest_seq") % 5 > 0)):
        own = rows.where(part)
        sources = [(x.withColumnRenamed("ingest_seq", "seq"), ["seq"]) for x in (own.where(first), own.where(~first))]
        out = daily.build_snapshot(spark, sources, folder, day, fuzzy=False)
    counts = out.events.where("kind in ('new', 'removed', 'price', 'intelligence')").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return out.bands.select(F.col("band").alias("what"), "n", F.col("leader_id").alias("id")).unionByName(counts.select(F.col("kind").alias("what"), "n", F.lit(None).cast("string").alias("id")))
