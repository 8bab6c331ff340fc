"""Groups of any size: order statistics, numbering, frontiers and series against plain Python, and the plans behind them."""

import datetime
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelens.operators import changes, ranges, resolve, skyline, trends
from pricelens.sources import landed


def day(n):
    return datetime.date(2026, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture
def plans(spark, monkeypatch):
    """The physical plans of all rows that operators write on their way."""
    seen = []

    def cut(rows):
        seen.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.checkpoint(eager=True)

    for module in (ranges, skyline, changes, resolve, landed):
        monkeypatch.setattr(module, "lineage_cut", cut)
    return seen


def gathered(plan):
    """Exchanges to a single task of anything but partial aggregates and limits."""
    lines = [re.sub(r"^[\s:+*()\d-]*", "", x) for x in plan.splitlines()]
    return [b for a, b in zip(lines, lines[1:], strict=False) if a.startswith("Exchange SinglePartition") and not re.search(r"functions=\[(partial_|\])|LocalLimit", b)]


def test_percentiles_with_ties_nulls_and_groups(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", None]), float(draw.choice([1, 1, 1, draw.randint(0, 50)]))) for _ in range(900)] + [("one", 3.0), ("none", None)]
    got = {(r.g, r["at"]): r.value for r in ranges.percentiles(spark.createDataFrame(rows, "g string, v double"), "v", (0.0, 0.25, 0.5, 0.99, 1.0), ("g",)).collect()}
    want = {(g, p): np.percentile([v for h, v in rows if h == g], 100 * p) for g in ("a", None, "one") for p in (0.0, 0.25, 0.5, 0.99, 1.0)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_running_values_go_on_over_ranges(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["a", "b", None]), i, None if draw.random() < 0.3 else draw.random()) for i in range(400)]
    dealt = ranges.ranged(spark.createDataFrame(rows, "g string, i int, x double"), ["g"], ["i"])
    values = {"n": ("sum", F.lit(1).cast("long")), "most": ("max", F.col("x")), "least": ("min", F.col("x")), "last": ("last", F.col("x"))}
    for before in (False, True):
        got = {r.i: (r.n, r.most, r.least, r["last"]) for r in ranges.running(dealt, ["g"], ["i"], values, before).collect()}
        for g in ("a", "b", None):
            own = [r for r in rows if r[0] == g]
            for k, r in enumerate(own):
                seen = [x for _, _, x in own[: k + (not before)] if x is not None]
                assert got[r[1]] == (k + (not before), max(seen, default=None), min(seen, default=None), seen[-1] if seen else None)


@pytest.mark.parametrize("parts", ["1", "4", "200"])
def test_arrival_numbers_don_t_depend_on_partitions(spark, parts):
    draw = random.Random(3)
    rows = [(draw.choice("abc"), draw.randint(0, 5), f"t{i}") for i in range(120)]
    draw.shuffle(rows)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(rows, "k string, n int, t string").repartition(int(parts) % 7 + 1)
        got = {r.t: r.ingest_seq for r in landed.union_sources([(frame, ["k"]), (None, []), (frame.limit(0), ["k"]), (frame.withColumn("t", F.concat("t", F.lit("x"))), ["n"])]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    hashed = {r.t: r.h for r in frame.select("t", F.xxhash64("k", "n", "t").alias("h")).collect()}
    want = {t: i + 1 for i, (_, _, _, t) in enumerate(sorted((k, hashed[t], n, t) for k, n, t in rows))}
    assert {t: s for t, s in got.items() if not t.endswith("x")} == want
    assert sorted(s for t, s in got.items() if t.endswith("x")) == [3 * (1 << 52) + i for i in range(1, 121)]


def greedy(points):
    kept = points[:1]
    for p in points[1:]:
        if not (math.log10(p[0]) - math.log10(kept[-1][0]) < 0.02 and abs(p[1] - kept[-1][1]) < 0.5):
            kept.append(p)
    return kept


def test_a_long_frontier_equals_the_greedy_rule(spark):
    n = 100_000
    frame = spark.range(n).select(F.concat(F.lit("m"), F.col("id")).alias("model_id"), F.lit("x").alias("name"), F.pow(F.lit(10.0), F.col("id") / 40_000).alias("price"), (F.col("id") / 1500).alias("quality"), F.lit(0.5).alias("s"))
    points = [tuple(r) for r in frame.select("price", "quality").collect()]
    near = skyline.collapse_near(skyline.pareto(frame, "price", "quality"), "price", "quality", 0.5, "s", "name")
    scored = skyline.frontier_scores(near, "price", "quality", "name").collect()
    want = greedy(points)
    assert sorted((r.price, r.quality) for r in scored) == want and sorted(r.frontier_rank for r in scored) == list(range(1, len(want) + 1))


def test_prices_close_together_are_spread(spark):
    """All prices within a fiftieth of a factor of ten, a third of the rows at one of them."""
    draw = random.Random(4)
    rows = [(i, 1.0 if i % 3 == 0 else round(1 + draw.random() * 0.04, 6), float(draw.randint(0, 10_000))) for i in range(6000)]
    frame = spark.createDataFrame(rows, "i int, p double, q double")
    by_price = {}
    for _, p, q in rows:
        by_price[p] = max(q, by_price.get(p, -1))
    best, want = -1.0, set()
    for p, q in sorted(by_price.items()):
        if q > best:
            want.add((p, q))
            best = q
    assert {(r.p, r.q) for r in skyline.pareto(frame, "p", "q").collect()} == want
    sizes = [r["count"] for r in ranges.ranged(frame.groupBy("p").agg(F.max("q").alias("q")), [], ["p"], 8).groupBy(ranges.PART).count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * sum(sizes) / len(sizes)


def test_an_item_with_half_of_all_points_is_spread(spark):
    few = [(day(i), f"k{k}", f"n{i}", "c", 1.0, float(i + 1)) for k in range(20) for i in range(15)]
    hot = [(day(i), "hot", f"n{i}", None if i == 999 else "d", 2.0, float(i + 1)) for i in range(1000)]
    frame = spark.createDataFrame(few + hot, "snapshot_date date, model_id string, name string, creator string, intelligence_score double, price double")
    got = {r.model_id: r for r in trends.trend_series(frame, salts=8).collect()}
    assert len(got) == 21 and [p.p for p in got["hot"].points] == [float(i + 1) for i in range(820, 1000)] and (got["hot"]["name"], got["hot"].creator) == ("n999", None)
    assert len(got["k3"].points) == 15 and got["k3"].creator == "c"
    plan = trends.trend_series(frame)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "_salt" in plan


def test_no_task_gathers_a_frontier_or_a_day(spark, plans):
    from pricelens.plans import registry

    for name in ("best_value_frontier", "pareto_frontier_large", "score_percentiles", "field_noise", "trend_days", "source_union"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    allowed = r"keys?=\[(snapshot_date|_range)#"  # tables of days, and of ranges, are scanned whole
    assert len(plans) > 10 and not [x for p in plans for x in gathered(p) if not re.search(allowed, x)]
    assert not any(re.search("CartesianProduct|Python|Pandas", p) for p in plans)


def test_changes_come_from_one_join(spark, plans):
    from pricelens.plans import registry

    for name in ("change_events", "change_digest", "change_digest_ranked"):
        plans.clear()
        last = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert sum(p.count("FullOuter") for p in [*plans, last]) == 1, name


def test_rejected_records_are_read_once(spark, plans):
    frame = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    good, bad = resolve.split_valid(frame, {"status": F.col("o_orderstatus") != "F", "price": F.col("o_totalprice") < 200_000})
    both = good.select("o_orderkey").unionByName(bad.select("o_orderkey"))
    assert "FileScan" not in both._jdf.queryExecution().executedPlan().toString() and sum(p.count("FileScan") for p in plans) == 1
    assert both.count() == frame.count() and {r.reason for r in resolve.rejections(bad).collect()} == {"status", "price"}


def test_common_letter_pairs_never_meet(spark):
    """Every name shares most of its pairs with all others; only the rare ones bring names together."""
    import difflib

    draw = random.Random(5)
    names = ["the common item " + "".join(draw.choices("qwxyzjkv", k=6)) for _ in range(150)]
    names = list(dict.fromkeys(names + [n[:-1] + "a" for n in names[:40]] + ["x" + n[5:] for n in names[40:60]]))
    frame = spark.createDataFrame([(n, i, i % 3 > 0) for i, n in enumerate(names)], "norm string, first_seen long, open boolean")
    got = {r["norm"]: r.match for r in resolve.fuzzy_matches(frame).collect()}
    assert got == {n: m[0] for i, n in enumerate(names) if i % 3 > 0 and (m := difflib.get_close_matches(n, names[:i], 1, 0.82))}
    with pytest.raises(ValueError):
        resolve.fuzzy_matches(frame, 0.8)
