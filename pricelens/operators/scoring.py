"""Scores, gates and rank order of a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.pricing import effective_price, value_ratio

# Weights of value, coding and speed; pinned log anchors of each measure; what a missing one counts as.
WEIGHTS = (0.5, 0.3, 0.2)
ANCHORS = {"value_score": (5.0, 500.0), "coding_value": (5.0, 500.0), "output_speed_tps": (20.0, 1000.0), "arena_value": (50.0, 10000.0), "arena_coding_value": (50.0, 10000.0)}
NEUTRAL = 0.5
UPTIME_GATE = 95.0
SCORING_VERSION = 2
VIEWS = {"intel": ("value_score", "coding_value"), "arena": ("arena_value", "arena_coding_value")}
COMPOSITE = {"intel": "composite_deal_score", "arena": "arena_composite_score"}


def normalize_log(x: str, anchors: tuple[float, float]) -> Column:
    """0 at the lower anchor, 1 at the upper one, linear in the logarithm, clamped; a missing value is neutral."""
    low, high = anchors
    part = (F.log10(F.greatest(F.col(x), F.lit(low))) - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low)))
    return F.when(F.col(x).isNull(), NEUTRAL).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part)))


def composite(view: str) -> Column:
    """Weighted sum of a view's normalised measures; null where neither value nor coding value is known."""
    names = [*VIEWS[view], "output_speed_tps"]
    total = sum((w * normalize_log(n, ANCHORS[n]) for w, n in zip(WEIGHTS, names, strict=True)), F.lit(0.0))
    return F.when(F.col(names[0]).isNull() & F.col(names[1]).isNull(), None).otherwise(F.round(total, 4))


def passes_gate(first: str = "uptime_30m", second: str = "uptime_1d") -> Column:
    """The better of two uptimes reaches the gate; without data it passes."""
    return F.coalesce(F.greatest(first, second) >= UPTIME_GATE, F.lit(True))


def is_deal_candidate(view: str) -> Column:
    return F.col(COMPOSITE[view]).isNotNull() & passes_gate()


def with_missing(catalog: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The catalog with null columns for those it lacks."""
    return catalog.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in catalog.columns})


def score_catalog(catalog: DataFrame) -> DataFrame:
    """The catalog with its effective price, the four ratios and both composites; row by row, nothing is shuffled."""
    known = dict.fromkeys(("coding_index", "arena_elo", "arena_coding_elo", "uptime_30m", "uptime_1d", "price_blended", "price_input", "price_output", "openrouter_price_input", "openrouter_price_output", "output_speed_tps"), "double")
    priced = with_missing(catalog, known).withColumn("price", effective_price())
    price = F.col("price")
    ratios = priced.withColumns({
        "value_score": value_ratio("intelligence_score", price),
        "coding_value": value_ratio("coding_index", price),
        "arena_value": value_ratio("arena_elo", price),
        "arena_coding_value": value_ratio("arena_coding_elo", price),
    })
    return ratios.withColumns({COMPOSITE[v]: composite(v) for v in VIEWS})


def rank_order(key: str = "model_id") -> list[Column]:
    """Scored first, then by composite, then by quality; ties by key."""
    return [F.col("composite_deal_score").desc_nulls_last(), F.coalesce("intelligence_score", F.lit(0.0)).desc(), F.col(key)]


def top_deals(ranked: DataFrame, k: int, view: str = "intel", key: str = "model_id") -> DataFrame:
    """The k best: of the frontier by rank, or of gated rows by composite where there is no frontier. One pass: rows of the
    frontier are put first, and the others count only if it is empty (an aggregate of one row says so)."""
    on, rank = f"is_frontier_{view}", f"frontier_rank_{view}"
    some = ranked.agg(F.coalesce(F.max(on), F.lit(False)).alias("_some"))
    fit = ranked.join(F.broadcast(some)).where(F.when(F.col("_some"), F.col(on)).otherwise(is_deal_candidate(view)))
    order = [F.col(rank).asc_nulls_last(), F.col(COMPOSITE[view]).desc_nulls_last(), *rank_order(key)]
    return fit.orderBy(*order).limit(k).drop("_some")
