"""Effective prices and quality-per-price ratios, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A price below this counts as this in ratios, never where a price is shown, compared or charted.
PRICE_FLOOR = 0.05


def effective_price(blended="price_blended", inp="price_input", out="price_output", alt_in="openrouter_price_input", alt_out="openrouter_price_output") -> Column:
    """A positive blended price, else two parts input and one part output, else input alone, then the same of the other
    source. An output price alone is no price; an input price of 0 is."""
    c = F.col
    mixed = lambda i, o: (F.lit(2.0) * c(i) + c(o)) / 3
    return F.coalesce(F.when(c(blended) > 0, c(blended)), mixed(inp, out), c(inp), mixed(alt_in, alt_out), c(alt_in))


def scoring_price(price: Column) -> Column:
    return F.when(price.isNotNull(), F.greatest(price, F.lit(PRICE_FLOOR)))


def value_ratio(quality: str | Column, price: Column) -> Column:
    """Quality for each unit of the floored price, to 4 digits; null if either is missing."""
    return F.round((F.col(quality) if isinstance(quality, str) else quality) / scoring_price(price), 4)


def rounded(x: str | Column, digits: int) -> Column:
    """A double to so many digits, halves away from zero, as it is once scaled: 0.5045 lies below its half and gives 0.504 (of its
    printed digits, as F.round goes by, that would be 0.505)."""
    scaled = (F.col(x) if isinstance(x, str) else x) * float(10**digits)
    return F.round(scaled) / float(10**digits)


def price_label(price: str | Column) -> Column:
    """A price as text: three digits below 1, two above, n/a if missing."""
    p = F.col(price) if isinstance(price, str) else price
    return F.when(p.isNull(), "n/a").when(p < 1, F.format_string("$%.3f", p)).otherwise(F.format_string("$%.2f", p))
