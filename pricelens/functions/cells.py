"""Numbers out of table cells, as columns; what is no number is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = ("", "—", "-", "N/A")
STATUS = r"(?i)\s*(?:Preliminary|final|confirmed)\s*"


def number(cell: str | Column) -> Column:
    """A number without $, % and thousands' commas."""
    text = F.regexp_replace(F.trim(cell), "[$%,]", "")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def integer(cell: str | Column) -> Column:
    return number(cell).cast("long")


def context_k(cell: str | Column, billions: bool = False) -> Column:
    """A context window in thousands: 128k, 1m (and 1B where asked for), or a plain number."""
    text = F.lower(F.trim(cell))
    size = number(F.regexp_replace(text, "[kmb]$", ""))
    out = F.when(text.endswith("m"), size * 1000).when(text.endswith("k"), size)
    out = out.when(text.endswith("b"), size * 1_000_000 if billions else F.lit(None))
    return out.otherwise(size).cast("long")


def score(cell: str | Column) -> Column:
    """A struct of score and ci, from 1502±4, 1567+10/-10 or a plain integer; status words are ignored."""
    text = F.regexp_replace(F.trim(cell), STATUS, "")
    parts = F.split(text, "±")
    both = [F.regexp_extract(text, r"^(\d+)\+(\d+)/-(\d+)", i) for i in (1, 2, 3)]
    odd = both[0] != ""
    value = F.when(odd, both[0].try_cast("long")).otherwise(integer(parts[0]))
    spread = F.floor((both[1].try_cast("long") + both[2].try_cast("long")) / 2)
    return F.struct(value.alias("score"), F.when(odd, spread).otherwise(integer(F.get(parts, F.lit(1)))).cast("long").alias("ci"))


def prices(cell: str | Column) -> Column:
    """A struct of input and output price, from $5 / $25."""
    parts = F.split(F.trim(cell), "/")
    known = ~F.upper(F.trim(cell)).isin(*MISSING)
    return F.struct(F.when(known, number(parts[0])).alias("price_input"), F.when(known, number(F.get(parts, F.lit(1)))).alias("price_output"))


def linked_name(cell: str | Column) -> Column:
    """A struct of name, slug and creator from `[name](address "slug") Vendor · License`."""
    link = r'\[([^\]]+)\]\([^"]*(?:"([^"]+)")?\)'
    text, harness = F.trim(cell), r"(?i)\s*\(codex-harness\)"
    linked = text.rlike(link)
    name = F.regexp_replace(F.when(linked, F.trim(F.regexp_extract(text, link, 1))).otherwise(text), harness, "")
    slug = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, link, 2), harness, "")), F.lit(""))
    rest = F.when(linked, F.trim(F.regexp_replace(text, rf"^.*?{link}", "")))
    vendor = F.trim(F.regexp_extract(rest, r"^([^·]+?)\s*·\s*(.+)", 1))
    creator = F.when((vendor != "") & ~F.lower(vendor).isin("n/a", "unknown"), vendor)
    from pricelens.functions.names import slug_of_name

    return F.struct(name.alias("name"), F.coalesce(slug, slug_of_name(name)).alias("slug"), creator.alias("creator"))


def clean_name(text: str | Column) -> Column:
    """The leading words of plain signs; all of the text if there is none."""
    lead = F.trim(F.regexp_extract(F.trim(text), r"^((?:[A-Za-z0-9().+\-_/]+(?:\s+|$))+)", 1))
    return F.when(lead != "", F.regexp_replace(lead, r"\s+", " ")).otherwise(text)


def without_icon(text: str | Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(text, r"(?i)\.(svg|png|jpg|webp)", "")), F.lit(""))
