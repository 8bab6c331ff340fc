"""Mixing sources to target weights.

Every source has a weight and a number of words. The mix holds `share` times the words of all sources; each source's
part of it follows the weights, but never exceeds `most` times the source's own words (what is above is shared out
again among the rest). Inside a source the documents stand in a random order given by a hash of their id. The mix takes
the whole source as often as its target allows, and of a last pass the documents from the front of that order, cutting
the one at the border to the exact word.

The order is made as a range sort: the leading bits of the hash are the range, so ranges are even whatever the source's
size. Word counts are summed by range, the sums are accumulated over the ranges of a source, and the rows of one range
are accumulated in one task. A source with a third of all rows is thereby spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import WORD, fresh, lineage_cut, text_of

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a multiple of all words.
SHARE = 1.5
#: Words of a source in the mix, as a multiple of its own words, at most.
MOST = 2.0
#: Documents to a range of hashes, about.
RANGE_ROWS = 4096
#: Sources up to which the table of targets is broadcast; above it is joined by salted keys.
BROADCAST_SOURCES = 20_000
SALTS = 64


def words_in(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_key(source: str) -> Column:
    """A source as a join key: null is a source of its own, after all others."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(skey, source_size, n_docs) to the same with target. One row per source: sources are few next to documents. All
    sources are ranked in one task, some 100 bytes to a source: it holds for up to some ten million sources.

    Sources in the order of `most * size / weight` reach their bound one after the other as the level rises, so running
    sums in that order say which do; the level of the rest follows from what is left."""
    by_key, rising = Window.orderBy("skey"), Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("ratio", "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = (F.row_number().over(by_key) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    ranked = weighted.withColumn("bound", most * F.col("source_size").cast("double")).withColumn("ratio", F.col("bound") / F.col("weight"))
    level = (F.col("budget") - F.col("bound_before")) / (F.col("all_weights") - F.col("weight_before"))
    summed = (
        ranked.withColumn("budget", share * F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("bound_before", F.coalesce(F.sum("bound").over(rising), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
        .withColumn("full", F.col("ratio") <= level)
    )
    spent = F.sum(F.when(F.col("full"), F.col("bound")).otherwise(0.0)).over(everything)
    used = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(everything)
    rest = F.try_divide(F.col("budget") - spent, F.col("all_weights") - used)
    return summed.withColumn("level", rest).select(
        "skey", "source_size", "n_docs", F.when(F.col("full"), F.col("bound")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("bound"))).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents with size, source_size, target and taken (the words that the mix takes, repeats counted).

    Needs doc_id, source and text; every other column is carried along (one that is named like a result is replaced).
    Null text and text without words have size 0 and are taken 0 times. A null source is a source, the last one. Rows
    with the same doc_id are separate documents, next to each other in the order (those of one size are alike to it); a null
    doc_id is an id like another. Very long texts are counted whole.
    An empty table gives an empty result. Reruns agree, as the order depends on ids alone."""
    docs = docs.drop("size", "source_size", "target", "taken")
    skey, place, rng, before, size, width, words, salt = fresh([*docs.columns, "source_size", "target", "taken"], "skey", "place", "rng", "before", "size", "width", "words", "salt")
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15)
    rows = docs.withColumns({size: words_in("text"), skey: source_key("source"), place: F.conv(digits, 16, 10).cast("long")})
    # Sums read the counts from here, so that texts are read once for them and once for the result.
    counts = lineage_cut(rows.select(skey, place, size))

    sizes = counts.groupBy(F.col(skey).alias("skey")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = lineage_cut(source_targets(sizes, weights, share, most))
    ranges = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("n_docs") / RANGE_ROWS)).cast("double"))).cast("long")
    # Ranges are powers of two, so a range is the place divided by the width of one.
    sources = sources.select(F.col("skey").alias(skey), "source_size", "target", (F.lit(1 << 60) / ranges).cast("long").alias(width))
    few = sources.count() <= BROADCAST_SOURCES
    copies = sources.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def placed(x: DataFrame) -> DataFrame:
        joined = x.join(F.broadcast(sources), skey) if few else x.withColumn(salt, F.pmod(F.col(place), F.lit(SALTS)).cast("int")).join(copies, [skey, salt]).drop(salt)
        return joined.withColumn(rng, F.floor(F.col(place) / F.col(width)).cast("long")).drop(width)

    sums = placed(counts).groupBy(skey, rng).agg(F.sum(size).alias(words))
    upto = Window.partitionBy(skey).orderBy(rng).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(skey, rng, F.coalesce(F.sum(words).over(upto), F.lit(0)).alias(before))
    inside = Window.partitionBy(skey, rng).orderBy(place, F.col("doc_id"), size).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col(before) + F.sum(size).over(inside) - F.col(size)
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.try_divide(budget, F.col("source_size")))).otherwise(0).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col(size), budget - passes * F.col("source_size") - at))
    found = placed(rows).join(offsets, [skey, rng]).withColumn("taken", (passes * F.col(size) + last).cast("long"))
    return found.select(*docs.columns, F.col(size).alias("size"), "source_size", "target", "taken")


def mixed(decided: DataFrame) -> DataFrame:
    """The documents of the mix, from the rows of mix(): a row to each pass over a document, with copy, the pass's number.

    What is taken 0 times goes, whole passes repeat the text, and a text at the border ends with its last taken word (the
    white space before its words stays). Null texts and texts without words have no words to take, so they go; rows with one
    doc_id are documents of their own, each with its own copies; very long texts are cut whole. A column copy is replaced. n_chars, where there is one, is that of the new text. taken is the document's as
    before, so a row holds the least of size and what earlier copies leave."""
    columns = [c for c in decided.columns if c.lower() != "copy"]
    copies = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    rows = decided.where("taken > 0").select(*columns, copies.alias("copy"))
    words = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    pieces = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    rows = rows.withColumn("text", F.when(words < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), words), "")).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.char_length("text").cast(decided.schema["n_chars"].dataType)) if "n_chars" in columns else rows
