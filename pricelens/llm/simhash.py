"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint of its word shingles. Two fingerprints are linked if they differ in few bits.
Equal fingerprints are one node, so copies cost nothing. For a radius r there are 2 ** (r + 1) - 1 tables, each with a bit
mask: bit i carries a random nonzero code of r + 1 bits, and table v keeps the bits whose code has an odd number of ones
in common with v. At most r codes of differing bits leave some v that is orthogonal to all of them, and in that table
the two fingerprints fall in one bucket: no pair within the radius is ever missed.

Buckets that hold many fingerprints would make a square of pairs. Fingerprints that stand in such a bucket are linked
another way, exact too: each names every value within half the radius of itself. Two of them within the radius share
such a value, and two that share one are within the radius; so whatever shares a value is linked to the smallest
fingerprint there. This costs a fixed number of rows to a fingerprint, however large the group.

Links become groups by passing the smallest label along and jumping over labels, with the lineage cut in each round.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import attach, fresh, lineage_cut

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints in a bucket from which they are linked by shared values instead of pairs.
CROWD = 400
BITS = 64


def fingerprint(text: str | None) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it. Fewer words than a shingle make one; none give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # whole texts, in blocks of bounded memory
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """The documents with fp, a long with the fingerprint's bits. Null, empty and blank texts have 0."""

    @F.pandas_udf("long")
    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", make("text"))


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The bit masks of the covering tables, as signed longs."""
    draw = random.Random(SEED)
    codes = [draw.randrange(1, 2 ** (radius + 1)) for _ in range(bits)]
    found = [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in found]


def flips(distance: int, bits: int = BITS) -> list[int]:
    """Every value with at most so many bits set, as signed longs."""
    found = [sum(1 << i for i in c) for k in range(distance + 1) for c in combinations(range(bits), k)]
    return [m - (1 << bits) if m >> (bits - 1) else m for m in found]


def links(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b) with a < b among the distinct values of fp in nodes: every link, or for crowded fingerprints enough of them
    to join the same groups. Only links within the radius. The radius is even."""
    table = F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks(radius)])).alias("table", "mask")
    keyed = nodes.select("fp", table).select("fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # Each bucket's size, with all of its values only where they are few: arrays stop growing at the crowd.
    full = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    full = lineage_cut(full)
    crowded = lineage_cut(keyed.join(full.select("table", "key"), ["table", "key"], "left_semi").select("fp").distinct())
    calm = keyed.join(full.select("table", "key"), ["table", "key"], "left_anti")
    lists = calm.groupBy("table", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    pairs = lists.select("fps", F.posexplode("fps").alias("i", "a")).select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()
    if crowded.isEmpty():
        return near
    near_values = F.array(*[F.lit(x).cast("long") for x in flips(radius // 2)])
    shared = crowded.repartition("fp").select("fp", F.explode(near_values).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    stars = shared.groupBy("value").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("fps"))
    return near.unionByName(stars.select("a", F.explode("fps").alias("b")).where("a < b").distinct())


def groups(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in the edges (a, b): the smallest node that it reaches. Each round hooks a node's label
    to the smallest label beside it and then jumps once over labels; it ends when a round changes nothing."""
    ends = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = lineage_cut(edges.select(ends.alias("e")).select("e.a", "e.b").distinct())
    label = lineage_cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        beside = attach(both, "b", label.withColumnRenamed("node", "b")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = label.join(beside, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # A label that learned of a smaller one passes it to all that carry it.
        hook = lower.groupBy("was").agg(F.min("label").alias("to"))
        hooked = attach(lower, "was", hook).select("node", "was", F.least("label", "to").alias("label"))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = lineage_cut(attach(hooked, "label", jump).select("node", "was", F.least("label", "next").alias("label")))
        label = after.select("node", "label")
        if after.where("label < was").isEmpty():
            return label


def labelled(docs: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """The documents' (doc_id, fp, component_id, label): label tells groups apart where component_id is null."""
    marked = lineage_cut(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    nodes = lineage_cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    label = groups(links(nodes, radius, crowd))
    named = nodes.join(label, nodes["fp"] == label["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = lineage_cut(attach(named, "label", least, by=["fp"]).select("fp", "component_id", "label"))
    return attach(marked, "fp", by_fp)


def components(docs: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """The documents' (doc_id, fp, component_id): the smallest doc_id that links reach, the document itself included.

    Rows that share a doc_id stay separate rows. A null doc_id counts as the largest of ids: a group of only such has null.
    Documents without words are linked by their fingerprint 0 like any others. A very long text is hashed whole, in blocks of
    bounded memory. An empty table gives an empty result; other columns don't matter."""
    return labelled(docs, radius, crowd).drop("label")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """The documents with fingerprint (16 hex digits) and component_id; other columns are kept, doc_id must be a key."""
    found = components(docs, radius, crowd)
    docs = docs.drop("fingerprint", "component_id")
    key = fresh(docs.columns, "key")[0]
    small = found.select(F.col("doc_id").alias(key), fingerprint_text("fp").alias("fingerprint"), "component_id")
    return docs.join(small, docs["doc_id"].eqNullSafe(small[key])).drop(key)


def fingerprint_text(column: str):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def keep_first(docs: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """One document of each group, the one with the smallest doc_id (null is the largest); of rows that share it, the one with
    the smallest fingerprint, then text. The columns are those of docs.

    A doc_id that one row has finds its row by itself. Rows whose doc_id is null or repeats are told apart by fingerprint:
    rows with the same doc_id and fingerprint are of one group, so one of them is taken before they are joined."""
    found = lineage_cut(labelled(docs, radius, crowd))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp"))
    first = lineage_cut(found.groupBy("label").agg(least.alias("k")).select("k.doc_id", "k.fp"))
    odd = lineage_cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    alone = docs.join(first.join(odd, "doc_id", "left_anti").where("doc_id is not null").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if odd.isEmpty():
        return alone
    mark, id_key, fp_key = fresh([*docs.columns, "fp"], "mark", "id_key", "fp_key")
    shared = docs.where("doc_id is null").unionByName(docs.join(odd, "doc_id", "left_semi").select(*docs.columns))
    whole = shared.select(F.struct(*docs.columns).alias(mark), "doc_id", "text")
    one = fingerprints(whole).groupBy("doc_id", "fp").agg(F.min_by(mark, F.struct("text")).alias(mark))
    keys = first.select(F.col("doc_id").alias(id_key), F.col("fp").alias(fp_key))
    kept = one.join(keys, F.col("doc_id").eqNullSafe(F.col(id_key)) & (F.col("fp") == F.col(fp_key)), "left_semi")
    return alone.unionByName(kept.select(f"{mark}.*"))
