"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.sources.store import lineage_cut, scratch, shared_root

__all__ = ["WORD", "attach", "bounded_sample", "fresh", "lineage_cut", "shared_folder", "shared_root", "table", "text_of"]

#: A word: a longest run of anything but ASCII white space (as a Java regular expression).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; it goes when the application ends."""
    return scratch(spark, "llm")


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Column names made from those wanted that clash with none taken (Spark compares names without case)."""
    have = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def attach(rows: DataFrame, key: str, facts: DataFrame, how: str = "inner", by: list[str] | None = None, salts: int = 64) -> DataFrame:
    """Rows with the columns of facts, which has one row to a value of key. A value may have a third of all rows, so rows
    are dealt by key and a salt (a hash of the columns named in by, all if None), and facts are copied only to the salts
    that a value has."""
    salt = fresh([*rows.columns, *facts.columns], "salt")[0]
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*(by or rows.columns)), F.lit(salts)).cast("int"))
    needed = salted.select(key, salt).distinct().join(facts, key)
    return salted.join(needed, [key, salt], how).drop(salt)


def bounded_sample(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most n rows, those with the smallest hashes of their key and columns, so that reruns take the same ones. Only two
    hashes of a row are sorted; equal rows count once."""
    place = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(*rows.columns).alias("b"))
    last = rows.select(place.alias("place")).orderBy("place").limit(n).agg(F.max("place").alias("p")).select("p.a", "p.b").first()
    if last is None or last.a is None:
        return rows.limit(0)
    return rows.where(place <= F.struct(F.lit(last.a).alias("a"), F.lit(last.b).alias("b"))).distinct()
