"""Order statistics and running values over groups of any size.

Rows are sorted by group and order into ranges, as Spark's range partitioning deals them. Each range is scanned by itself,
and a small table with a row to each range and group carries over what stands before it. So a group may hold all rows:
no window is wider than a range, and what is broadcast has at most a row to each range.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.sources.store import lineage_cut

#: Name of the column that tells a row's range.
PART = "_range"
#: Running values: the aggregate inside a range, and how it follows what stands before the range.
RUNNING: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda own, before: F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))),
    "max": (F.max, lambda own, before: F.greatest(own, before)),
    "min": (F.min, lambda own, before: F.least(own, before)),
    "last": (lambda x: F.last(x, ignorenulls=True), lambda own, before: F.coalesce(own, before)),
}


def same(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """All pairs of columns are equal, where null equals null."""
    return functools.reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs], F.lit(True))


def ranged(rows: DataFrame, groups: Sequence[str], order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """The rows with the number of their range, in a written form, so that later scans agree on it. Rows that agree in all of
    groups and order share a range: order should tell rows apart, or equal ones be counted beforehand."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lineage_cut(rows.repartitionByRange(n, *groups, *order).withColumn(PART, F.spark_partition_id()))


def running(rows: DataFrame, groups: Sequence[str], order: Sequence[str | Column], values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """Rows of `ranged` with running values inside their group: name to (kind of RUNNING, expression). With before, the row
    itself doesn't count: `last` is then the row before it."""
    g = list(groups)
    window = Window.partitionBy(PART, *g).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    names = {name: (f"_inside{i}", f"_carry{i}") for i, name in enumerate(values)}
    marked = rows.withColumns({f"_value{i}": x for i, (_, x) in enumerate(values.values())})
    inside = marked.withColumns({names[name][0]: RUNNING[kind][0](F.col(f"_value{i}")).over(window) for i, (name, (kind, _)) in enumerate(values.items())})
    # What a range holds of each group; the last row of a group in a range has its running value.
    ends = Window.partitionBy(*g).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = []
    for i, (kind, x) in enumerate(values.values()):
        last = F.max_by(f"_value{i}", F.when(F.col(f"_value{i}").isNotNull(), F.struct(*_keys(order)))) if kind == "last" else RUNNING[kind][0](F.col(f"_value{i}"))
        totals.append(last.alias(f"_value{i}"))
    edges = marked.groupBy(PART, *g).agg(*totals).withColumns({names[name][1]: RUNNING[kind][0](F.col(f"_value{i}")).over(ends) for i, (name, (kind, _)) in enumerate(values.items())})
    # A group that goes on from an earlier range is the first of its range, so there is at most one to a range.
    rank = F.row_number().over(Window.partitionBy(*g).orderBy(PART))
    edges = edges.withColumn("_piece", rank).where("_piece > 1").select(F.col(PART).alias("_at_range"), *[F.col(c).alias(f"_at_group{i}") for i, c in enumerate(g)], *[c for _, c in names.values()])
    joined = inside.join(F.broadcast(edges), same(inside, edges, [(PART, "_at_range"), *[(c, f"_at_group{i}") for i, c in enumerate(g)]]), "left")
    return joined.select(*rows.columns, *[RUNNING[kind][1](F.col(names[name][0]), F.col(names[name][1])).alias(name) for name, (kind, _) in values.items()])


def _keys(order: Sequence[str | Column]) -> list[Column]:
    if not all(isinstance(c, str) for c in order):
        raise ValueError("`last` needs rising columns, by name")
    return [F.struct(F.col(c).isNotNull(), F.col(c)) for c in order]


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """The rows with their place (a long, from 1) in their group by order, whatever the number of partitions."""
    return running(ranged(rows, groups, order), groups, order, {name: ("sum", F.lit(1).cast("long"))}).drop(PART)


def percentiles(rows: DataFrame, value: str, at: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, at, value): exact interpolated percentiles of the values that aren't null, all of them at once.

    Distributed selection: values are counted (so that ties cost nothing), sorted into ranges, and the counts of ranges tell
    which range holds a wanted place. Only those ranges are sorted."""
    g = list(groups)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*g, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = ranged(counted, g, ["_v"])
    whole = Window.partitionBy(*g)
    held = dealt.groupBy(PART, *g).agg(F.sum("_n").alias("_held"))
    held = held.withColumn("_before", F.coalesce(F.sum("_held").over(whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = held.withColumn("_all", F.sum("_held").over(whole))
    place = held.select("*", F.explode(F.array(*[F.lit(float(p)) for p in at])).alias("at")).withColumn("_place", (F.col("_all") - 1) * F.col("at"))
    ends = place.select("*", F.explode(F.array(F.floor("_place"), F.ceil("_place"))).alias("_end")).where("_end >= _before and _end < _before + _held")
    wanted = ends.select(F.col(PART).alias("_at_range"), *[F.col(c).alias(f"_at_group{i}") for i, c in enumerate(g)], "at", "_place", "_end", "_before").distinct()
    key = [(PART, "_at_range"), *[(c, f"_at_group{i}") for i, c in enumerate(g)]]
    ranges = wanted.select("_at_range", *[f"_at_group{i}" for i in range(len(g))]).distinct()
    few = dealt.join(ranges, same(dealt, ranges, key), "left_semi")
    upto = few.withColumn("_upto", F.sum("_n").over(Window.partitionBy(PART, *g).orderBy("_v")))
    inside = (F.col("_end") - F.col("_before") >= F.col("_upto") - F.col("_n")) & (F.col("_end") - F.col("_before") < F.col("_upto"))
    found = upto.join(wanted, same(upto, wanted, key) & inside)
    low, high = F.min("_v"), F.max("_v")
    return found.groupBy(*g, "at", "_place").agg((low + (high - low) * (F.col("_place") - F.floor("_place"))).alias("value")).drop("_place")
