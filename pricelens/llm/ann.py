"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised separately, each by its own k-means codebook, so that K codewords to a half make
K * K cells. A query scores the codewords of each half, and a heap walks the pairs of codewords in order of their summed
distance, from the nearest cell outwards, until the cells visited hold a stated part of all vectors. Every vector of a
visited cell is compared with the query itself, in double precision.

Equal vectors are one entry of the index with their smallest ids: as many as are asked for, and one more, are enough for
every query, whatever the number of copies. The queries are dealt into blocks, the entries into slices; a task holds one
block of queries and streams one slice cell by cell past those of them that visit the cell, keeping a bounded list for
each query. No task holds a slice whole, and nothing is broadcast but codebooks and the sizes of the K * K cells.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_sample, lineage_cut

#: Codewords to a half; vectors from which they are fitted, at most; rounds of k-means.
CODEWORDS, FIT_SAMPLE, ROUNDS = 32, 20_000, 10
#: The part of all entries that a query visits, and the fewest. Random directions of 64 dimensions, as in the given tables,
#: have no structure to exploit: this part finds 94 to 96 of 100 true neighbours there. Clustered vectors need far less.
VISITED, LEAST_VISITED = 0.6, 1024
NEAREST, EVERY = 20, 20
#: Queries of a block (each task holds one) and entries of a slice (streamed), about.
BLOCK, SLICE = 2048, 16_384


def usable(vector: str) -> Column:
    """Not null, no null, NaN or infinite component, and not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec): the rows that take part, as doubles, an id once. Vectors of another length than most have are left out (of
    lengths equally frequent the smaller counts), so are rows without id; of rows that repeat an id the smallest vector stays."""
    fit = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable("vec"))
    size = fit.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("d")).first().d
    return fit.where(F.size("vec") == F.lit(size)).groupBy("id").agg(F.min("vec").alias("vec"))


def k_means(points: np.ndarray, k: int = CODEWORDS, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """At most k centres of the points, an own number for each."""
    draw = np.random.default_rng(seed)
    own = np.unique(points, axis=0)
    centres = own[draw.choice(len(own), min(k, len(own)), replace=False)]
    for _ in range(rounds):
        of = nearest(points, centres)
        sums, n = np.zeros_like(centres), np.bincount(of, minlength=len(centres))
        np.add.at(sums, of, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


@dataclass
class Index:
    """entries: (cell, ids, vec) of every distinct vector; the rest is small."""

    entries: DataFrame
    halves: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray  # entries to a cell
    dimension: int


def build(found: DataFrame, codewords: int = CODEWORDS, keep: int = NEAREST + 1) -> Index | None:
    """An index of every vector of `vectors`; codebooks are fitted on at most FIT_SAMPLE of them. None for an empty table."""
    sample = np.array([r.vec for r in bounded_sample(found, FIT_SAMPLE, "id").orderBy("id").collect()])
    if not len(sample):
        return None
    d, cut = sample.shape[1], (sample.shape[1] + 1) // 2
    halves = k_means(sample[:, :cut], codewords), k_means(sample[:, cut:], codewords)

    @F.pandas_udf("int")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, d))
            yield pd.Series(nearest(x[:, :cut], halves[0]) * len(halves[1]) + nearest(x[:, cut:], halves[1]), dtype=np.int32)

    # Ids of equal vectors: two rounds, so that no task gathers all ids of a vector that a third of the rows have.
    order = Window.partitionBy("vec", "salt").orderBy("id")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    few = salted.groupBy("vec", "salt").agg(F.collect_list("id").alias("ids")).groupBy("vec").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    entries = lineage_cut(few.select(cell("vec").alias("cell"), F.slice(F.array_sort("ids"), 1, keep).alias("ids"), "vec"))
    sizes = np.zeros(len(halves[0]) * len(halves[1]), np.int64)
    for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r.cell] = r.n
    return Index(entries, halves, sizes, d)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, least: float) -> list[int]:
    """Cells in order of the summed distances of their two codewords, until they hold `least` entries. The heap is offered the
    next pair of each row of pairs that has been entered, and the first of the row behind them."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, n, wide = first[a].tolist(), second[b].tolist(), sizes.tolist(), len(second)
    a, b, heap, taken, held = a.tolist(), b.tolist(), [(x[0] + y[0], 0, 0)], [], 0
    while heap and held < least:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * wide + b[j]
        if n[cell]:
            taken.append(cell)
            held += n[cell]
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        if j + 1 < wide:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
    return taken


def search(index: Index, queries: DataFrame, k: int = NEAREST, visited: float = VISITED, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k entries of largest inner product among those that each query (id, vec) visits,
    without its own id; ties go to the smaller id. Queries have distinct ids and the index's length of vectors."""
    halves, sizes, d, cut = index.halves, index.sizes, index.dimension, (index.dimension + 1) // 2
    n, least = int(sizes.sum()), max(LEAST_VISITED, visited * int(sizes.sum()))
    blocks, slices = max(1, -(-queries.count() // block)), max(1, -(-n // slice_))
    wide = -(-len(sizes) // 8)

    @F.pandas_udf("binary")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for v in batch:
                first, second = -halves[0] @ v[:cut], -halves[1] @ v[cut:]  # the larger the product, the nearer
                seen = np.zeros(wide * 8, np.uint8)
                seen[walk(first, second, sizes, least)] = 1
                out.append(np.packbits(seen).tobytes())
            yield pd.Series(out, dtype=object)

    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = queries.repartition(blocks * slices, "id").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(-1).alias("cell"), F.array("id").alias("ids"), "vec", cells("vec").alias("seen"))
    asked = asked.withColumn("slice", every(slices))
    held = index.entries.select("cell", "ids", "vec", F.lit(None).cast("binary").alias("seen"), F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int").alias("slice")).withColumn("block", every(blocks))
    met = held.unionByName(asked).repartition(blocks * slices, "block", "slice").sortWithinPartitions("block", "slice", "cell")
    best = met.select("block", "slice", "cell", "ids", "vec", "seen").mapInArrow(lambda batches: _scan(batches, d, k + 1), "query_id long, score double, ids array<long>")
    flat = best.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return flat.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Block:
    """The queries of a block and the best entries that each has met: scores, and ids as tuples."""

    def __init__(self, keep: int):
        self.keep, self.ids, self.found, self.seen, self.matrix = keep, [], [], [], None
        self.floor = np.zeros(0)

    def add(self, ids: list, vecs: np.ndarray, seen: list) -> None:
        self.ids += [x[0] for x in ids]
        self.seen += seen
        self.found += [[] for _ in ids]
        self.matrix = vecs if self.matrix is None else np.concatenate([self.matrix, vecs])

    def meet(self, cell: int, ids: list, vecs: np.ndarray) -> None:
        if self.matrix is None:
            return
        if len(self.floor) < len(self.ids):
            self.floor = np.full(len(self.ids), -np.inf)
            self.bits = np.unpackbits(np.frombuffer(b"".join(self.seen), np.uint8).reshape(len(self.seen), -1), axis=1).astype(bool)
        who = np.flatnonzero(self.bits[:, cell])
        for at in range(0, len(vecs), 4096):
            part = vecs[at : at + 4096]
            for q in range(0, len(who), 512):
                own = who[q : q + 512]
                rough = self.matrix[own] @ part.T
                # What rounding may move is kept and scored again, one product like another.
                i, j = np.nonzero(rough >= (self.floor[own] - 1e-9 * (1 + np.abs(self.floor[own])))[:, None])
                exact = (self.matrix[own[i]] * part[j]).sum(axis=1)
                for x, e, score in zip(own[i].tolist(), j.tolist(), exact.tolist(), strict=True):
                    best = self.found[x]
                    best.append((-score, ids[at + e]))
                    if len(best) >= 4 * self.keep:
                        self._cut(x)

    def _cut(self, x: int) -> None:
        best = self.found[x]
        best.sort()
        del best[self.keep :]
        if len(best) == self.keep:
            self.floor[x] = -best[-1][0]

    def result(self) -> pa.RecordBatch:
        rows = []
        for x, q in enumerate(self.ids):
            self.found[x].sort()
            rows += [(q, -s, list(ids)) for s, ids in self.found[x][: self.keep]]
        q, s, ids = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.float64()), pa.array(ids, pa.list_(pa.int64()))], ["query_id", "score", "ids"])


def _scan(batches: Iterator[pa.RecordBatch], d: int, keep: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, slice and cell; in each block and slice its queries stand first, with cell -1."""
    now, own = None, None
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        vecs = batch.column("vec").flatten().to_numpy().reshape(-1, d)
        ids, seen = batch.column("ids").to_pylist(), batch.column("seen").to_pylist()
        starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)] if len(key) else []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if (group := tuple(key[a, :2].tolist())) != now:
                if own is not None:
                    yield own.result()
                now, own = group, _Block(keep)
            if key[a, 2] < 0:
                own.add(ids[a:b], vecs[a:b], seen[a:b])
            else:
                own.meet(int(key[a, 2]), [tuple(x) for x in ids[a:b]], vecs[a:b])
    if own is not None:
        yield own.result()


def neighbours(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = NEAREST, visited: float = VISITED) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose key is divisible by `every`, against all rows.

    Vectors that are null, zero or hold null, NaN or infinite components take no part, nor do rows without key or with
    another length than most; see `vectors` for repeated keys. A table of up to LEAST_VISITED distinct vectors is searched
    whole, so that its result is exact. An empty table gives no rows; other columns don't matter."""
    found = lineage_cut(vectors(rows, key, vector))
    index = build(found, keep=k + 1)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, found.where(F.col("id") % every == 0), k, visited)
