"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items are numbered and one automaton is built over the items' word sequences; each of its states
stands for the word sequences that end at the same places of the items. A document's words are streamed through it,
which gives at every word the length of the longest sequence ending there that some item contains. Where that length
reaches a window (13 words, or a whole item that is shorter), the words of the match are hit.

The automaton is broadcast, so it covers a bounded number of item words: a larger benchmark is cut into blocks of items,
each with an automaton of its own. Then one pass over the documents first asks, for all blocks at once, whether any window of
a document may be an item's: hashes of all items' windows set bits of a table of fixed size, which tasks count together. Only
documents that may be hit are streamed, once for each block and one job after the other, so that no worker ever holds
more than one automaton. A full table lets more documents through, it loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import fresh, lineage_cut

WINDOW = 13
#: A document is contaminated if at least this part of its words is hit: 1 / 20.
COVERAGE = 20
#: Item words to an automaton; it takes some 600 bytes a word.
BLOCK_WORDS = 100_000
#: The table of windows has 2 ** this many bits (16 MB).
TABLE_BITS = 27
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: ASCII letters to lower case, every other ASCII byte that is no letter or digit to a space; the rest stays.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


#: The words of a text as it is, for Spark.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """Suffix automaton over the word sequences of items (name, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        coded = [[self.number.setdefault(w, len(self.number)) for w in words] for _, words in items]
        for words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: Items by the state that holds one of their windows, with the window's length.
        self.marks: dict[int, dict[int, set[int]]] = {}
        for item, words in enumerate(coded):
            size, state = min(window, len(words)), 0
            for at, w in enumerate(words):
                state = self.next[state][w]
                if at + 1 >= size:  # the state of the last `size` words is up the links
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                    self.marks.setdefault(state, {}).setdefault(size, set()).add(item)
        #: The nearest marked state up the links, the state itself included.
        self.nearest = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.nearest[state] = state if state in self.marks else self.nearest[self.link[state]] if state else -1
        self.shortest = min((min(window, len(w)) for w in coded if w), default=0)

    def _state(self, length: int, link: int, go: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(go)
        return len(self.link) - 1

    def _split(self, above: int, w: int) -> int:
        """The state that above reaches by w, split if it also stands for longer sequences."""
        to = self.next[above][w]
        if self.length[to] == self.length[above] + 1:
            return to
        copy = self._state(self.length[above] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while above >= 0 and self.next[above].get(w) == to:
            self.next[above][w] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # another item has been here
            return self._split(last, w)
        new, above = self._state(self.length[last] + 1, 0, {}), last
        while above >= 0 and w not in self.next[above]:
            self.next[above][w] = new
            above = self.link[above]
        if above >= 0:
            self.link[new] = self._split(above, w)
        return new

    def matches(self, coded: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) at each word: the longest sequence ending there that an item contains."""
        state = size = 0
        go, link, length = self.next, self.link, self.length
        for at, w in enumerate(coded):
            to = go[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = go[state].get(w)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            yield at, size, state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of words (start, end), in order and apart, and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        if not self.shortest or len(words) < self.shortest:
            return spans, items
        coded = np.fromiter(map(self.number.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([False], coded >= 0, [False]))))
        # A word that no item has sends the automaton to its start, so only runs of known words need streaming.
        for begin, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - begin < self.shortest:
                continue
            for at, size, state in self.matches(coded[begin:end].tolist()):
                mark, most, seen = self.nearest[state] if size >= self.shortest else -1, size, 0
                while mark > 0:
                    for length, found in self.marks[mark].items():
                        if length <= most:
                            items |= found
                            seen = max(seen, length)
                    mark = self.nearest[self.link[mark]]
                if seen:
                    start = begin + at + 1 - (size if size >= self.window and seen == self.window else seen)
                    if spans and spans[-1][1] >= start:
                        spans[-1] = (min(spans[-1][0], start), begin + at + 1)
                        while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                            last = spans.pop()
                            spans[-1] = (min(spans[-1][0], last[0]), last[1])
                    else:
                        spans.append((start, begin + at + 1))
        return spans, items


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items that have words, in blocks of bounded size; partitions come to the driver one after the other."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("name"), "text").toLocalIterator():
        if words := words_of(row.text):
            if block and size + len(words) > most:
                yield block
                block, size = [], 0
            block.append((row.name or "", words))
            size += len(words)
    yield block


def windows(words: list[bytes], sizes: list[int]) -> np.ndarray:
    """Places in the table of all windows of these sizes, longer ones after shorter ones."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out, rolled = [], hashes
    for size in range(1, min(max(sizes, default=0), len(words)) + 1):
        if size > 1:
            rolled = rolled[:-1] * _BASE + hashes[size - 1 :]
        if size in sizes:
            mixed = (rolled ^ (rolled >> np.uint64(29))) * _MIX
            out.append((mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def window_table(benchmark: DataFrame, window: int) -> tuple[np.ndarray, list[int]]:
    """The table's bits, packed, and the sizes of windows that there are. Tasks hash the items and merge their bits; 64 of them
    are a row, so the driver gets a bounded number of rows whatever the benchmark's size."""

    @F.pandas_udf("size int, places array<long>")
    def hashed(texts: pd.Series) -> pd.DataFrame:
        split = [words_of(t) for t in texts]
        sizes = [min(window, len(w)) for w in split]
        return pd.DataFrame({"size": sizes, "places": [windows(w, [n]) if n else np.zeros(0, np.int64) for w, n in zip(split, sizes, strict=True)]})

    rows = lineage_cut(benchmark.select(hashed("text").alias("x")).select("x.*"))
    sizes = sorted(r["size"] for r in rows.select("size").distinct().collect() if r["size"])
    bits = rows.select(F.explode("places").alias("p")).groupBy(F.floor(F.col("p") / 64).alias("row")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[bits["row"].to_numpy(np.int64)] = bits["bits"]
    return table, sizes


def may_hit(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The documents of which some window's bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(window_table(benchmark, window))  # 16 MB and a few numbers

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        table, sizes = shared.value
        at = [windows(words_of(t), sizes) for t in texts]
        return pd.Series([bool(((table[p >> 6] >> (p & 63)) & 1).any()) for p in at], dtype=bool)

    return docs.where(known("text"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with n_words, hits (array of start, end in words) and items (array of item ids, sorted as strings).

    Null and empty texts have no words and no hits, very long ones are streamed whole. Items without words never hit; items that
    share an id count as one. A document's row is handled by itself, whatever its doc_id, so repeated rows agree; an empty
    table gives no rows, an empty benchmark no hits. Existing columns with these names are replaced."""
    docs = docs.drop("n_words", "hits", "items")
    spark = docs.sparkSession
    result = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"

    def scan(shared):
        @F.pandas_udf(result)
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            automaton = shared.value
            for texts in batches:
                rows = []
                for words in map(words_of, texts):
                    spans, items = automaton.hits(words)
                    rows.append((len(words), [{"start": a, "end": b} for a, b in spans], sorted({automaton.names[i] for i in items})))
                yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

        return found("text")

    row, name = fresh([*docs.columns, "spans", "items"], "row", "found")
    parts = blocks(benchmark, block_words)
    block, after = next(parts), next(parts, None)
    if after is None:
        found = docs.withColumn(name, scan(spark.sparkContext.broadcast(Automaton(block, window))))
        return found.select(*docs.columns, F.col(name)["n_words"].alias("n_words"), F.col(name)["spans"].alias("hits"), F.col(name)["items"].alias("items"))
    docs = lineage_cut(docs.withColumn(row, F.monotonically_increasing_id()))
    texts, hit = lineage_cut(may_hit(docs.select(row, "text"), benchmark, window)), None
    while block is not None:
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        some = lineage_cut(texts.withColumn(name, scan(shared)).where(F.size(F.col(name)["spans"]) > 0).select(row, f"{name}.spans", f"{name}.items"))
        shared.unpersist()
        hit = some if hit is None else hit.unionByName(some)
        block, after = after, next(parts, None)
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for spans in batches:
            yield pd.Series([[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in s])] for s in spans], dtype=object)

    whole = hit.groupBy(row).agg(F.flatten(F.collect_list("spans")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    whole = whole.withColumn("hits", joined("hits"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    counted = docs.join(whole, row, "left").withColumn("n_words", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    return counted.withColumn("hits", none("hits", "array<struct<start:int,end:int>>")).withColumn("items", none("items", "array<string>")).drop(row)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch made one; each is looked at once."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """find_hits() with n_hit (words hit), n_items and contaminated (n_hit > 0 and coverage * n_hit >= n_words)."""
    found = find_hits(docs, benchmark, window, block_words)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    counted = found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long")})
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words")))


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without these spans of words, with what stands between their words; the text around them stays as it is."""
    if text is None or not spans:
        return text
    coded = text.encode("utf-8", "surrogatepass")
    flat = np.frombuffer(coded.translate(_TABLE), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flat, [False]))))
    out, at = [], 0
    for start, end in spans:
        out.append(coded[at : edge[2 * start]])
        at = edge[2 * end - 1]
    return b"".join([*out, coded[at:]]).decode("utf-8", "surrogatepass")


def remove_spans(found: DataFrame) -> DataFrame:
    """The text of rows of find_hits() without the hit spans; rows without hits stay as they are."""

    @F.pandas_udf("string")
    def removed(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return found.withColumn("text", F.when(F.size("hits") > 0, removed("text", "hits")).otherwise(F.col("text")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents whose hit words stay below the coverage limit, without their hit spans; the columns are those of docs.
    n_chars, where docs has it, is counted anew for texts that were cut."""
    row = fresh(["text"], "row")[0]
    found = decontaminate(docs.select(F.struct(*docs.columns).alias(row), "text"), benchmark, window, coverage, block_words)
    kept = remove_spans(found.where(~F.col("contaminated")))
    given = {c: F.col("text") if c.lower() == "text" else F.col(row)[c] for c in docs.columns}
    for f in docs.schema:
        if f.name.lower() == "n_chars":
            given[f.name] = F.when(F.size("hits") > 0, F.char_length("text").cast(f.dataType)).otherwise(F.col(row)[f.name])
    return kept.select(*[x.alias(c) for c, x in given.items()])
