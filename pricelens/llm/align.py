"""Alignment of the tokens of two tokenizers over a corpus, in Arrow.

A is a byte-level BPE, B a piece model that marks spaces. Both always cut before a single space between two words (no token
of either crosses it, see `Pair`), so a text falls apart into units, and a unit is tokenised and aligned once in a block of
documents however often it occurs there. In a block everything is a flat column with parent indices: tokens of units, units
of documents. Running sums of token lengths give byte ends; an Acero hash join on (unit, end) finds the places where
tokens of both end, which cut the groups; ranges of byte offsets give the links.

In how many documents a pair of ids is linked is counted in the block by `Table.group_by`, and Spark merges the partial
counts. The sums over a document's links need the merged counts of its block's pairs only: they are joined by pair and
come back to their block, where they are summed by unit and then by document. Texts are not shuffled.

A block is written and shuffled as many small rows: one to a document, and pieces of what its units link to. So neither a
writer nor a reader holds whole blocks as rows, and inside a block only a bounded number of units is worked on at once.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.common import shared_folder

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block (a longer text is a block of its own), and units whose groups are written out at once, and of
#: whose documents the pairs are counted at once.
BLOCK, WRITTEN = 4 << 20, 100_000
#: Units tokenised at once, and numbers in a row of a block's links or pairs.
PART = 1 << 13
#: Rows that go to a Python worker at once, what a row counts for in a block besides its text, and bytes of a row group:
#: a reader has a whole one in memory.
BATCH_ROWS, ROW, ROW_GROUP = 250, 100, 8 << 20
# Fixed value: how a byte-level BPE of this kind cuts a text before it merges bytes.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = 0x20
#: First bytes that may stand behind a cut: no space and no first byte of one (U+0085, U+00A0, U+1680, U+2000 and on, U+3000)
#: or of the mark of B.
_OPENS = np.array([0x21 <= c <= 0x7E or c >= 0x80 and c not in (0xC2, 0xE1, 0xE2, 0xE3) for c in range(256)])


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [c for c in range(256) if c not in plain]
    return {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(rest)}


class Pair:
    """Both tokenizers, from their files' bytes, with the bytes of every token.

    A must cut by CUTS before it merges, and merge in the order of its ids; then its own fast form gives the same ids. B must
    take texts as they are and have no piece with a space behind another character. A file of another kind is refused."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(a_file)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = [model["vocab"][x + y] for x, y in merges]
        if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or spec["normalizer"] or ranks != sorted(ranks):
            raise ValueError("A is no byte-level BPE that merges in the order of its ids")
        letters, special = byte_letters(), {t["content"] for t in spec.get("added_tokens") or []}
        vocab = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=CUTS, mergeable_ranks=vocab, special_tokens={})
        by_id = {i: t for t, i in vocab.items()}
        self.a_bytes = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        whole = "".join(map(chr, itertools.chain(range(1, 0xD800), range(0xE000, 0x20000))))
        if any("▁" in p.lstrip("▁") for p in pieces) or self.b.normalize(whole) != "▁" + whole.replace(" ", "▁"):
            raise ValueError("B changes texts or has pieces that go on behind a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.b_table = pa.array(self.b_bytes, pa.binary())
        self.a_names, self.b_names = (pa.array([str(i) for i in range(len(x))]) for x in (self.a_bytes, self.b_bytes))


@functools.lru_cache(maxsize=2)
def _loaded(a_file: bytes, b_file: bytes) -> Pair:
    return Pair(a_file, b_file)


def _data(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and its offsets in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, so many at a time; 0 where there are none."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indices of ranges, one range after the other."""
    return np.repeat(starts - _starts(counts), counts) + np.arange(counts.sum())


def units_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of space+text of every text (none empty), one after the other, and how many each text has."""
    spaced = pc.binary_join_element_wise(pa.scalar(""), texts, " ")
    data, offsets = _data(spaced)
    first, last = int(offsets[0]), int(offsets[-1])
    b = data[first:last]
    cuts = np.flatnonzero((b[1:-1] == SPACE) & (b[:-2] > SPACE) & _OPENS[b[2:]]) + 1 + first
    starts = np.union1d(cuts, offsets[:-1])
    edges = pa.py_buffer(np.append(starts, last).astype(np.int32).tobytes())
    flat = pa.StringArray.from_buffers(len(starts), edges, spaced.buffers()[2])
    return flat, np.diff(np.append(np.searchsorted(starts, offsets[:-1]), len(starts)))


class Aligned:
    """Distinct units, tokenised and aligned, PART at a time. fine: the units whose tokens' bytes are the unit's own."""

    def __init__(self, pair: Pair, words: pa.Array):
        parts = [_Part(pair, words.slice(k, PART)) for k in range(0, max(len(words), 1), PART)]
        self.fine, self.n_a, self.n_b, self.n_groups, self.n_links = (np.concatenate([getattr(p, c) for p in parts]) for c in ("fine", "n_a", "n_b", "n_groups", "n_links"))
        self.text = pa.concat_arrays([p.text for p in parts])
        pairs, same = np.unique(np.concatenate([p.pairs for p in parts]), return_inverse=True)
        self.pairs_a, self.pairs_b = pairs >> 32, pairs & 0xFFFFFFFF
        starts = _starts(np.array([len(p.pairs) for p in parts]))
        self.links = np.concatenate([same[s + p.links].astype(np.int32) for s, p in zip(starts, parts, strict=True)])


class _Part:
    """Units tokenised and aligned at once; links are places in pairs, the part's own distinct ones."""

    def __init__(self, pair: Pair, words: pa.Array):
        data, offsets = _data(words)
        sizes = np.diff(offsets).astype(np.int64)
        a_ids, a_counts = self._encode_a(pair, words, data, offsets, sizes)
        lists = pair.b.encode([w[1:] for w in words.to_pylist()], num_threads=1)
        b_counts = np.array([len(x) for x in lists], np.int64)
        b_ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, b_counts.sum())
        self.fine = (_sums(pair.b_sizes[b_ids], b_counts) == sizes) & (_sums(pair.a_sizes[a_ids], a_counts) == sizes)
        some = np.flatnonzero(self.fine)
        same, _ = _data(pair.b_table.take(pa.array(b_ids[np.repeat(self.fine, b_counts)])))
        own, _ = _data(words.take(pa.array(some)))
        odd = np.flatnonzero(same != own)
        self.fine[some[np.unique(np.searchsorted(np.cumsum(sizes[some]), odd, "right"))]] = False

        # From here on only tokens of fine units; places are byte offsets over all units.
        keep_a, keep_b = np.repeat(self.fine, a_counts), np.repeat(self.fine, b_counts)
        a_ids, b_ids = a_ids[keep_a], b_ids[keep_b]
        self.n_a, self.n_b = np.where(self.fine, a_counts, 0), np.where(self.fine, b_counts, 0)
        every = np.arange(len(words))
        a_unit, b_unit = np.repeat(every, self.n_a), np.repeat(every, self.n_b)
        a_end, b_end = np.cumsum(pair.a_sizes[a_ids]), np.cumsum(pair.b_sizes[b_ids])
        a_start, b_start = a_end - pair.a_sizes[a_ids], b_end - pair.b_sizes[b_ids]

        left = pa.table({"unit": a_unit, "end": a_end, "i": np.arange(len(a_end))})
        both = left.join(pa.table({"unit": b_unit, "end": b_end, "j": np.arange(len(b_end))}), ["unit", "end"], join_type="inner", use_threads=False)
        i, j = np.sort(both["i"].to_numpy()), np.sort(both["j"].to_numpy())
        self.n_groups = np.bincount(a_unit[i], minlength=len(words))
        listed = lambda names, ids, at: pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, at + 1), pa.int32()), names.take(pa.array(ids))), ",")
        groups = pc.binary_join_element_wise(listed(pair.a_names, a_ids, i), listed(pair.b_names, b_ids, j), "|")
        self.text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.n_groups)), pa.int32()), groups), ";")

        first = np.searchsorted(b_end, a_start, "right")
        n = np.searchsorted(b_start, a_end, "left") - first
        code = (np.repeat(a_ids, n) << 32) | b_ids[_ragged(first, n)]
        self.pairs, self.links = np.unique(code, return_inverse=True)
        self.n_links = np.bincount(np.repeat(a_unit, n), minlength=len(words))

    @staticmethod
    def _encode_a(pair: Pair, words: pa.Array, data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A, and how many each unit has. Units with a word at both ends are read as one text: A cuts between them."""
        fits = (sizes > 1) & _OPENS[data[np.minimum(offsets[:-1] + 1, len(data) - 1)]] & (data[offsets[1:] - 1] > SPACE)
        plain, rest = np.flatnonzero(fits), np.flatnonzero(~fits)
        text, edges = _data(words.take(pa.array(plain)))
        ids = np.array(pair.a.encode_ordinary(text.tobytes().decode()), np.int64)
        of = np.searchsorted(edges[1:], np.cumsum(pair.a_sizes[ids]), "left")
        counts = np.zeros(len(words), np.int64)
        counts[plain] = np.bincount(of, minlength=len(plain))[: len(plain)]
        lists = [pair.a.encode_ordinary(words[int(k)].as_py()) for k in rest]
        counts[rest] = [len(x) for x in lists]
        out, starts = np.zeros(counts.sum(), np.int64), _starts(counts)
        out[_ragged(starts[plain], counts[plain])] = ids
        out[_ragged(starts[rest], counts[rest])] = np.fromiter(itertools.chain.from_iterable(lists), np.int64, counts[rest].sum())
        return out, counts


def encode_block(pair: Pair, ids: pa.Array, texts: pa.Array) -> dict:
    """A block of documents: their own results, their units as numbers, the units' links, and of each pair of ids in how many
    of the block's documents it is linked."""
    known = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
    flat, counts = units_of(texts.take(pa.array(known)))
    coded = flat.dictionary_encode()
    own, found = coded.indices.to_numpy().astype(np.int64), Aligned(pair, coded.dictionary)
    fine = _sums(~found.fine[own], counts) == 0
    own, known, counts = own[np.repeat(fine, counts)], known[fine], counts[fine]
    n = {c: np.zeros(len(texts), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
    for c, values in n.items():
        values[known] = _sums(getattr(found, c)[own], counts)
    hashes, units = [""] * len(texts), np.zeros(len(texts), np.int64)
    for k, h in zip(known.tolist(), _hashes(found.text, own, counts), strict=True):
        hashes[k] = h
    units[known] = counts
    seen_in, first = np.zeros(len(found.pairs_a), np.int64), _starts(found.n_links)
    ends = np.cumsum(counts)
    low = 0
    for high in [*(np.flatnonzero(np.diff(ends // WRITTEN)) + 1).tolist(), len(known)]:
        doc, unit = np.repeat(np.arange(high - low, dtype=np.int32), counts[low:high]), own[ends[low - 1] if low else 0 : ends[high - 1] if high else 0]
        seen = pa.table({"doc": doc, "unit": unit.astype(np.int32)}).group_by(["doc", "unit"], use_threads=False).aggregate([])
        doc, unit = seen["doc"].to_numpy(), seen["unit"].to_numpy()
        linked = found.links[_ragged(first[unit], found.n_links[unit])]
        once = pa.table({"doc": np.repeat(doc, found.n_links[unit]), "pair": linked}).group_by(["doc", "pair"], use_threads=False).aggregate([])
        seen_in += np.bincount(once["pair"].to_numpy(), minlength=len(seen_in))
        low = high
    at = np.flatnonzero(seen_in)
    return {
        "doc_ids": ids, **n, "hashes": hashes, "units": units, "own": own, "unit_links": found.n_links, "links": found.links,
        "at": at, "a": found.pairs_a[at], "b": found.pairs_b[at], "n": seen_in[at],
    }


def _hashes(text: pa.Array, own: np.ndarray, counts: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups, written out a bounded number of units at a time."""
    out, at, hasher = [], 0, None
    ends = np.cumsum(counts)
    for low in range(0, len(own), WRITTEN):
        high = min(low + WRITTEN, len(own))
        edges = np.unique(np.concatenate(([low, high], ends[(ends > low) & (ends < high)])))
        parts = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges - low, pa.int32()), text.take(pa.array(own[low:high]))), ";")
        for end, part in zip(edges[1:].tolist(), parts.cast(pa.binary()).to_pylist(), strict=True):
            if hasher is None:
                hasher = hashlib.sha256(part)
            else:
                hasher.update(b";" + part)
            if end == ends[at]:
                out.append(hasher.hexdigest())
                at, hasher = at + 1, None
    return out


def _rows(block: int, made: dict) -> Iterator[pa.RecordBatch]:
    """A row to a document, with its units as packed numbers; then the links of the block's units and its pairs, PART of each
    to a row, whose place says which."""
    ints = pa.list_(pa.int32())
    schema = pa.schema(
        [("block", pa.int64()), ("doc_id", made["doc_ids"].type), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("hash", pa.string()), ("own", pa.binary())]
        + [("place", pa.int32()), ("unit_links", pa.binary()), ("links", pa.binary()), *((c, ints) for c in ("at", "a", "b", "n"))]
    )

    def batch(rows: int, **columns) -> pa.RecordBatch:
        columns["block"] = np.full(rows, block)
        return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema)

    pack = lambda x: x.astype(np.int32).tobytes()
    edges = pa.py_buffer(pack(np.append(0, np.cumsum(made["units"])) * 4))
    own = pa.Array.from_buffers(pa.binary(), len(made["units"]), [None, edges, pa.py_buffer(pack(made["own"]))])
    yield batch(len(own), doc_id=made["doc_ids"], hash=made["hashes"], own=own, **{c: made[c] for c in ("n_a", "n_b", "n_groups", "n_links")})
    lows = range(0, max(len(made[c]) for c in ("unit_links", "links", "at")), PART)
    cut = lambda c: [made[c][k : k + PART] for k in lows]
    yield batch(len(lows), place=np.arange(len(lows)), **{c: [pack(x) for x in cut(c)] for c in ("unit_links", "links")}, **{c: cut(c) for c in ("at", "a", "b", "n")})


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of consecutive documents, so many bytes together, one document at least."""
    held, room = [], size
    told = lambda: tuple(pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "text"))
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW)
        at = 0
        while at < batch.num_rows:
            gone = int(upto[at - 1]) if at else 0
            end = max(at if held else at + 1, int(np.searchsorted(upto, gone + room, "right")))
            if end > at:
                held.append(batch.slice(at, end - at))
                room -= int(upto[end - 1]) - gone
                at = end
            if at < batch.num_rows:
                yield told()
                held, room = [], size
    if held:
        yield told()


_PACKED = "n_a long, n_b long, n_groups long, n_links long, hash string, own binary, place int, unit_links binary, links binary, at array<int>, a array<int>, b array<int>, n array<int>"


def encode(docs: DataFrame, folder: str = FOLDER, size: int = BLOCK) -> DataFrame:
    """Blocks of documents (see `_rows`), written to the shared folder once: tokens are never made twice."""
    spark = docs.sparkSession
    files = []
    for name in (A_FILE, B_FILE):
        with open(f"{folder}/{name}", "rb") as f:
            files.append(f.read())
    Pair(*files)  # refused here rather than in a task
    sent = spark.sparkContext.broadcast(files)  # two vocabularies: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, home = _loaded(*sent.value), TaskContext.get().partitionId() << 32
        for n, (ids, texts) in enumerate(_blocks(batches, size)):
            yield from _rows(home + n, encode_block(pair, ids, texts))

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"block long, doc_id {kind}, {_PACKED}")
    written, name = shared_folder(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))  # workers keep the memory that a batch of texts once took
    try:
        made.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(written)
    finally:
        spark.conf.set(name, before)
    return _read(spark, written, made)


def _read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(folder)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents of the corpus each pair of ids is linked, and whether no pair of its a has more."""
    part = blocks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("x.a", "x.b", "x.n")
    total = part.groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("n"))
    return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))  # at most B's vocabulary to an a


def align(docs: DataFrame, folder: str = FOLDER, size: int = BLOCK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs.

    A text that is null or empty, or whose tokens' bytes are not those of space+text, has zeros and an empty hash, and counts
    for no pair. Rows that repeat a doc_id or are null there stay rows and documents of their own; other columns don't matter.
    A very long text is a block of its own: it needs memory in proportion to its length. An empty table gives no rows."""
    blocks = encode(docs, folder, size)
    asked = blocks.select(F.col("block").alias("home"), F.explode(F.arrays_zip("at", "a", "b")).alias("x")).select("home", "x.at", "x.a", "x.b")
    told = asked.join(pair_counts(blocks), ["a", "b"]).select("home", "at", "n", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        known, pieces = left.filter(pc.is_null(left["place"])), left.filter(pc.is_valid(left["place"])).sort_by("place")
        ints = lambda rows, c: np.frombuffer(b"".join(rows[c].to_pylist()), np.int32)
        own, counts, links = ints(known, "own"), ints(pieces, "unit_links"), ints(pieces, "links")
        units, at = pc.binary_length(known["own"]).to_numpy() // 4, right["at"].to_numpy()
        sums = []
        for c in ("best", "n"):
            by_pair = np.zeros(int(links.max(initial=-1)) + 1, np.int64)
            by_pair[at] = right[c].to_numpy()
            sums.append(pa.array(_sums(_sums(by_pair[links], counts)[own], units)))
        columns = [*(known[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, known["hash"]]
        return pa.table(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kept = blocks.drop("at", "a", "b", "n")
    return kept.groupBy("block").cogroup(told.groupBy("home")).applyInArrow(total, result)
