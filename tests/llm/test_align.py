import hashlib
from collections import Counter, defaultdict
from functools import reduce
from operator import add

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pricelens.llm import align

SF = "/root/testdata/sf0.001"
A_PATH, B_PATH = f"{align.FOLDER}/{align.A_FILE}", f"{align.FOLDER}/{align.B_FILE}"
LETTERS = {v: k for k, v in align.byte_letters().items()}
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers by their own libraries, and the bytes of a token of each."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    letter = align.byte_letters()
    a_bytes = lambda i: bytes(letter[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def read(text):
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
        return [[(i, name(i)) for i in x] for x, name in zip(ids, (a_bytes, b_bytes), strict=True)]

    return read


def brute(texts, plain):
    """Each text by itself: whole texts, byte by byte."""
    docs, seen = [], defaultdict(set)
    for k, text in enumerate(texts):
        both = plain(text) if text else [[], []]
        if text and any(b"".join(x for _, x in side) != (" " + text).encode() for side in both):
            both = [[], []]
        spans = []
        for side in both:
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        shared = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [[[str(i) for i, s, e in side if low <= s and e <= high] for side in spans] for low, high in zip([0, *shared], shared, strict=False)]
        over, links, j = spans[1], [], 0
        for i, s, e in spans[0]:
            while over[j][2] <= s:
                j += 1
            m = j
            while m < len(over) and over[m][1] < e:
                links.append((i, over[m][0]))
                m += 1
        for pair in links:
            seen[pair].add(k)
        text_of = ";".join("|".join(",".join(x) for x in g) for g in groups)
        docs.append((len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(text_of.encode()).hexdigest() if groups else ""))
    counts, most = {p: len(x) for p, x in seen.items()}, Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(a, b, g, len(x), sum(counts[p] == most[p[0]] for p in x), sum(counts[p] for p in x), h) for a, b, g, x, h in docs]


def got(spark, texts, **more):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, block string, n_a int").repartition(3)
    return [tuple(r[c] for c in NAMES) for r in sorted(align.align(frame, **more).collect(), key=lambda r: r.doc_id)]


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b  ", "a\n\n b\t c \r\n", "<|endoftext|> <s></s> <unk> <0x41>", "x▁y", "▁", "no break   　 wide   em", "你好 世界。 \U0001f600\U0001f468‍\U0001f469",
    "café naïve é", "\x00 \x01\x7f", "it's we'll 'tis  don't", "a" * 5000, "1234567 890 " * 30, "tab\there", "﻿bom", "same words", "same words", "   x", "end " * 3, "ã âb Âc ád",
]


@pytest.mark.parametrize("size", [1, 100, align.BLOCK])
def test_odd_texts_equal_brute_force(spark, plain, size):
    assert got(spark, ODD, size=size) == brute(ODD, plain)


def test_whole_table_equals_brute_force(spark, plain, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert got(spark, texts, size=50_000) == brute(texts, plain)


def test_repeated_and_null_ids_and_empty_tables(spark, plain):
    frame = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "two one"), (None, None)], "doc_id long, text string")
    rows = sorted(tuple(r[c] for c in NAMES) for r in align.align(frame).collect())
    assert rows == sorted(brute(["one two", "one two", "two one", None], plain))
    assert align.align(frame.limit(0)).count() == 0


def test_blocks_are_written_as_small_rows_and_row_groups(spark):
    """A block as one row of several MB filled executors at 6 GB: writers, readers and sorts held many of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 2000).alias("text")).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks = align.encode(docs.union(docs).coalesce(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    sizes = [F.coalesce(F.octet_length(c) if kind == "binary" else 8 * F.size(c), F.lit(0)) for c, kind in blocks.dtypes if kind == "binary" or kind.startswith("array")]
    made = blocks.select("block", reduce(add, sizes).alias("size")).groupBy("block").agg(F.sum("size").alias("all"), F.max("size").alias("most")).collect()
    assert len(made) == 1 and made[0].all > 500_000 and made[0].most <= 40 * 8192
    for path in blocks.inputFiles():
        groups = pq.ParquetFile(path.removeprefix("file:")).metadata
        assert all(groups.row_group(k).total_byte_size < 16 << 20 for k in range(groups.num_row_groups))


def test_blocks_go_over_batches_and_hold_one_long_text():
    texts = ["a" * 300, None, "b" * 1200, "", "c" * 100, "d" * 100]
    made = align._blocks(iter(pa.record_batch({"doc_id": [k], "text": pa.array([x], pa.string())}) for k, x in enumerate(texts)), 1000)
    assert [(ids.to_pylist(), x.to_pylist()) for ids, x in made] == [([0, 1], texts[:2]), ([2], texts[2:3]), ([3, 4, 5], texts[3:])]


def test_long_documents_are_hashed_in_parts(plain, monkeypatch):
    monkeypatch.setattr(align, "WRITTEN", 7)
    pair = align.Pair(open(A_PATH, "rb").read(), open(B_PATH, "rb").read())
    texts = ["many words in a text that is longer than a part " * 3, "x", "seven words are just one part here"]
    made = align.encode_block(pair, pa.array([1, 2, 3]), pa.array(texts))
    assert made["hashes"] == [x[-1] for x in brute(texts, plain)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t ▁'a1.你"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=30), min_size=1, max_size=5))
def test_units_are_tokenised_as_whole_texts(texts):
    pair = _pair()
    flat, counts = align.units_of(pa.array(texts))
    units, at = flat.to_pylist(), 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        own = units[at : at + n]
        at += n
        assert "".join(own) == " " + text
        assert [i for u in own for i in pair.a.encode_ordinary(u)] == _whole().encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert [i for u in own for i in pair.b.encode(u[1:])] == pair.b.encode(text)


_kept = {}


def _pair():
    if "pair" not in _kept:
        _kept["pair"] = align.Pair(open(A_PATH, "rb").read(), open(B_PATH, "rb").read())
    return _kept["pair"]


def _whole():
    if "a" not in _kept:
        _kept["a"] = Tokenizer.from_file(A_PATH)
        _kept["a"].encode_special_tokens = True
    return _kept["a"]


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises(ValueError):
        align.Pair(open(f"{align.FOLDER}/word_bpe_49k.json", "rb").read(), open(B_PATH, "rb").read())
