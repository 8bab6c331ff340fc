import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricelens.llm import lm, queries

PUNCTUATION_FREE = "doc_id long, text string, score string"


@settings(max_examples=300, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 3000)), max_size=400))
def test_elias_fano_round_trip(values):
    x = np.array(sorted(values), np.uint64)
    code = lm.encode(x)
    assert (lm.access(code, np.arange(len(x))) == x).all()
    assert (lm.search(code, x) == np.arange(len(x))).all()
    others = np.array([v for v in {y ^ 1 for y in values} | {0, 2**64 - 1} if v not in values], np.uint64)
    assert (lm.search(code, others) == -1).all()


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 30), st.integers(0, 40)), min_size=1, max_size=200))
def test_levels_find_their_entries_alone(pairs):
    entries = sorted(pairs)
    parents, words = (np.array(x, np.int64) for x in zip(*entries, strict=True))
    code = lm.level(parents.astype(np.uint64), words)
    every = np.array([(a, b) for a in range(32) for b in range(42)], np.int64)
    want = {e: i for i, e in enumerate(entries)}
    assert lm.lookup(code, every[:, 0], every[:, 1]).tolist() == [want.get((a, b), -1) for a, b in every.tolist()]


def test_full_buckets_and_word_borders():
    """Runs of values with the same high bits, longer than a machine word."""
    x = np.array(sorted({*range(0, 3000, 1), *range(2**40, 2**40 + 500), *(2**45 + i * 2**30 for i in range(3000))}), np.uint64)
    code = lm.encode(x)
    assert (lm.search(code, x) == np.arange(len(x))).all() and (lm.access(code, np.arange(len(x))) == x).all()
    assert (lm.search(code, np.arange(3000, 9000, dtype=np.uint64)) == -1).all()


def test_tokens_of_odd_texts():
    texts = [" The\tCAT\u00a0sat ", None, "", " \n", "É é A", "x" * 100_000]
    distinct, tokens, starts = lm._tokens(texts)
    hashes = distinct[tokens]
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert hashes[a:b].tolist() == [lm.xxhash.xxh64_intdigest(lm.END if w is None else w) for w in words_of(text)]
    assert len(lm._tokens([])[1]) == 0 and len(lm._tokens([None, ""])[1]) == 2


def words_of(text):
    return [*(text or "").encode().lower().split(), None]


def brute(train, texts, order):
    """(n_tokens, n_known, base, score) with unquantised probabilities."""
    grams = [Counter() for _ in range(order + 1)]
    for t in train:
        w = words_of(t)
        for k in range(1, order + 1):
            grams[k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    n, v = sum(grams[1].values()), len(grams[1])

    def p(context, w):
        if not context:
            return (grams[1][w,] + lm.ADDED) / (n + lm.ADDED * (v + 1))
        return (grams[len(context) + 1][(*context, w)] + lm.PRIOR * p(context[1:], w)) / (grams[len(context)][context] + lm.PRIOR)

    out = []
    for t in texts:
        w = words_of(t)
        score = sum(log10(p(tuple(w[max(0, i - order + 1) : i]), x)) for i, x in enumerate(w))
        out.append((len(w), sum(grams[1][x,] > 0 for x in w), sum(log10(p((), x)) for x in w), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(spark, order):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.doc_id, r.text, "") for r in rows] + [(-1, None, ""), (-2, "", ""), (-3, "The the  THE\n the", ""), (-3, "The the  THE\n the", ""), (-4, "of the " * 100_000, "")]
    docs = spark.createDataFrame(texts, PUNCTUATION_FREE)
    learned = docs.where("doc_id % 3 <> 0")
    model = lm.train(learned, order, shard_tokens=20_000)
    want = {(i, t): x for (i, t, _), x in zip(texts, brute([t for i, t, _ in texts if i % 3], [t for _, t, _ in texts], order), strict=True)}
    assert model.shards > 1
    for r in lm.score(docs, model).collect():
        n, known, base, score = want[r.doc_id, r.text]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert abs(r.score - score) <= n * lm.STEP * order / 2 + 1e-6


def test_query_learns_from_its_fold_alone_and_beats_unigrams(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    train = [r.text for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10]
    want = {r.doc_id: x for r, x in zip(rows, brute(train, [r.text for r in rows], 1), strict=True)}
    got = queries.op10_lm(spark, sf).collect()
    assert {r.train_tokens for r in got} == {sum(len(words_of(t)) for t in train)}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_default_order_sees_two_words_before(spark):
    """After `b` alone both endings are as likely; the word before it tells them apart."""
    train = ["a b c"] * 20 + ["x b d"] * 20
    asked = ["a b c", "a b d", "x b c", "x b d"]
    frame = lambda texts: spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], PUNCTUATION_FREE)
    model = lm.train(frame(train))
    got = [r.score for r in lm.score(frame(asked), model).orderBy("doc_id").collect()]
    want = [x[3] for x in brute(train, asked, model.order)]
    assert model.order >= 3 and got == pytest.approx(want, abs=4 * lm.STEP * model.order / 2 + 1e-6)
    assert got[0] > got[1] + 0.5 and got[3] > got[2] + 0.5


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "")], PUNCTUATION_FREE)
    model = lm.train(docs.limit(0))
    assert model.tokens == 0 and lm.score(docs, model).count() == 1
    odd = docs.selectExpr("*", "5 AS _lm", "6 AS found")
    assert lm.score(odd, model).select("_lm", "found").first() == (5, 6)
    assert lm.score(docs.limit(0), lm.train(docs)).count() == 0
