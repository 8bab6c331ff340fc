import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricelens.llm import simhash

SCHEMA = "doc_id long, text string"


def brute_groups(fps: list[int], radius: int = 4) -> list[int]:
    """The smallest index that each fingerprint reaches."""
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprint_follows_the_rule():
    words = "The cat sat on THE mat Ä".split(" ")
    low = [w.lower() if w != "Ä" else w for w in words]
    hashes = [xxhash.xxh64_intdigest(" ".join(low[i : i + 4]).encode(), 42) for i in range(len(low) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(" The cat\tsat on THE\nmat Ä") == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("one Two") == xxhash.xxh64_intdigest(b"one two", 42)


def test_every_near_pair_shares_a_bucket():
    draw = np.random.default_rng(1)
    for _ in range(500):
        bits = draw.choice(64, 4, replace=False)
        flip = sum(1 << int(b) for b in bits)
        assert any(flip & (m % 2**64) == 0 for m in simhash.masks())


@pytest.mark.parametrize("crowd", [1, 400])
def test_groups_match_brute_force(spark, crowd):
    """Chains, a dense ball and far points; crowd 1 sends all through shared values."""
    draw = np.random.default_rng(2)
    fps = [int(x) for x in draw.integers(0, 2**63, 20)]
    at = fps[0]
    for _ in range(30):  # a chain
        at ^= (1 << int(draw.integers(0, 63))) | (1 << int(draw.integers(0, 63)))
        fps.append(at)
    fps += [fps[1] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 63, (40, 2))]  # a ball
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    label = {r.node: r.label for r in simhash.groups(simhash.links(nodes, crowd=crowd)).collect()}
    got = [label.get(f, f) for f in fps]
    want = brute_groups(fps)
    assert len({*zip(got, want, strict=True)}) == len({*got}) == len({*want})
    assert all(label[f] <= f for f in label)


def test_whole_query_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    fps = [simhash.fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", rows[g].doc_id) for r, f, g in zip(rows, fps, brute_groups(fps), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_edges_of_the_input(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e"), (3, "a b c d e"), (4, "A B C D E"), (None, "far away from all of these words")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", component_id string")
    got = simhash.near_duplicates(docs.drop("component_id")).select("doc_id", "component_id").distinct().collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3), (4, 3), (None, None)}
    assert sorted((r.doc_id or 0) for r in simhash.keep_first(docs).collect()) == [0, 1, 3]
    assert simhash.keep_first(docs).columns == docs.columns
    assert simhash.components(docs.limit(0)).count() == 0


def test_keep_first_tells_rows_apart_that_share_an_id(spark):
    """Groups are of texts: ids that are null or repeat stand in more than one, and each group keeps one row."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (3, c), (5, c), (5, d), (7, e), (None, e)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", fp string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, a), (0, b), (3, c), (5, d), (7, e)])
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_long_text(spark):
    text = "word" + " other word" * 200_000
    assert simhash.components(spark.createDataFrame([(1, text)], SCHEMA)).select(F.count("fp")).first()[0] == 1
