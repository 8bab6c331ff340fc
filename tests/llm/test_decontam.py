import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelens.llm import decontam

texts = st.lists(st.sampled_from("abcd"), max_size=40)


def brute(words, items, window):
    hit, found = set(), set()
    for name, item in items:
        k = min(window, len(item))
        wins = {tuple(item[i : i + k]) for i in range(len(item) - k + 1)} if item else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in wins:
                hit.update(range(i, i + k))
                found.add(name)
    return hit, found


@settings(max_examples=400, deadline=None)
@given(texts, st.lists(texts, max_size=5), st.integers(1, 6))
def test_automaton_matches_brute_force(words, items, window):
    named = [(str(i), w) for i, w in enumerate(items) if w]
    machine = decontam.Automaton(named, window)
    spans, found = machine.hits(words)
    hit, want = brute(words, named, window)
    assert {x for a, b in spans for x in range(a, b)} == hit
    assert {machine.names[i] for i in found} == want
    assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_words():
    assert [w.decode() for w in decontam.words_of("It's É9, ok_no\x00Z")] == ["it", "s", "É9", "ok", "no", "z"]


def tables(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (30, 20, 13, 5, 40)]
    clean = " ".join(word() for _ in range(200))
    docs = [(1, clean), (2, f"{clean} {items[0]}"), (3, f"x, {items[3].upper()}! y"), (4, None), (5, ""), (5, items[1][:40]), (None, items[2]), (7, f"{items[1]} {items[1]} {items[4]}")]
    docs.append((8, f"{clean} " * 3000 + items[4]))
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, " ,"), (0, items[0])], "item_id long, text string")
    return spark.createDataFrame([(*d, i) for i, d in enumerate(docs)], "doc_id long, text string, n_hit int"), bench, docs, items


def test_operator_matches_brute_force_in_any_number_of_blocks(spark):
    frame, bench, docs, items = tables(spark)
    named = [(str(i), decontam.words_of(t)) for i, t in enumerate(items)]
    for block_words in (100_000, 30):
        odd = frame.withColumn("row", F.col("n_hit")).withColumn("found0", F.lit(7)).withColumn("found", F.lit(8))
        got = decontam.decontaminate(odd, bench, block_words=block_words).collect()
        assert {(r.found0, r.found) for r in got} == {(7, 8)}
        assert len(got) == len(docs)
        for r in got:
            words = decontam.words_of(docs[r.row][1])
            hit, found = brute(words, named, 13)
            assert (r.n_words, r.n_hit, r["items"]) == (len(words), len(hit), sorted(found))
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))


def test_spans_are_cut_and_no_window_is_left(spark):
    frame, bench, docs, items = tables(spark)
    named = [(str(i), decontam.words_of(t)) for i, t in enumerate(items)]
    rows = decontam.remove_spans(decontam.find_hits(frame, bench)).select("text").collect()
    assert all(not brute(decontam.words_of(r.text), named, 13)[0] for r in rows)
    assert decontam.cut("One, two  three. Four", [(1, 3)]) == "One, . Four"
    assert re.sub(r"\s", "", decontam.cut("a b", [(0, 2)])) == ""


def test_clean_drops_the_contaminated_and_cuts_the_rest(spark):
    frame, bench, docs, items = tables(spark)
    named = [(str(i), decontam.words_of(t)) for i, t in enumerate(items)]
    for block_words in (100_000, 30):
        kept = {}
        for i, (_, text) in enumerate(docs):
            words = decontam.words_of(text)
            hit, _ = brute(words, named, 13)
            if not hit or 20 * len(hit) < len(words):
                kept[i] = [w for k, w in enumerate(words) if k not in hit]
        out = decontam.clean(frame.withColumn("row", F.col("n_hit")).withColumn("n_chars", F.lit(-1)), bench, block_words=block_words)
        assert out.columns == ["doc_id", "text", "n_hit", "row", "n_chars"]
        got = {r.row: r for r in out.collect()}
        assert {i: decontam.words_of(r.text) for i, r in got.items()} == kept
        assert all(r.text == docs[i][1] and r.n_chars == -1 or r.n_chars == len(r.text) for i, r in got.items())


def test_empty_tables(spark):
    frame, bench, docs, _ = tables(spark)
    assert decontam.decontaminate(frame.limit(0), bench).count() == 0
    assert decontam.decontaminate(frame, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


def test_only_documents_that_may_be_hit_are_streamed(spark):
    frame, bench, docs, items = tables(spark)
    named = [(str(i), decontam.words_of(t)) for i, t in enumerate(items)]
    kept = {r.n_hit for r in decontam.may_hit(frame, bench, 13).collect()}
    hit = {i for i, (_, t) in enumerate(docs) if brute(decontam.words_of(t), named, 13)[0]}
    assert hit <= kept and len(kept - hit) <= 1
    full = decontam.windows(decontam.words_of("a b c d"), [2, 4])
    assert len(full) == 4 and full[3] == decontam.windows(decontam.words_of("A. b, c d"), [4])[0] and len(decontam.windows([], [2])) == 0


def test_merged_spans():
    assert decontam.merged([(5, 9), (1, 3), (3, 4), (6, 7), (20, 21)]) == [(1, 4), (5, 9), (20, 21)]
