"""The pipeline against a plain version of each stage on its own input."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline
from pricelens.llm import decontam, mixing, pii, simhash, toxicity
from tests.llm.test_decontam import brute
from tests.llm.test_simhash import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(str(r.item_id), decontam.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        rows, before = {r.doc_id: r for r in docs.collect()}, docs
        out = stage(spark, docs, SF)
        assert out.columns[: len(columns)] == columns and (k == 4 or out.columns == columns)
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        got = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels)
            numbers, bias = model.word_numbers(), model.bias[1] - model.bias[0]
            number = lambda w: numbers[toxicity.features([w])[0]].mean()
            odds = {i: bias + np.mean([number(w) for w in toxicity.words_of(r.text)] or [0]) for i, r in rows.items()}
            want = {i for i, x in odds.items() if 1 / (1 + np.exp(-x)) < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            ids = sorted(rows)
            want = {ids[g] for g in brute_groups([simhash.fingerprint(rows[i].text) for i in ids])}
        elif name == "decontamination":
            words = {i: decontam.words_of(r.text) for i, r in rows.items()}
            hits = {i: len(brute(w, bench, 13)[0]) for i, w in words.items()}
            want = {i for i, n in hits.items() if not (n and 20 * n >= len(words[i]))}
        elif name == "mixing":
            decided = mixing.mix(before).collect()
            want = {r.doc_id for r in decided if r.taken}
        else:
            want = set(rows)
        assert set(got) == want, name
        if name == "personal_data":
            assert all(not pii.base_spans(r.text) for r in got.values())
            assert all(r.text == rows[i].text for i, r in got.items() if not set(rows[i].text) & set("0123456789@"))
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "mixing":
            assert {r.doc_id for r in decided} == set(rows) and len(decided) == len(rows)
            assert abs(sum(r.taken for r in decided) - 1.5 * sum(r.size for r in decided)) <= len({r.source for r in decided})
            assert all(r.taken <= 2 * r.size for r in decided)
            words = Counter()
            for r in docs.collect():
                words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
            assert words == Counter({r.doc_id: r.taken for r in decided if r.taken})
        else:
            cut = {i for i in got if name == "decontamination" and hits[i]}
            assert all(r == rows[i] for i, r in got.items() if i not in cut)
            for i in cut:
                hit = brute(words[i], bench, 13)[0]
                assert decontam.words_of(got[i].text) == [w for k, w in enumerate(words[i]) if k not in hit] and got[i].n_chars == len(got[i].text)


def test_run_on_an_empty_table(spark, tmp_path):
    """No documents, no labels, no items: an empty mix with its columns."""
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.count() == 0 and {"doc_id", "text", "taken", "copy"} <= set(out.columns)


def test_run_returns_the_mix(spark, monkeypatch):
    """The last stage's decision takes effect: drop, cut at the word, repeat."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-1:])
    want = []
    for r in mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]
        left = r.taken
        while left > 0:
            want.append((r.doc_id, words[:left]))
            left -= len(words)
    got = corpus_pipeline.run(spark, SF).collect()
    split = [(r.doc_id, [w for w in re.split(r"[\x20\x09-\x0D]+", r.text) if w]) for r in got]
    assert sorted(split) == sorted(want) and all(r.n_chars == len(r.text) for r in got)
    assert len({r.doc_id for r in got}) < 200 < len(got)
    totals = {}
    for r in got:
        totals.setdefault(r.source, [0, r.target])[0] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(n == round(target) for n, target in totals.values())


def test_mixed_documents(spark):
    rows = [(1, " a  b c ", 3, 7), (2, "x y", 2, 0), (3, None, 0, 0), (4, "p q", 2, 2), (5, "p q r", 3, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, size long, taken long")
    got = sorted((r.doc_id, r["copy"], r.text) for r in mixing.mixed(frame).collect())
    assert got == [(1, 1, " a  b c "), (1, 2, " a  b c "), (1, 3, " a"), (4, 1, "p q"), (5, 1, "p")]
    assert mixing.mixed(frame.limit(0)).count() == 0


def test_mixing_edges(spark):
    rows = [(1, "a", "x y z"), (1, "a", "x y z"), (2, None, "x"), (3, "b", None), (4, "b", ""), (None, "a", "x"), (5, "c", "w " * 300_000)]
    frame = spark.createDataFrame([(*r, 7, "keep") for r in rows], "doc_id long, source string, text string, size int, more string")
    got = mixing.mix(frame)
    by = {s: [r for r in got.collect() if r.source == s] for s in ("a", "b", "c", None)}
    assert got.count() == 7 and {r.more for r in got.collect()} == {"keep"}
    assert sum(r.taken for r in by["b"]) == 0 and by["b"][0].target == 0.0
    for rows_of in by.values():
        assert sum(r.taken for r in rows_of) == round(rows_of[0].target) and all(r.taken <= 2 * r.size for r in rows_of)
    assert mixing.mix(frame.limit(0)).count() == 0
    odd = frame.selectExpr("*", "1 AS _width", "2 AS width", "3 AS skey", "4 AS Place", "5 AS _words", "6 AS words", "7 AS salt")
    got = mixing.mix(odd)
    assert got.columns == [*[c for c in odd.columns if c != "size"], "size", "source_size", "target", "taken"]
    assert {tuple(r)[4:11] for r in got.collect()} == {(1, 2, 3, 4, 5, 6, 7)}
