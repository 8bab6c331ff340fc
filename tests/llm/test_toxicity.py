import functools
import random
import zlib

import numpy as np

from pricelens.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_features_are_of_one_word_alone():
    words = ["trash", "é", "", "a" * 300, "Ünïcode!", "<x>"]
    rows, sizes = toxicity.features(words)
    parts = np.split(rows, np.cumsum(sizes)[:-1])
    for w, part in zip(words, parts, strict=True):
        assert toxicity.features([w])[0].tolist() == part.tolist() and len(part) >= 1
    assert len(set(parts[0].tolist()) & set(toxicity.features(["trashy"])[0].tolist())) >= 5
    assert len(toxicity.features([])[0]) == 0


def test_held_out_accuracy_and_misspellings(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r.score for r in toxicity.score(docs, model).select("doc_id", "score").collect()}
    held = [(r.toxic, rows[r.doc_id] >= toxicity.THRESHOLD) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    caught = np.mean([p for t, p in held if t])
    assert caught > 0.85 and np.mean([p for t, p in held if not t]) < 0.02
    plain = "the reren of thation is onerin and the heating " * 3
    odd = spark.createDataFrame([(1, plain + "trassh idiott"), (2, plain), (3, None), (4, ""), (4, ""), (5, plain * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert got[1] > got[2] and got[2] < 0.5 and got[3] == got[4] < 0.5 and got[5] < 0.5
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_unseen_misspellings_are_caught_by_shared_ngrams(spark):
    """Held-out toxic documents with every strong word misspelt as it never stood in training, against the same without it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "text", "toxic")
    rows = [r for r in docs.collect() if r.text]
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    clean = [r for r in train if not r.toxic][:1600]
    train = [r for r in train if r.toxic] + clean
    model = toxicity.train([r.text for r in train], [r.toxic for r in train])
    numbers, bias = model.word_numbers(), float(model.bias[1] - model.bias[0])
    number = functools.cache(lambda w: float(numbers[toxicity.features([w])[0]].mean()))
    score = lambda words: 1 / (1 + np.exp(-(bias + np.mean([number(w) for w in words] or [0]))))
    seen = {w for r in train for w in toxicity.words_of(r.text)}
    strong = set(sorted((w for w in {x.strip(".,!$*%&#") for x in seen} if len(w) > 3), key=number)[-8:])
    draw, whole, odd, none, words = random.Random(1), [], [], [], 0
    for r in rows:
        if r.toxic and zlib.crc32(str(r.doc_id).encode()) % 3 == 1:
            text, misspelt = toxicity.words_of(r.text), []
            for w in text:
                core = w.strip(".,!$*%&#")
                if core in strong:
                    i = draw.randrange(1, len(core) - 1)
                    w = draw.choice([core[:i] + core[i] + core[i:], core[:i] + draw.choice("xqz") + core[i:]])
                    assert w not in seen
                    words += 1
                misspelt.append(w)
            whole.append(score(text))
            odd.append(score(misspelt))
            none.append(score([w for w in text if w.strip(".,!$*%&#") not in strong]))
    caught = [np.mean(np.array(x) >= toxicity.THRESHOLD) for x in (whole, odd, none)]
    assert words > 100 and caught[0] > 0.85 and caught[1] > 0.75 and caught[1] > caught[2] + 0.1


def test_training_matches_a_dense_version(monkeypatch):
    """The same layers as plain matrices, a row to each document, step by step."""
    monkeypatch.setattr(toxicity, "LEAST_Z", 0.0)
    monkeypatch.setattr(toxicity, "STEPS", 5)
    texts, toxic = ["you idiot idiot", "fine day here", "such an idiott", "a nice day", ""], [1, 0, 1, 0, 0]
    model = toxicity.train(texts, toxic)
    draw = np.random.default_rng(11)
    weights, bias = draw.normal(0, 0.5, (toxicity.WIDTH, 2)), np.zeros(2)
    docs = [toxicity.words_of(t) for t in texts if t]
    own = sorted({int(x) for d in docs for w in d for x in toxicity.features([w])[0]})
    table, y = draw.normal(0, 0.01, (len(own), toxicity.WIDTH)), np.array(toxic[:4])
    use = np.zeros((4, len(own)))
    for i, d in enumerate(docs):
        for w in d:
            rows = toxicity.features([w])[0]
            for x in rows:
                use[i, own.index(int(x))] += 1 / len(rows) / len(d)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))[:, None]
    layers, goal = [table, weights, bias], np.eye(2)[y]
    first, second = [0 * x for x in layers], [0 * x for x in layers]
    for step in range(1, 6):
        means = toxicity.SCALE * use @ layers[0]
        p = np.exp(means @ layers[1] + layers[2])
        error = share * (p / p.sum(axis=1, keepdims=True) - goal)
        grads = [toxicity.SCALE * use.T @ error @ layers[1].T, means.T @ error, error.sum(axis=0)]
        for k, g in enumerate(grads):
            g = g + toxicity.DECAY * layers[k] * (share.mean() if k == 0 else 1)
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g**2
            layers[k] = layers[k] - toxicity.RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    assert np.allclose(model.table[own], layers[0]) and np.allclose(model.weights, layers[1]) and np.allclose(model.bias, layers[2])


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(docs, labels).columns == docs.columns and toxicity.keep_clean(docs, labels).count() == 2
