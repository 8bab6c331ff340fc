"""Toxicity by subword-bag embeddings.

A word is the bag of its character n-grams, hashed to rows of an embedding table, so a misspelling that was never seen
shares most rows with the word it hides. A document is the average of its words, and a linear softmax scores it. Both
layers are trained jointly in numpy, by Adam on all of a bounded number of labelled documents. As both are linear, a word
of a trained model is one number, and scoring averages the numbers of words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_sample, lineage_cut

BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 18, 4, 3, 6
#: Labelled documents from which the layers are trained, at most.
TRAIN_TOXIC, TRAIN_CLEAN = 800, 1600
STEPS, RATE, DECAY = 120, 0.03, 1e-3
#: Averages are small where a hundredth of the words counts: they are multiplied by this before the softmax.
SCALE = 50.0
#: Rows are learned whose share of toxic and of clean training documents differs by so many standard errors. All others
#: stay 0: there are far more rows than documents, and what they would learn is chance. Held out at sf0.1 the model finds 133
#: of 144 with this bound, 99 with a bound of 2 and 54 without one.
LEAST_Z = 5.0
THRESHOLD = 0.7
#: Words whose numbers a task keeps; beyond that it forgets them and starts anew.
CACHE = 100_000
#: Texts that are split at once, and words that are hashed at once.
TEXTS, WORDS = 200, 4_000
_BASE = 1_000_003
_EDGES = ".,;:!?#$%&*|\"'()[]<>"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the embedding table for all words, one after the other, and how many each has: hashes of a word's n-grams with
    its borders, and of the whole word."""
    marked = [f"<{w.strip(_EDGES)}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    starts = _starts(sizes)
    own = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[own]
    powers = np.power(np.uint64(_BASE), np.arange(max(LONGEST, int(sizes.max(initial=0))), dtype=np.uint64))
    rows, of = [_row(np.add.reduceat(codes * powers[place], starts), 0)] if len(words) else [], [np.arange(len(words))]
    for n in range(SHORTEST, LONGEST + 1):
        at = np.flatnonzero(place + n <= sizes[own])
        rows.append(_row(sum((codes[at + k] * powers[k] for k in range(n)), np.zeros(len(at), np.uint64)), n))
        of.append(own[at])
    turn = np.argsort(np.concatenate(of), kind="stable")
    return np.concatenate(rows)[turn], np.bincount(np.concatenate(of), minlength=len(words))


def _row(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x WIDTH
    weights: np.ndarray  # WIDTH x 2
    bias: np.ndarray  # 2

    def word_numbers(self) -> np.ndarray:
        """What each row adds to a document's log odds."""
        return SCALE * (self.table @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def _sums(values: np.ndarray, of: np.ndarray, size: int, weight: np.ndarray) -> np.ndarray:
    """Sums of weighted values by the number in `of`."""
    return np.stack([np.bincount(of, v * weight, size) for v in values.T], axis=1)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text as rows of the embedding table, each once, and how much each counts in the average of the text's words. However
    long the text, there are at most BUCKETS rows; words are hashed in blocks."""
    words, counts = np.unique(np.array(words_of(text), dtype=object), return_counts=True)
    total, weight = max(1, counts.sum()), np.zeros(0)
    rows = np.zeros(0, np.int64)
    for at in range(0, len(words), WORDS):
        found, sizes = features(words[at : at + WORDS].tolist())
        own = np.repeat(np.arange(len(sizes)), sizes)
        rows, back = np.unique(np.concatenate([rows, found]), return_inverse=True)
        weight = np.bincount(back, np.concatenate([weight, counts[at + own] / total / sizes[own]]), len(rows))
    return rows, weight


def telling(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether rows are learned, from seen (the clean and the toxic documents that hold each) and n (those there are)."""
    share = seen.sum(axis=0) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1 / n.sum()) * (1 / n[0] + 1 / n[1]))
    return np.abs(seen[1] / n[1] - seen[0] / n[0]) / error >= LEAST_Z


def train(texts: list[str], toxic: list[int], seed: int = 11) -> Model:
    """A model of a few texts, all in this process."""
    known = [(bag(t), int(y)) for t, y in zip(texts, toxic, strict=True) if words_of(t)]
    seen, n = np.zeros((2, BUCKETS)), np.zeros(2)
    for (rows, _), y in known:
        seen[y, rows] += 1
        n[y] += 1
    return train_bags([b for b, _ in known], [y for _, y in known], telling(seen, n) if n.all() else np.zeros(BUCKETS, bool), seed)


def train_bags(bags: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], learned: np.ndarray, seed: int = 11) -> Model:
    """Both layers together, by Adam on all documents at once. learned marks the rows of the table that are no zeros."""
    draw = np.random.default_rng(seed)
    model = Model(np.zeros((BUCKETS, WIDTH)), draw.normal(0, 0.5, (WIDTH, 2)), np.zeros(2))
    y = np.array(toxic, dtype=np.int64)
    if not 0 < y.sum() < len(y) or not learned.any():  # nothing to learn: nothing is toxic
        model.weights[:], model.bias[:] = 0, (4.0, 0.0)
        return model
    doc_of = np.repeat(np.arange(len(bags)), [len(rows) for rows, _ in bags])
    row, part = np.concatenate([rows for rows, _ in bags]).astype(np.int64), np.concatenate([weight for _, weight in bags])
    row, doc_of, part = row[learned[row]], doc_of[learned[row]], part[learned[row]]
    own, row = np.unique(row, return_inverse=True)
    model.table[own] = draw.normal(0, 0.01, (len(own), WIDTH))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))[:, None]
    goal, layers = np.eye(2)[y], [model.table[own], model.weights, model.bias]
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    for step in range(1, STEPS + 1):
        table, weights, bias = layers
        means = SCALE * _sums(table[row], doc_of, len(bags), part)
        score = means @ weights + bias
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = weight * (p / p.sum(axis=1, keepdims=True) - goal)
        by_doc = SCALE * error @ weights.T
        by_row = _sums(by_doc[doc_of], row, len(own), part)
        for k, grad in enumerate((by_row, means.T @ error, error.sum(axis=0))):
            grad = grad + DECAY * layers[k] * (weight.mean() if k == 0 else 1)
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad**2
            layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    model.table[own], model.weights, model.bias = layers
    return model


def held_out(column: str = "doc_id"):
    """Documents whose labels training never sees."""
    return F.crc32(F.col(column).cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, n_toxic: int = TRAIN_TOXIC, n_clean: int = TRAIN_CLEAN) -> Model:
    """A model from at most n_toxic and n_clean labelled documents that are not held out; their ids are broadcast.

    Of rows that share a doc_id the one with the smallest hash of its text counts. Tasks turn texts into bags and count in how
    many documents each row of the table stands; the driver gets those counts (at most BUCKETS) and then, of each document, the
    weights of the rows that are learned: no texts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = bounded_sample(known.where("toxic = 1"), n_toxic).unionByName(bounded_sample(known.where("toxic = 0"), n_clean))
    one = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))

    def to_bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, text, toxic in zip(frame["doc_id"], frame["text"], frame["toxic"], strict=True):
                if words_of(text):
                    rows, weights = bag(text)
                    yield pd.DataFrame({"doc_id": [doc], "toxic": [toxic], "rows": [rows.astype(np.int32)], "weights": [weights]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    bags = lineage_cut(one.mapInPandas(to_bags, f"doc_id {kind}, toxic int, rows array<int>, weights array<double>"))
    n, seen = np.zeros(2), np.zeros((2, BUCKETS))
    for r in bags.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect():
        n[r.toxic] = r.n
    counts = bags.select("toxic", F.explode("rows").alias("row")).groupBy("row").agg(F.sum(F.col("toxic")).alias("toxic"), F.count(F.lit(1)).alias("n")).toPandas()
    rows = counts["row"].to_numpy(np.int64)
    seen[1, rows], seen[0, rows] = counts["toxic"], counts["n"] - counts["toxic"]
    learned = telling(seen, n) if n.all() else np.zeros(BUCKETS, bool)
    kept = docs.sparkSession.sparkContext.broadcast(np.flatnonzero(learned))

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            of = [np.isin(r, kept.value) for r in frame["rows"]]
            yield frame.assign(rows=[r[k] for r, k in zip(frame["rows"], of, strict=True)], weights=[w[k] for w, k in zip(frame["weights"], of, strict=True)])

    small = bags.mapInPandas(told, bags.schema).toPandas().sort_values("doc_id", kind="stable")
    return train_bags(list(zip(small["rows"], small["weights"], strict=True)), small["toxic"].tolist(), learned)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with score, the probability that the document is toxic. Only the text counts: repeated rows and
    ties of doc_id agree, a very long text is averaged whole. A text without words (or null) scores as one without evidence. An existing column score is replaced."""
    sparkled = docs.sparkSession.sparkContext.broadcast((model.word_numbers(), float(model.bias[1] - model.bias[0])))

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows, bias = sparkled.value
        known: dict[str, float] = {}
        for texts in batches:
            out = []
            for at in range(0, len(texts), TEXTS):
                split = [words_of(t) for t in texts.iloc[at : at + TEXTS]]
                new = list(set().union(*split).difference(known))
                for k in range(0, len(new), WORDS):
                    found, sizes = features(new[k : k + WORDS])
                    known.update(zip(new[k : k + WORDS], (np.add.reduceat(rows[found], _starts(sizes)) / sizes).tolist(), strict=True))
                for words in split:
                    odds = bias + sum(map(known.__getitem__, words)) / max(1, len(words))
                    out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))))
                if len(known) > CACHE:
                    known.clear()
            yield pd.Series(out, dtype=float)

    return docs.withColumn("score", judge("text"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with the columns of docs."""
    name = "_toxicity"
    scored = score(docs.select(F.struct(*docs.columns).alias("_row"), "text"), fit(docs, labels)).withColumnRenamed("score", name)
    return scored.where(F.col(name) < threshold).select("_row.*")
