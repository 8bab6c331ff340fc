"""Secret scans by character Markov models.

Three patterns find secrets of known shapes. Beside them stand two first-order Markov models of characters, one of random
strings, one of ordinary words and identifiers. Every unbroken token of some length is judged by both, whether a pattern
matched there or not: it is a secret if the first explains it better, by so much in all and by so much for each character.
So the models find keys without a pattern, and confirm those that a pattern found (`token = 9f...` has a span of either,
`token = undefined` one of the pattern alone). Both are trained from labelled samples: tokens that the patterns call
secret, with random strings over the usual alphabets, and the other tokens of a bounded number of documents.
"""

from __future__ import annotations

import base64
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_sample

#: The patterns of the base scan. Kinds in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
KEYWORDS = ("passw", "secret", "token", "api")

#: Tokens that the models judge: unbroken, this long, not digits alone.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Log-likelihood ratio for each character, and in all, from which a token is a secret. The latter weighs against how rare
#: secrets are: exp(12) is about 160 000 ordinary tokens to a secret.
MARGIN, EVIDENCE = 0.5, 12.0
#: Documents from which the models are trained (the smallest by a hash of doc_id), and random strings beside them.
TRAIN_DOCS, RANDOM_STRINGS = 2000, 4000
#: ASCII characters; all others share one more place.
ALPHABET = 129


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and apart in each kind; matches too short are dropped."""
    low = text.lower()
    found = []
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _codes(token: str) -> np.ndarray:
    """The characters with a border before and behind, as numbers."""
    return np.minimum(np.frombuffer(f"\0{token}\0".encode("utf-32-le", "surrogatepass"), np.uint32), ALPHABET - 1)


def train(tokens: list[str]) -> np.ndarray:
    """Log probability of each character after each other, smoothed by a tenth of a count."""
    counts = np.full((ALPHABET, ALPHABET), 0.1)
    for token in tokens:
        x = _codes(token)
        np.add.at(counts, (x[:-1], x[1:]), 1.0)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def margin(token: str, ratio: np.ndarray) -> float:
    """The log-likelihood ratio for each character; below any threshold if there is too little of it in all."""
    x = _codes(token)
    total = float(ratio[x[:-1], x[1:]].sum())
    return total / (len(x) - 1) if total >= EVIDENCE else -np.inf


def model_spans(text: str, ratio: np.ndarray, least: float = MARGIN) -> list[tuple[int, int, int]]:
    """Spans of tokens that look random, and not like words."""
    return [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if candidate(m[0]) and margin(m[0], ratio) >= least]


def candidate(token: str) -> bool:
    return len(token) >= 12 and not token.isdigit()


def random_strings(n: int = RANDOM_STRINGS, seed: int = 7) -> list[str]:
    """Keys over the usual alphabets, of 20 to 64 characters."""
    draw = random.Random(seed)
    kinds = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    out = ["".join(draw.choices(draw.choice(kinds), k=draw.randint(20, 64))) for _ in range(n // 2)]
    return out + [base64.b64encode(draw.randbytes(draw.randint(15, 48))).decode() for _ in range(n - n // 2)]


def fit(docs: DataFrame, n_docs: int = TRAIN_DOCS) -> np.ndarray:
    """The ratio of both models' log probabilities, from at most n_docs whole documents."""
    sample = bounded_sample(docs.select("doc_id", "text").where("text is not null"), n_docs).select("text")

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each document's distinct tokens: secrets by the patterns, and the rest."""
        for frame in frames:
            rows: dict[tuple[str, int], int] = {}
            for text in frame["text"]:
                at, rest = 0, []
                for start, _, end in base_spans(text):
                    rows[text[start:end].rpartition("=")[2].strip(" \"':"), 1] = 1
                    rest.append(text[at:start])
                    at = max(at, end)
                for token in {t for part in [*rest, text[at:]] for t in re.findall(r"[A-Za-z0-9+/_=-]{3,}", part)}:
                    if not (candidate(token) and any(c.isdigit() for c in token)):  # those may be secrets without a label
                        rows[token, 0] = 1
            yield pd.DataFrame(list(rows), columns=["token", "secret"])

    # Counts of character pairs would do too; distinct tokens of a bounded sample are few and keep the model simple.
    tokens = sample.mapInPandas(split, "token string, secret int").distinct().toPandas().sort_values(["secret", "token"])
    secret = [*tokens.token[tokens.secret == 1], *random_strings()]
    # Identifiers join words by signs or capitals, end in numbers, or stand in capitals; that is no sign of a key.
    plain = list(tokens.token[tokens.secret == 0])
    joined = [f"{a}{sign}{b}{n}" for sign, (a, b, n) in zip("_-/" * (len(plain) // 3 + 1), zip(plain, plain[1:] + plain[:1], [*range(10), ""] * (len(plain) // 11 + 1)), strict=False)]
    camel = ["".join(x.capitalize() for x in three) for three in zip(plain[::3], plain[1::3], plain[2::3], strict=False)]
    return train(secret) - train(plain + joined + camel + [x.upper() for x in plain])


def scan(docs: DataFrame, ratio: np.ndarray | None = None, least: float = MARGIN) -> DataFrame:
    """The documents with secrets, an array of (kind, start, end) by start, then kind: code points, end exclusive.

    Kinds assign, access and hex are the patterns'; model is what the Markov models add, which may lie inside one of those.
    Null and empty texts have none, very long ones are read whole in linear time. Each row is judged by itself, so repeated
    rows and ties of doc_id agree. The models are fitted on docs if none are given; on an empty table they know the random
    strings alone. An existing column secrets is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if ratio is None else ratio)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                base = base_spans(text) if text else []
                spans = sorted(base + model_spans(text, shared.value, least)) if text else []
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pd.Series(out, dtype=object)

    return docs.withColumn("secrets", find("text"))


def redact(docs: DataFrame, ratio: np.ndarray | None = None, mark: str = "[SECRET]") -> DataFrame:
    """scan() with each stretch of overlapping spans in text replaced by a mark; the column secrets stays, with the places that the
    spans had before. Nulls, empty and very long texts, ties and repeated rows are as in scan()."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([replace_spans(t, [(s["start"], s["end"], mark) for s in x]) for t, x in zip(texts, spans, strict=True)], dtype=object)

    return scan(docs, ratio).withColumn("text", cleaned("text", "secrets"))


def replace_spans(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with spans replaced by their marks; spans are sorted, of those that overlap the first one's mark stays."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, mark in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
