"""Personal data by a skip-chain conditional random field.

Four patterns find e-mail addresses, IP addresses, card numbers and phone numbers of full shape. The field decides on
what they leave: its nodes are a document's tokens with digits or an at sign, labelled with a kind or none. Node potentials
come from a token's shape and neighbourhood, chain potentials join tokens that stand next to each other, and skip potentials
join a token to the next one in the document that is the same or similar, however far away: one table of potentials for
tokens with the same digits or letters, another for tokens that agree in part (the last seven digits, the first three parts
of an address, the user or the host of an e-mail). Loopy message passing makes their labels agree, so that a number that is
a phone number in one place is found where it stands in part.

Tokens that the patterns matched keep their kind. All potentials are trained together on them and on the other tokens of
a bounded number of documents. The nodes are chosen and joined in time linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import bounded_sample, fresh
from pricelens.llm.secrets import replace_spans

#: Kinds in the order in which equal starts are listed; label 0 is none.
KINDS = ("email", "ip", "card", "phone")
#: The patterns of the base scan; quantifiers are possessive where that can't change a match.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: A whole run of these characters with a digit or an at sign; what stands before tells where a run starts, so no run is
#: read twice.
TOKEN = re.compile(r"(?<![A-Za-z0-9@._%+()-])[A-Za-z._%+()-]*+[0-9@][A-Za-z0-9@._%+()-]*+")
WORDS_BEFORE = re.compile(r"(?:phone|tel|call|fax|mail|ip|card|visa)\W*$", re.IGNORECASE)
#: Characters between tokens that count as next to each other, at most.
NEAR = 2
#: Rounds of message passing, damping, and the probability from which a token gets a kind.
ROUNDS, DAMPING, LEAST = 12, 0.3, 0.8
#: Documents to train on at most, and steps of the training, their rate and the decay of weights.
TRAIN_DOCS, TRAIN_STEPS, RATE, DECAY = 4000, 300, 1.0, 1e-4
#: Log potential by which the same tokens agree on a kind before training.
AGREE = 2.0


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, leftmost and apart in each kind; failing matches are dropped."""
    found = []
    last = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, last := m.end()))
    for m in IP.finditer(text):
        if all(len(x := part.lstrip("0")) < 4 and int(x or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@dataclass
class Tokens:
    """The nodes of many documents in one field."""

    spans: list[tuple[int, int, int]]  # document, start, end
    features: np.ndarray
    label: np.ndarray  # of tokens in base spans, else 0
    chain: np.ndarray  # pairs of nodes
    skip: np.ndarray  # of the same tokens
    alike: np.ndarray  # of similar tokens


N_FEATURES = 22
#: Of these features, those of a token that is a card number, an address of four parts or of mail by itself, and that of a long
#: number which fails the check of cards.
WHOLE, WRONG = [9, 12, 16], 10
#: Characters of texts that are one field at once (a longer text is one by itself).
CHARS = 300_000


def _features(text: str, start: int, end: int, before: str) -> list[bool]:
    token = text[start:end]
    digits = "".join(c for c in token if c in "0123456789")
    n, parts = len(digits), token.strip(".").split(".")
    quad = len(parts) == 4 and all(p.isdigit() for p in parts)
    user, at, host = token.partition("@")
    lead = text[max(0, start - 16) : start]
    valid = 14 <= n <= 19 and token.isdigit() and luhn(digits)
    return [
        True, n == 0, 1 <= n <= 2, n == 3, 4 <= n <= 6, n == 7, 8 <= n <= 13, 14 <= n <= 19, n > 19,
        valid, 14 <= n <= 19 and token.isdigit() and not valid,
        quad, quad and all(len(p) < 4 and int(p) <= 255 for p in parts), token.startswith("+"), token.startswith("(") and token.endswith(")"),
        bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}\W*", token)), bool(at and user and "." in host.strip(".")), bool(at),
        any(c.isalpha() for c in token), before.startswith("+"), before.startswith("(") and before.endswith(")"), bool(WORDS_BEFORE.search(lead)),
    ]


def keys(token: str) -> tuple[str, list[str]]:
    """What the same tokens share, and what similar ones share at least one of; empty where there is too little to tell."""
    if "@" in token:
        user, _, host = token.lower().partition("@")
        same = re.sub(r"[^0-9a-z]", "", user + host)
        return same, [f"{x}{part}" for x, part in (("u", user.strip(".")), ("h", host.strip("."))) if len(part) >= 4]
    digits = re.sub(r"[^0-9]", "", token)
    parts = token.strip(".").split(".")
    alike = [f"q{'.'.join(parts[:3])}"] if len(parts) == 4 and all(p.isdigit() for p in parts) else []
    if len(digits) >= 7:
        alike.append(f"d{digits[-7:]}")
    return digits if len(digits) >= 4 else "", alike


def tokens(texts: list[str], bases: list[list[tuple[int, int, int]]]) -> Tokens:
    spans, features, label, chain, skip, alike = [], [], [], [], [], []
    for doc, (text, base) in enumerate(zip(texts, bases, strict=True)):
        seen: dict[str, int] = {}
        at, before, stop = 0, "", -99
        ordered = sorted(base)
        for m in TOKEN.finditer(text):
            node, start, end = len(spans), m.start(), m.end()
            while at < len(ordered) and ordered[at][2] <= start:
                at += 1
            kind = next((k + 1 for a, k, b in ordered[at : at + 3] if a < end and start < b), 0)
            near = start - stop <= NEAR
            spans.append((doc, start, end))
            features.append(_features(text, start, end, before if near else ""))
            label.append(kind)
            if near:
                chain.append((node - 1, node))
            same, parts = keys(m[0])
            last = seen.get(same, -1) if same else -1
            if last >= 0:
                skip.append((last, node))
            # Each node is joined to the last one of each key alone, so edges are as many as keys.
            near_ones = {seen[x] for x in parts if x in seen} - {last}
            alike += [(x, node) for x in sorted(near_ones)]
            seen.update(dict.fromkeys(parts, node))
            if same:
                seen[same] = node
            before, stop = m[0], end
    pairs = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Tokens(spans, np.array(features, float).reshape(-1, N_FEATURES), np.array(label, np.int64), pairs(chain), pairs(skip), pairs(alike))


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, log potentials
    skip: np.ndarray
    alike: np.ndarray


def train(sample: Tokens, steps: int = TRAIN_STEPS) -> Field:
    """All potentials together by pseudo-likelihood: a softmax of a token's label from its shape and its neighbours' labels.
    Weights decay towards a prior that same tokens agree, and similar ones half as much. Tokens whose base match failed are
    among those without a kind; the field may still give them one."""
    k, y = len(KINDS) + 1, sample.label
    x = sample.features
    for edges in (sample.chain, sample.skip, sample.alike):
        beside = np.zeros((len(y), k))
        np.add.at(beside, (edges[:, 0], y[edges[:, 1]]), 1.0)
        np.add.at(beside, (edges[:, 1], y[edges[:, 0]]), 1.0)
        x = np.concatenate([x, beside], axis=1)
    prior = np.concatenate([np.zeros((N_FEATURES + k, k)), AGREE * np.eye(k), AGREE / 2 * np.eye(k)])
    weights, goal = prior.copy(), np.eye(k)[y]
    for _ in range(steps if len(y) else 0):
        score = x @ weights
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights += RATE * (x.T @ (goal - p) / len(y) - DECAY * (weights - prior))
    tables = [(t + t.T) / 2 for t in np.split(weights[N_FEATURES:], 3)]
    return Field(weights[:N_FEATURES], *tables)


def infer(field: Field, nodes: Tokens) -> np.ndarray:
    """Each node's label probabilities by loopy sum-product passing over all documents' edges at once."""
    k = len(KINDS) + 1
    own = nodes.features @ field.weights
    fixed = nodes.label > 0
    own[fixed] = -30.0
    own[fixed, nodes.label[fixed]] = 30.0
    edges = np.concatenate([nodes.chain, nodes.skip, nodes.alike])
    tables = np.concatenate([np.repeat(t[None], len(e), 0) for t, e in ((field.chain, nodes.chain), (field.skip, nodes.skip), (field.alike, nodes.alike))])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    sent = np.zeros((len(source), k))
    for _ in range(ROUNDS if len(edges) else 0):
        belief = own.copy()
        np.add.at(belief, target, sent)
        inner = (belief[source] - sent[back])[:, :, None] + tables
        top = inner.max(axis=1, keepdims=True)
        new = np.log(np.exp(inner - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        sent = DAMPING * sent + (1 - DAMPING) * new
    np.add.at(own, target, sent)
    p = np.exp(own - own.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(nodes: Tokens, p: np.ndarray, least: float = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """By document, the spans that the field adds: neighbours of one kind are one span, without punctuation at its end. A token
    that is a whole address or card number is a span by itself; a number as long as a card's that fails its check is none."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    best, sure = p[:, 1:].argmax(axis=1), p[:, 1:].max(axis=1) >= least
    whole, wrong = nodes.features[:, WHOLE].any(axis=1), nodes.features[:, WRONG] > 0
    linked = {int(b): int(a) for a, b in nodes.chain}
    part_of: dict[int, tuple[int, int]] = {}
    for node in np.flatnonzero(sure & (nodes.label == 0) & ~wrong).tolist():
        doc, start, end = nodes.spans[node]
        spans, kind = out.setdefault(doc, []), int(best[node])
        before = linked.get(node)
        if before in part_of and part_of[before][1] == kind and not whole[node] and not whole[before]:
            spans[-1] = (spans[-1][0], kind, end)
        else:
            spans.append((start, kind, end))
        part_of[node] = (doc, kind)
    return out


def prepare(texts: list[str | None]) -> tuple[list[list[tuple[int, int, int]]], Tokens]:
    whole = [t or "" for t in texts]
    bases = [base_spans(t) for t in whole]
    return bases, tokens(whole, bases)


def judged(texts: list[str | None], field: Field, least: float = LEAST) -> Iterator[tuple[list, list]]:
    """(base, all) spans of each text. Documents share no edges, so a bounded number of characters is one field at a time."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at] or "")
        while end < len(texts) and size + len(texts[end] or "") <= CHARS:
            size += len(texts[end] or "")
            end += 1
        bases, nodes = prepare(texts[at:end])
        more = added_spans(nodes, infer(field, nodes), least)
        for i, base in enumerate(bases):
            yield sorted(base), sorted(base + more.get(i, []))
        at = end


def fit(docs: DataFrame, n_docs: int = TRAIN_DOCS) -> Field:
    """A field trained on at most n_docs documents; only tokens with digits or an at sign come to the driver."""
    sample = bounded_sample(docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")), n_docs).select("text")

    def shapes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            _, t = prepare(list(frame["text"]))
            edges = {"e": t.chain, "s": t.skip, "a": t.alike}
            rows = pd.DataFrame({"f": [x.tobytes() for x in t.features.astype(np.int8)], "y": t.label})
            yield rows.assign(**{k: _before(e, len(t.label)) for k, e in edges.items()})

    # y is the token's label; e, s and a are the distances to the nodes before it on chain, skip and similarity edges.
    rows = sample.mapInPandas(shapes, "f binary, y long, e array<long>, s array<long>, a array<long>").toPandas()
    x = np.array([np.frombuffer(b, np.int8) for b in rows.f], float).reshape(-1, N_FEATURES)
    edge = lambda steps: np.array([(i - d, i) for i, ds in enumerate(steps) for d in ds], np.int64).reshape(-1, 2)
    return train(Tokens([], x, rows.y.to_numpy(), edge(rows.e), edge(rows.s), edge(rows.a)))


def _before(edges: np.ndarray, n: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges.tolist():
        out[b].append(b - a)
    return out


def find(docs: DataFrame, field: Field | None = None, least: float = LEAST) -> DataFrame:
    """The documents with base and pii, arrays of (kind, start, end) by start, then kind: code points, end exclusive.

    base is what the patterns find, pii that and what the field adds. Null and empty texts have none, very long ones are
    read whole in linear time. A document is judged by itself, so repeated rows and ties of doc_id agree. The field is fitted
    on docs if none is given. Existing columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if field is None else field)
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {span}, pii {span}")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shown = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
        for texts in batches:
            both = list(judged(list(texts), shared.value, least))
            yield pd.DataFrame({"base": [shown(b) for b, _ in both], "pii": [shown(x) for _, x in both]})

    docs = docs.drop("base", "pii")
    both = fresh(docs.columns, "found")[0]
    return docs.withColumn(both, search("text")).select(*docs.columns, f"{both}.base", f"{both}.pii")


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The documents with each stretch of personal data in text replaced by its kind in brackets; the columns stay the same.
    n_chars, where docs has it, is counted anew. Nulls, empty and very long texts, ties and repeated rows are as in find()."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs) if field is None else field)

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mark = lambda x: [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in x]
        for texts in batches:
            found = judged(list(texts), shared.value)
            yield pd.Series([replace_spans(t, mark(x)) if x else t for t, (_, x) in zip(texts, found, strict=True)], dtype=object)

    row, done = fresh(["text"], "row", "done")
    out = docs.select(F.struct(*docs.columns).alias(row), cleaned("text").alias(done))
    given = {c: F.col(done) if c.lower() == "text" else F.col(row)[c] for c in docs.columns}
    n_chars = next((f for f in docs.schema if f.name.lower() == "n_chars"), None)
    if n_chars:
        given[n_chars.name] = F.char_length(done).cast(n_chars.dataType)
    return out.select(*[x.alias(c) for c, x in given.items()])
