"""Secrets and personal data."""

import itertools
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from pricelens.llm import pii, secrets

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15])


def test_base_patterns_match_brute_force():
    draw = random.Random(5)
    pieces = ["token", "Pass", "word", "API_key", "secret", " ", "=", ":", '"', "a1b2c3", "AKIA", "ABCDEFGHIJKLMNOPQRST", "0123456789abcdef", "é", "ſecret", "@", "a@b", ".", "c.d", "1", "255", "4111111111111111", "+", "(", "-", "12", "\n", "256"]
    for _ in range(3000):
        text = "".join(draw.choices(pieces, k=draw.randint(1, 14)))
        assert secrets.base_spans(text) == brute_secrets(text), text
        assert pii.base_spans(text) == brute_pii(text), text


def test_base_patterns_on_the_tables(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert secrets.base_spans(r.text) == brute_secrets(r.text)
        assert pii.base_spans(r.text) == brute_pii(r.text)


def test_hard_texts_take_linear_time():
    for piece in ("@a.b", "1", "1.", "+1(", "token=", "a", "f", "a@", "@", "1-", "(", "+", "a.b@c.", "token ", "AKIA"):
        text, began = piece * (1_000_000 // len(piece)), time.time()
        pii.prepare([text])
        secrets.base_spans(text)
        assert time.time() - began < (20 if piece == "token " else 4), piece
    took = []
    for n in (2_000, 20_000):  # many tokens: ten times as many take about ten times as long
        began = time.time()
        _, nodes = pii.prepare(["+1 4111111111111111 1.2.3.4 a@b.cd " * n])
        took.append(time.time() - began)
        assert len(nodes.skip) + len(nodes.alike) <= 3 * len(nodes.spans)
    assert took[1] < 30 * took[0] + 0.5


def exact(field, nodes):
    """Label probabilities by summing over all labellings."""
    k, n = len(pii.KINDS) + 1, len(nodes.label)
    own = nodes.features @ field.weights
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        if any(fixed and fixed != x for fixed, x in zip(nodes.label, labels, strict=True)):
            continue
        score = sum(own[i, x] for i, x in enumerate(labels) if not nodes.label[i])
        for table, edges in ((field.chain, nodes.chain), (field.skip, nodes.skip), (field.alike, nodes.alike)):
            score += sum(table[labels[a], labels[b]] for a, b in edges)
        for i, x in enumerate(labels):
            total[i, x] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_message_passing_is_exact_on_trees_and_near_on_loops():
    draw = np.random.default_rng(3)
    k = len(pii.KINDS) + 1
    tables = [(t + t.T) / 2 for t in draw.normal(0, 1, (3, k, k))]
    field = pii.Field(draw.normal(0, 1, (pii.N_FEATURES, k)), *tables)
    pairs = lambda *x: np.array(x, np.int64).reshape(-1, 2)
    for chain, skip, alike, most in (
        (pairs((0, 1), (1, 2)), pairs((2, 4)), pairs((1, 3)), 1e-4),
        (pairs((0, 1), (1, 2), (3, 4)), pairs((0, 3), (2, 4)), pairs(), 0.25),
    ):
        for label in (np.zeros(5, np.int64), np.array([0, 0, 3, 0, 0])):
            nodes = pii.Tokens([(0, i, i + 1) for i in range(5)], draw.integers(0, 2, (5, pii.N_FEATURES)).astype(float), label, chain, skip, alike)
            assert np.abs(pii.infer(field, nodes) - exact(field, nodes)).max() < most


def test_similar_tokens_are_joined():
    text = "+12345550199 x (234)5550199 y 10.0.0.7 z 10.0.0.9 a@host.de b c@host.de a@other.org 10.0.0.7 1 22 333"
    _, nodes = pii.prepare([text])
    named = lambda edges: {(text[slice(*nodes.spans[a][1:])], text[slice(*nodes.spans[b][1:])]) for a, b in edges}
    assert named(nodes.skip) == {("10.0.0.7", "10.0.0.7")}
    assert named(nodes.alike) == {("+12345550199", "(234)5550199"), ("10.0.0.7", "10.0.0.9"), ("a@host.de", "c@host.de"), ("10.0.0.9", "10.0.0.7")}


def test_field_learns_what_its_sample_shows():
    """A kind that depends on the neighbour alone is learned; without edges it can't be."""
    y = np.array([0, 0, 4, 4] * 50)
    x = np.zeros((200, pii.N_FEATURES))
    x[:, 0], x[::2, 5] = 1, y[::2] == 4
    none = np.zeros((0, 2), np.int64)
    chain = np.array([(i, i + 1) for i in range(0, 200, 2)])
    field = pii.train(pii.Tokens([], x, y, chain, none, none))
    p = pii.infer(field, pii.Tokens([], x, np.zeros(200, np.int64), chain, none, none))
    assert (p.argmax(axis=1) == y).all()
    alone = pii.infer(field, pii.Tokens([], x, np.zeros(200, np.int64), none, none, none))
    assert len({tuple(r) for r in alone[1::2].round(6)}) == 1


DOCS = "doc_id long, text string, secrets int, pii string"


def test_models_add_random_tokens_and_leave_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ratio = secrets.fit(docs)
    draw = random.Random(9)
    keys = ["".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32)) for _ in range(200)]
    names = ["user_profile_image_2024_final", "internationalisation_helper_v2", "https-proxy-configuration-8080", "thisisaverylongidentifier12"]
    assert np.mean([secrets.margin(k, ratio) >= secrets.MARGIN for k in keys]) > 0.95
    assert not [n for n in names if secrets.margin(n, ratio) >= secrets.MARGIN]
    rows = [(1, f"see {keys[0]} and {names[0]}", 0, ""), (2, None, 0, ""), (3, "", 0, ""), (3, "", 0, ""), (4, "x " * 300_000 + keys[1], 0, "")]
    got = {r.doc_id: r.secrets for r in secrets.scan(spark.createDataFrame(rows, DOCS), ratio).collect()}
    assert [(s.kind, s.start, s.end) for s in got[1]] == [("model", 4, 36)] and not got[2] and not got[3] and len(got[4]) == 1
    assert secrets.scan(spark.createDataFrame([], DOCS)).count() == 0
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, DOCS), ratio).collect()}
    assert clean[1] == f"see [SECRET] and {names[0]}" and clean[2] is None


def test_models_find_planted_keys_and_confirm_those_of_patterns(spark):
    """Keys without a pattern put into every tenth document: recall and precision; and plain likelihoods of both models."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ratio = secrets.fit(docs)
    draw, rows, planted = random.Random(4), [], {}
    alphabets = ("ghijkmnpqrstuvwxyzGHJKLMNPQRSTUVWXYZ23456789", "ABCDEFGHJKLMNPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz")
    for r in docs.collect():
        text = r.text or ""
        if r.doc_id % 10 == 3:
            key, at = "".join(draw.choices(draw.choice(alphabets), k=draw.randint(16, 40))), draw.choice([m.start() for m in re.finditer("^| ", text)])
            text = f"{text[:at]} {key} {text[at:]}"
            planted[r.doc_id] = (at + 1, at + 1 + len(key))
        rows.append((r.doc_id, text, 0, ""))
    hits = false = confirmed = patterns = 0
    for r in secrets.scan(spark.createDataFrame(rows, DOCS), ratio).collect():
        base = [x for x in r.secrets if x.kind != "model"]
        patterns += sum(x.kind == "hex" for x in base)
        for x in r.secrets:
            if x.kind == "model":
                inside = any(b.start <= x.start and x.end <= b.end for b in base)
                hit = (x.start, x.end) == planted.get(r.doc_id)
                hits, false, confirmed = hits + hit, false + (not hit and not inside), confirmed + inside
    assert len(planted) > 50 and hits >= 0.97 * len(planted) and false <= 0.02 * hits and confirmed >= 0.97 * patterns > 0
    counts, sample = {}, ["ab-1", "zz", "Q9Q9"]
    for token in sample:
        for a, b in zip("\0" + token, token + "\0", strict=True):
            counts[a, b] = counts.get((a, b), 0) + 1
    logs = secrets.train(sample)
    for a, b in itertools.product("\0ab-1zQ9x", repeat=2):
        total = sum(n for (x, _), n in counts.items() if x == a) + 0.1 * secrets.ALPHABET
        assert abs(logs[ord(a), ord(b)] - np.log((counts.get((a, b), 0) + 0.1) / total)) < 1e-9


def test_field_carries_a_kind_to_repeated_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.fit(docs)
    text = "call +1 (234) 555-0199 today or later (234) 555-0199, not 1999 or 555"
    bases, nodes = pii.prepare([text, "room 1999 and 2024, 17 of 230"])
    more = pii.added_spans(nodes, pii.infer(field, nodes))
    assert any(text[a:b].startswith("(234) 555-0199") and pii.KINDS[k] == "phone" for a, k, b in more[0])
    assert 1 not in more


def test_pii_edges_of_the_input(spark):
    rows = [(1, "mail a.b@c.de now", 1, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (None, "none", 1, "x"), (1, "mail a.b@c.de now", 1, "x"), (5, "x " * 300_000 + "4111111111111111", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.pii]) for r in pii.find(docs).collect()]
    assert got.count((1, [("email", 5, 13)])) == 2 and (2, []) in got and (5, [("card", 600_000, 600_016)]) in got
    odd = docs.select("*", F.lit(7).alias("_row"), F.lit(8).alias("found"), F.lit(9).alias("Base"), F.lit(1).alias("row"), F.lit(2).alias("done"))
    assert pii.redact(odd).columns == odd.columns and {tuple(r)[4:] for r in pii.redact(odd).collect()} == {(7, 8, 9, 1, 2)}
    assert {r.found for r in pii.find(odd).collect()} == {8}
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and {r.text for r in clean.where("doc_id = 1").collect()} == {"mail [EMAIL] now"}
    assert pii.find(docs.limit(0)).count() == 0


def test_whole_neighbours_stay_apart(spark):
    """Two numbers side by side are two cards if both pass the check of cards; one that fails it is none."""
    good, other, bad = "4111111111111111", "5500005555555559", "1234567812345678"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.fit(docs)
    for text, want in ((f"card {good} {other} end", [good, other]), (f"card {bad} {good} end", [good]), (f"card {good} {bad} end", [good])):
        (_, every), = pii.judged([text], field)
        assert pii.base_spans(text) == [] and [text[a:b] for a, k, b in every if pii.KINDS[k] == "card"] == want, text


def test_fields_of_bounded_size_agree(monkeypatch):
    texts = ["a 4111111111111111 b@c.de", None, "", "x" * 50, "+1 555 010 9999 and 4111 1111", "1.2.3.4 " * 20]
    field = pii.Field(np.random.default_rng(1).normal(0, 1, (pii.N_FEATURES, len(pii.KINDS) + 1)), *[np.eye(len(pii.KINDS) + 1)] * 3)
    whole = list(pii.judged(texts, field))
    monkeypatch.setattr(pii, "CHARS", 10)
    assert list(pii.judged(texts, field)) == whole and len(whole) == len(texts)
