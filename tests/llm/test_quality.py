import re
from collections import Counter

from pyspark.sql import functions as F

from pricelens.llm import quality


def brute(text):
    """The base columns, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def em(patterns, rounds=quality.ROUNDS, k=len(quality.RULES)):
    """The same estimation in plain Python: {votes: documents} to the part of good ones and both accuracies of each rule."""
    found, total = [], sum(patterns.values())
    for _ in range(rounds):
        soft = {}
        for votes in patterns:
            if not found:
                soft[votes] = 1 - quality.FIRST if 0 in votes else quality.FIRST
                continue
            good, bad = found[0], 1 - found[0]
            for v, a, b in zip(votes, found[1 : k + 1], found[k + 1 :], strict=True):
                good *= {1: a, 0: 1 - a}.get(v, 1)
                bad *= {0: b, 1: 1 - b}.get(v, 1)
            soft[votes] = good / (good + bad)
        part = (sum(n * soft[v] for v, n in patterns.items()) + 1) / (total + 2)
        found = [max(quality.LEAST_GOOD, min(quality.MOST_GOOD, part))]
        for right, share in ((1, lambda v: soft[v]), (0, lambda v: 1 - soft[v])):
            for i in range(k):
                cast = {c: sum(n * share(v) for v, n in patterns.items() if v[i] == c) for c in (0, 1)}
                rate = (cast[right] + 1) / (cast[0] + cast[1] + 2)
                found.append(max(quality.LEAST_RIGHT, rate) if right else rate)
    return found


def test_base_and_em_match_plain_versions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    voted = quality.votes(quality.word_stats(docs)).cache()
    rows = voted.collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
    patterns = Counter(tuple(r[f"vote_{k}"] for k in quality.RULES) for r in rows)
    got = quality.estimate(voted)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, em(patterns), strict=True))
    # Rules disagree, and none stands at a bound.
    cast = [{r[f"vote_{k}"] for k in quality.RULES} for r in rows]
    assert sum({0, 1} <= c for c in cast) > 50
    assert quality.LEAST_GOOD < got[0] < quality.MOST_GOOD and all(quality.LEAST_RIGHT < x < 1 for x in got[1 : len(quality.RULES) + 1])


def voted(spark, counts):
    names = [f"vote_{k}" for k in RULES3]
    rows = [v for v, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{x} int" for x in names))


RULES3 = {"a": ("n_words", "x > 0", "x < 0"), "b": ("n_words", "x > 0", "x < 0"), "c": ("n_words", "x > 0", "x < 0")}


def test_a_rules_own_data_decide_its_trust(spark):
    """Two rules that agree are believed against a third; once the third one's votes go with another's, it is believed too."""
    clean = {(1, 1, 1): 900, (0, 0, 1): 60, (0, 0, -1): 10, (1, 1, 0): 30}
    joined = {(1, 1, 1): 900, (0, 0, 1): 40, (0, 0, 0): 30, (1, 0, 0): 25, (1, 1, 0): 5}
    seen = {}
    for name, counts in (("alone", clean), ("with others", joined)):
        frame = voted(spark, counts)
        found = quality.estimate(frame, RULES3)
        assert all(abs(a - b) < 1e-9 for a, b in zip(found, em(Counter(counts), k=3), strict=True))
        q = {tuple(r)[:3]: r.q for r in frame.distinct().withColumn("q", quality.posterior(found, RULES3)).collect()}
        seen[name] = found, q
    (alone, q), (others, r) = seen["alone"], seen["with others"]
    assert q[1, 1, 0] > 0.5 > q[0, 0, 1] and r[0, 0, 0] < 0.5 and r[1, 0, 0] < 0.5
    assert others[3] > alone[3] and others[6] > alone[6] + 0.2  # rule c on good documents, on bad ones
    assert abs(r[0, 0, 1] - q[0, 0, 1]) > 1e-6


def test_junk_goes_and_clean_text_stays(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = quality.judge(quality.votes(quality.word_stats(docs)).drop("text").checkpoint()).join(labels, "doc_id")
    part = {r.good: r.kept for r in got.groupBy("good").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    failed = got.where("good = 1").agg(F.avg(F.col("base_failed").cast("int"))).first()[0]
    assert part[0] < 0.15 and part[1] > 0.99 - failed


def test_edges_of_the_input(spark):
    same = "one two three four five six seven eight "
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 7), (5, same * 2), (5, same * 2), (6, "w#rd " * 50_000), (None, "ä b c d\n\nä")]
    docs = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, n_words int, words string")
    got = quality.quality(docs).collect()
    assert len(got) == len(rows) and {r.words for r in got} == {"x"}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (r.kept is False or not r.base_failed)
    assert quality.quality(docs.limit(0)).count() == 0
