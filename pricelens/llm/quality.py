"""Quality rules as weak supervision.

Each rule looks at a document's word statistics and votes good (1) or bad (0), or abstains (-1). No rule is trusted
beforehand: expectation-maximisation over the patterns of votes estimates, without labels, the part of good documents and
of each rule two accuracies, how often its vote is right on good documents and on bad ones. Bayes' rule turns a document's
votes into the probability that it is good. A rule that no other one supports is taken to err on good documents; rules that
agree on the same documents earn trust. The patterns are at most 3 ** rules, whatever the number of documents, so the
estimation runs as one SQL expression over one small row of pattern counts.

All of it is DataFrame expressions. A document's statistics are computed within its row, so no text is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import WORD, fresh, text_of

#: Words to a window in which repetition is looked for.
WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: A document with fewer words, or with more repeated words in a hundred, fails before the rules vote.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: EM starts from the guess that a document without bad votes is good and any other is bad, with this probability. Votes on good
#: documents are right at least so often (a rule that isn't is no rule), and so large a part of documents is good.
FIRST, LEAST_RIGHT, LEAST_GOOD, MOST_GOOD = 0.95, 0.95, 0.5, 0.99
ROUNDS = 40
#: A document stays if it is good with at least this probability.
KEEP = 0.5

#: name: (measure, good if so, bad if so); x stands for the measure. Between both the rule abstains. Every kind of junk shows in
#: two measures at least, each of its own: symbols in the letters and in the length of words, copies in lines and in words,
#: stuttering in the words and in their variety, shouting in capitals and in exclamation marks.
RULES: dict[str, tuple[str, str, str]] = {
    "symbols": ("100 * n_symbols / greatest(1, word_chars)", "x < 0.5", "x > 3"),
    "word_length": ("word_chars / greatest(1, n_words)", "x >= 4.5 AND x <= 5.7", "x < 4.2 OR x > 6.8"),
    "letters": ("100 * n_letters / greatest(1, word_chars)", "x >= 95", "x < 88 AND n_words >= 60"),
    "sentences": ("100 * n_ends / greatest(1, n_words)", "x >= 5 AND x <= 13", "x < 2 OR x > 40"),
    "dup_lines": ("100 * n_dup_lines / greatest(1, n_lines)", "x <= 0", "x > 40"),
    "repeats": ("100 * n_repeat_words / greatest(1, n_words)", "x <= 0", "x > 12"),
    "stutter": ("100 * n_stutters / greatest(1, n_words)", "x < 1", "x > 8"),
    "variety": ("100 * n_distinct_words / greatest(1, n_words)", "x >= 60", "x < 45 AND n_words < 200"),
    "capitals": ("100 * n_capital_words / greatest(1, n_words)", "x <= 0", "x > 30"),
    "shouts": ("100 * n_bangs / greatest(1, n_words)", "x <= 0", "x > 15"),
}

STATS = ("n_words", "word_chars", "n_symbols", "n_letters", "n_ends", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters", "n_distinct_words", "n_capital_words", "n_bangs")
#: Letters: what is neither ASCII without being a letter nor white space.
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"


def _bits(hashes: str) -> Column:
    """Bits that hold every place of a window."""
    return F.ceil(F.log2(F.size(hashes) + 1)).cast("int")


def _ordered(hashes: str) -> Column:
    """The windows sorted by hash, then place: one number each, whose low bits are the place, so that plain numbers are sorted."""
    bits = f"cast(ceil(log2(size(`{hashes}`) + 1)) as int)"
    return F.sort_array(F.expr(f"transform(`{hashes}`, (h, i) -> shiftleft(h, {bits}) | i)"))


def _starts(ordered: str) -> Column:
    """Places of the windows whose hash occurs twice or more, from windows sorted by hash."""
    bits = _bits(ordered)
    part = lambda i: F.call_function("shiftright", F.get(F.col(ordered), i), bits)
    same = lambda i, step: F.coalesce(part(i + step) == part(i), F.lit(False))
    twice = F.filter(F.col(ordered), lambda e, i: same(i, -1) | same(i, 1))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    return F.sort_array(F.transform(twice, lambda e: e.bitwiseAND(low)))


def _covered(starts: Column) -> Column:
    """Words in the windows at these places. Each window adds what the one before it doesn't cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.cast("long").alias("last"))
    return F.aggregate(starts, start, step, lambda a: a["n"])


def word_stats(docs: DataFrame) -> DataFrame:
    """The documents with the columns of STATS, all long, computed from whole texts.

    Null text counts as empty: all are 0 (a line is one that has a word). Columns of these names are replaced; all others
    are kept. Windows are compared within one document by hashes of their words, of 64 bits less
    those that number the windows (a false match in 20 000 words has a chance below one in a million). A very long text takes
    memory in proportion to its words."""
    docs = docs.drop(*STATS)
    words, lines, one, hashes, varied, ordered, text, core = fresh(docs.columns, "words", "lines", "one", "hashes", "varied", "ordered", "body", "core")
    none, space = F.array().cast("array<bigint>"), F.lit(" \t\n\x0b\f\r")
    body = docs.withColumn(text, text_of("text")).withColumn(core, F.btrim(text, space))
    split = body.withColumns({
        words: F.when(F.col(core) != "", F.split(core, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")),
        lines: F.filter(F.split(text, r"\n"), lambda x: x.rlike(WORD)),
    }).drop(core)
    # What lambdas refer to must be a column, else it is made anew for each element.
    single = split.withColumn(one, F.transform(words, lambda w: F.xxhash64(w)))
    window = lambda h, i: F.xxhash64(h, *[F.get(F.col(one), i + k) for k in range(1, WINDOW)])
    windows = F.slice(F.transform(one, window), 1, F.greatest(F.lit(0), F.size(one) - (WINDOW - 1)))
    hashed = single.withColumn(hashes, F.when(F.size(one) >= WINDOW, windows).otherwise(none))
    hashed = hashed.withColumn(varied, F.size(F.array_distinct(hashes)))
    # Most texts repeat no window; only the others are sorted.
    hashed = hashed.withColumn(ordered, F.when(F.col(varied) < F.size(hashes), _ordered(hashes)))
    counted = hashed.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_letters": F.regexp_count(text, F.lit(LETTERS)).cast("long"),
        "n_ends": F.regexp_count(text, F.lit("[.!?]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(_covered(_starts(ordered)), F.lit(0)).cast("long"),
        "n_stutters": F.size(F.filter(one, lambda h, i: F.coalesce(F.get(F.col(one), i - 1) == h, F.lit(False)))).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(one)).cast("long"),
        "n_capital_words": F.regexp_count(text, F.lit("[A-Z]{2,}")).cast("long"),
        "n_bangs": F.regexp_count(text, F.lit("!+")).cast("long"),
    })
    return counted.drop(words, lines, one, hashes, varied, ordered, text)


def votes(docs: DataFrame, rules: dict[str, tuple[str, str, str]] = RULES) -> DataFrame:
    """The documents with vote_<rule> in -1, 0, 1 for each rule over the columns of word_stats."""

    def vote(measure: str, good: str, bad: str) -> Column:
        good, bad = (re.sub(r"\bx\b", f"({measure})", x) for x in (good, bad))
        return F.expr(f"CASE WHEN {good} THEN 1 WHEN {bad} THEN 0 ELSE -1 END").cast("int")

    return docs.withColumns({f"vote_{k}": vote(*rule) for k, rule in rules.items()})


def estimate(voted: DataFrame, rules: dict[str, tuple[str, str, str]] = RULES, rounds: int = ROUNDS) -> list[float]:
    """The part of good documents, then of each rule how often its vote is right on good documents, then the same on bad ones,
    all estimated by expectation-maximisation.

    One aggregation gives the number of documents by pattern of votes (3 ** rules at most); the rounds of EM fold over
    that one row. Abstaining says nothing. Counts are smoothed by a vote of either kind, so an empty table gives one half each."""
    names, k = list(rules), len(rules)
    patterns = voted.groupBy(*[f"vote_{n}" for n in names]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pattern = F.struct(F.array(*[F.col(f"vote_{n}") for n in names]).alias("v"), F.col("n"))
    row = patterns.agg(F.array_sort(F.collect_list(pattern)).alias("p"))
    # acc is empty before the first round: then the first guess stands for the posterior.
    part = lambda first, vote: " * ".join(f"CASE e.v[{i}] WHEN {vote} THEN acc[{first + i}] WHEN {1 - vote} THEN 1 - acc[{first + i}] ELSE double(1) END" for i in range(k))
    odds = f"transform(array(named_struct('x', acc[0] * {part(1, 1)}, 'y', (1 - acc[0]) * {part(1 + k, 0)})), o -> o.x / (o.x + o.y))[0]"
    guess = f"if(array_contains(e.v, 0), double({1 - FIRST}), double({FIRST}))"
    soft = f"transform(p, e -> named_struct('v', e.v, 'n', e.n, 'g', e.n * CASE WHEN size(acc) = 0 THEN {guess} ELSE {odds} END))"
    total = lambda what: f"aggregate(s, double(0), (a, e) -> a + {what})"
    count = lambda i, vote, of: total(f"if(e.v[{i}] = {vote}, {of}, double(0))")
    rate = lambda i, vote, of: f"({count(i, vote, of)} + 1) / ({count(i, 0, of)} + {count(i, 1, of)} + 2)"
    new = [f"greatest(double({LEAST_GOOD}), least(double({MOST_GOOD}), ({total('e.g')} + 1) / ({total('e.n')} + 2)))"]
    new += [f"greatest(double({LEAST_RIGHT}), {rate(i, 1, 'e.g')})" for i in range(k)] + [rate(i, 0, "(e.n - e.g)") for i in range(k)]
    fold = f"aggregate(sequence(1, {rounds}), cast(array() as array<double>), (acc, i) -> transform(array({soft}), s -> array({', '.join(new)}))[0])"
    return list(row.select(F.expr(fold).alias("x")).first()["x"])


def posterior(estimates: list[float], rules: dict[str, tuple[str, str, str]] = RULES) -> Column:
    """The probability that a document with these votes is good."""
    k = len(rules)
    good, bad = F.lit(estimates[0]), F.lit(1 - estimates[0])
    for i, name in enumerate(rules):
        vote, on_good, on_bad = F.col(f"vote_{name}"), estimates[1 + i], estimates[1 + k + i]
        good = good * F.when(vote == 1, on_good).when(vote == 0, 1 - on_good).otherwise(1.0)
        bad = bad * F.when(vote == 0, on_bad).when(vote == 1, 1 - on_bad).otherwise(1.0)
    return good / (good + bad)


def judge(voted: DataFrame, rules: dict[str, tuple[str, str, str]] = RULES, keep: float = KEEP) -> DataFrame:
    """Rows of votes() with quality (posterior probability), base_failed and kept. It reads them twice: cut the lineage before."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = voted.withColumn("quality", posterior(estimate(voted, rules), rules)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def quality(docs: DataFrame, rules: dict[str, tuple[str, str, str]] = RULES, keep: float = KEEP) -> DataFrame:
    """The documents with STATS, the votes, quality (posterior probability), base_failed and kept.

    A document with too few or too many repeated words has base_failed and isn't kept, whatever the votes. Null and empty
    texts have no words and fail so. Repeated rows are judged alike. An empty table gives an empty result."""
    return judge(votes(word_stats(docs.drop("quality", "base_failed", "kept")), rules), rules, keep)
