"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule reads the statistics of a text and votes good or bad, or abstains where its measure lies between its two
thresholds or the text is too short for it. Rules err: prose holds a long number here and a repeated line there. So no
single vote decides. The votes of all texts are summed into counts of vote patterns, at most 3 to the number of rules,
from which expectation maximisation on the driver estimates the share of good texts and two accuracies of each rule: how
often it votes bad on bad texts and good on good ones. With the rules independent given the class, the posterior log
odds of a text are a constant plus one of two weights for each vote, so the verdict is again a column expression: a text is
kept if its quality probability is at least one half. Two base rules (too short, too repetitive) reject on their own.

The statistics are computed once and written as a table in the shared folder; counts and verdicts read that.

Defined cases: null and empty texts have statistics 0 and fail the base rule; very long texts are judged whole;
columns of the input that clash with the added ones are replaced; equal and repeated rows are judged alike and each
counts for the estimate; a tie (odds of one half) is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, let, materialize, without

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_letters", "n_marks")
WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more. Windows are compared by 64-bit hashes."""

    def of_windows(g: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = lambda e, j: e["h"].eqNullSafe(F.get(s, j - 1)["h"]) | e["h"].eqNullSafe(F.get(s, j + 1)["h"])
            places = F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"))
            return F.aggregate(places, start, step, lambda a: a["n"])

        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(ordered, of_sorted))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(F.size(h) <= WINDOW, F.lit(0)).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of STATS, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = without(docs, *STATS, "__words", "__lines").withColumns({
        "__words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_marks": F.regexp_count(t, F.lit("[!?]")),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_letters": F.regexp_count(t, F.lit(r"\p{L}")),
    })
    df = df.withColumns({
        "n_words": F.size("__words"),
        "word_chars": F.length(F.array_join("__words", "")),
        "n_distinct_words": F.size(F.array_distinct("__words")),
        "n_lines": F.size("__lines"),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": _repeat_words(F.col("__words")),
    })
    return df.drop("__words", "__lines").withColumns({c: F.col(c).cast("long") for c in STATS})


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """The vote of each rule: 1 good, -1 bad, 0 where it abstains."""
    words = F.col("n_words")
    share = lambda part, of: F.col(part) / F.greatest(F.col(of), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    some, middle = words >= 20, (words >= 15) & (words < 1000)
    symbols, letters, length = share("n_symbols", "n_words"), share("n_letters", "word_chars"), share("word_chars", "n_words")
    repeats, duplicates, distinct = share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines"), share("n_distinct_words", "n_words")
    upper, marks = share("n_upper", "n_letters"), share("n_marks", "n_words")
    return {
        "symbols": vote(symbols >= 0.1, symbols <= 0.01),
        "letters": vote(some & (letters < 0.88), some & (letters >= 0.94)),
        "word_length": vote(some & ((length < 3.5) | (length >= 6.5)), some & (length >= 4) & (length < 6)),
        "repetition": vote((repeats >= 0.12) | (duplicates >= 0.25), some & (repeats <= 0.02) & (duplicates <= 0.05)),
        "variety": vote(middle & (distinct < 0.6), middle & (distinct >= 0.7)),
        "stutter": vote(middle & (distinct < 0.45), middle & (distinct >= 0.5)),
        "shouting": vote(some & (upper >= 0.2), some & (upper <= 0.05) & (F.col("n_upper") > 0)),
        "exclamation": vote(some & (marks >= 0.2), some & (marks <= 0.05)),
    }


#: Before any text is seen: the share of good texts, how often a rule votes bad on bad texts (each looks for one defect of
#: many) and good on good ones; what these weigh against the votes; rounds of expectation maximisation.
GOOD, BAD_FOUND, GOOD_PASSED, HEAVY, ROUNDS = 0.8, 0.4, 0.97, 0.1, 30


def estimate(patterns: dict[tuple[int, ...], int], rules: int) -> tuple[float, list[tuple[float, float]]]:
    """The log odds of a text without votes, and of each rule what a good and a bad vote add to them, by expectation
    maximisation over counted vote patterns."""
    good, found, passed = GOOD, [BAD_FOUND] * rules, [GOOD_PASSED] * rules
    weights = lambda: [(math.log(p / (1 - f)), math.log((1 - p) / f)) for f, p in zip(found, passed, strict=True)]
    for _ in range(ROUNDS):
        start, weigh = math.log(good / (1 - good)), weights()
        all_good, sums = 0.0, [[0.0] * 4 for _ in range(rules)]  # of each rule: bad texts, votes bad there, good texts, votes good there
        for voted, n in sorted(patterns.items()):
            odds = start + sum(w[v < 0] for w, v in zip(weigh, voted, strict=True) if v)
            good_n = n / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            all_good += good_n
            for own, v in zip(sums, voted, strict=True):
                if v:
                    own[0] += n - good_n
                    own[1] += (n - good_n) * (v < 0)
                    own[2] += good_n
                    own[3] += good_n * (v > 0)
        found = [(x[1] + BAD_FOUND * (HEAVY * x[0] + 1)) / (x[0] + HEAVY * x[0] + 1) for x in sums]
        passed = [(x[3] + GOOD_PASSED * (HEAVY * x[2] + 1)) / (x[2] + HEAVY * x[2] + 1) for x in sums]
        good = (all_good + 5 * GOOD) / (sum(patterns.values()) + 5)
    return math.log(good / (1 - good)), weights()


def judge(docs: DataFrame, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (less ``text`` if not ``keep_text``) with the columns of STATS, base_failed, quality (posterior
    probability) and kept."""
    rows = with_stats(without(docs, "base_failed", "quality", "kept"), text)
    rows = materialize(rows if keep_text else rows.drop(text))
    rules = votes()
    counted = rows.select([v.alias(name) for name, v in rules.items()]).groupBy(*rules).count()
    start, weights = estimate({tuple(row[name] for name in rules): row["count"] for row in counted.collect()}, len(rules))
    odds = F.lit(start)
    for vote, (good, bad) in zip(rules.values(), weights, strict=True):
        odds = odds + F.when(vote == 1, good).when(vote == -1, bad).otherwise(0.0)
    out = rows.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
