"""Quality rules as weak supervision, with DataFrame functions only.

Each rule votes for or against a document or abstains. Expectation-maximisation over
the counts of vote patterns (at most 3 to the power of the number of rules, whatever
the table) estimates how often each rule casts each vote on good and on bad
documents, and what share is good. A document is kept if its posterior probability
of being good is at least one half, and no hard rule fails it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, text_or_empty

#: Name: (condition of a vote against, condition of a vote for); neither: the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "capitals": ("n_letters >= 20 and 10 * n_upper > 4 * n_letters", "n_letters >= 20 and 10 * n_upper <= n_letters"),
    "letters": ("n_words >= 32 and 100 * n_letters < 69 * n_chars", "100 * n_letters >= 76 * n_chars"),
    "bare_words": ("5 * n_bare_words > n_words", "50 * n_bare_words <= n_words"),
    "word_length": ("n_words >= 32 and word_chars > 7 * n_words or n_words >= 32 and word_chars < 3 * n_words", "10 * word_chars between 42 * n_words and 58 * n_words"),
    "windows": ("10 * n_repeat_words > 2 * n_words", "20 * n_repeat_words <= n_words"),
    "lines": ("n_dup_lines > 1 and 10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0 and n_lines > 1"),
    "line_ends": ("2 * n_ended_lines < n_lines", "10 * n_ended_lines >= 9 * n_lines"),
    "stutter": ("10 * n_stutter > n_words", "50 * n_stutter <= n_words and n_words > 1"),
}

_BLANK = r"[\x20\x09-\x0D]"


def features(rows: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """``keep`` and the counts that the rules are about, for each row.

    A filter on the counts must come behind a checkpoint: else the optimiser pushes it
    below, where it would work out every step anew for each word.
    """
    held = [f"keep_{i}" for i in range(len(keep))]
    rows = rows.select(*(c.alias(n) for c, n in zip(keep, held, strict=True)), text_or_empty(text).alias("text"))
    # Each step's columns are used more than once in the next, so that the optimiser leaves the steps apart.
    rows = rows.select(*held, "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    rows = rows.select(
        *held,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.char_length("text").cast("long").alias("n_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.char_length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(rf"[.!?…][\"'”»)\]]*{_BLANK}*\z"))).cast("long").alias("n_ended_lines"),
        F.size(F.filter("words", lambda x: ~x.rlike(r"\p{L}"))).cast("long").alias("n_bare_words"),
        F.expr("cast(if(size(words) > 1, size(filter(sequence(1, size(words) - 1), i -> words[i] = words[i - 1])), 0) as long)").alias("n_stutter"),
        F.expr("if(size(words) >= 5, transform(sequence(0, size(words) - 5), i -> xxhash64(words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4])), array())").alias("windows"),
    )
    rest = [c for c in rows.columns if c != "windows"]
    # Only texts with a repeated window go on to sort theirs; equal hashes then stand side by side.
    rows = rows.select(*rest, F.expr("if(size(array_distinct(windows)) < size(windows), array_sort(transform(windows, (x, i) -> struct(x, i))), array())").alias("pairs"))
    rows = rows.select(*rest, F.expr("array_sort(transform(filter(pairs, (p, j) -> (j > 0 and pairs[greatest(j - 1, 0)].x = p.x) or (j < size(pairs) - 1 and pairs[least(j + 1, size(pairs) - 1)].x = p.x)), p -> p.i))").alias("at"))
    rows = rows.select(*rest, F.expr("cast(if(size(at) = 0, 0, 5 + if(size(at) > 1, aggregate(sequence(1, size(at) - 1), 0, (n, j) -> n + least(5, at[j] - at[j - 1])), 0)) as long)").alias("n_repeat_words"))
    return rows


def _vote(rule: str) -> Column:
    against, favour = RULES[rule]
    return F.when(F.col("n_words") == 0, "0").when(F.expr(against), "-").when(F.expr(favour), "+").otherwise("0")


def with_votes(rows: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("*", failed.alias("base_failed"), F.concat(*(_vote(r) for r in RULES)).alias("votes"))


class LabelModel:
    """How often each rule casts each vote on good and on bad documents, and the share of good ones."""

    def __init__(self, prior: float, likely: list[dict[str, tuple[float, float]]]):
        self.prior, self.likely = prior, likely

    def posterior(self, votes: str = "votes") -> Column:
        """The probability that a document with these votes is good."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for k, table in enumerate(self.likely):
            vote = F.substring(votes, k + 1, 1)
            ratio = {v: math.log(good / bad) for v, (good, bad) in table.items()}
            odds = odds + F.when(vote == "-", ratio["-"]).when(vote == "+", ratio["+"]).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))

    def of_votes(self, cast: dict[str, np.ndarray]) -> np.ndarray:
        """The same for the fit's own table of patterns."""
        odds = math.log(self.prior / (1 - self.prior)) + sum(cast[v] @ np.log([table[v][0] / table[v][1] for table in self.likely]) for v in "+-")
        return 1 / (1 + np.exp(-odds))


def fit(patterns: DataFrame, rounds: int = 50, tolerance: float = 1e-4) -> LabelModel:
    """EM over rows (votes, n): at most 3 to the power of the number of rules, whatever the table, which reach the driver once.

    It starts from the votes themselves, a vote against counting four times one in
    favour. Abstaining says nothing about a document. Sums are smoothed by one
    vote, so an empty table gives even odds.
    """
    rows = sorted((r["votes"], r["n"]) for r in patterns.select("votes", "n").collect())
    rules, n = len(RULES), np.array([n for _, n in rows], dtype=float)
    cast = {v: np.array([[x == v for x in votes] for votes, _ in rows], dtype=float).reshape(len(rows), rules) for v in "+-"}
    against, favour = cast["-"].sum(axis=1), cast["+"].sum(axis=1)
    good = (favour + 1) / (favour + 1 + 4 * against)
    model, before = LabelModel(0.5, []), None
    for _ in range(rounds):
        held, all_cast = {v: (n * good) @ cast[v] for v in "+-"}, {v: n @ cast[v] for v in "+-"}
        good_casts = held["+"] + held["-"] + 2
        bad_casts = all_cast["+"] + all_cast["-"] + 4 - good_casts
        likely = [{v: (float((held[v][k] + 1) / good_casts[k]), float((all_cast[v][k] - held[v][k] + 1) / bad_casts[k])) for v in "+-"} for k in range(rules)]
        model = LabelModel(float(((n * good).sum() + 1) / (n.sum() + 2)), likely)
        now = np.array([model.prior, *(p for table in likely for pair in table.values() for p in pair)])
        if before is not None and np.abs(now - before).max() < tolerance:
            break
        before, good = now, model.of_votes(cast)
    return model


def patterns(voted: DataFrame) -> DataFrame:
    return checkpointed(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts, base_failed, p_good, kept), a row for each row of ``docs``.

    Null text has no words. Texts without words get no votes, and fail by base_failed
    (under 10 words, or over 20 in 100 of its words in 5-word windows that recur).
    Null ids, ties and repeated rows are rows like any other; so are very long texts,
    which are taken whole. Other columns play no part. No rows: no rows.
    """
    rows = checkpointed(with_votes(features(docs, docs[text_col], [docs[id_col]])).withColumnRenamed("keep_0", "doc_id"))
    model = fit(patterns(rows))
    rows = rows.withColumn("p_good", model.posterior())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with all their columns; nothing but counts of patterns is shuffled.

    Each row is written once with its votes, the model is fitted to these, and the rows
    are read back and filtered. Null text and texts without words fail by base_failed;
    long texts are taken whole. Null ids, ties and repeated rows are rows like any other;
    columns named like the counts are kept as they are. No rows: no rows.
    """
    row = F.struct(*(docs[c] for c in docs.columns))
    rows = checkpointed(with_votes(features(docs, docs[text_col], [row])).select("keep_0", "base_failed", "votes"))
    model = fit(patterns(rows))
    return rows.where(~F.col("base_failed") & (model.posterior() >= 0.5)).select("keep_0.*")
