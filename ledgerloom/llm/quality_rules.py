"""Quality rules as weak supervision.

Each rule votes good (1) or bad (-1) or abstains (0).  Votes are counted by
pattern (3 ** rules at most, however many documents there are), expectation
maximisation over these counts estimates each rule's accuracy and the share of
good documents, and a document's verdict is its posterior probability of being
good.  No rule rejects alone; only the base conditions of too few words and of
too much repetition do.  The rules are sensitive, so that clean documents often
get a bad vote; the model decides whose votes outweigh the others.

Estimates are free but for weak Beta priors worth a vote or two; that "bad" is
the lesser class with more bad votes is set by the start only.  Rules that
would nearly always vote alike are one rule.

Features need one pass over the text and are written to the shared folder.

Defined cases: a null, empty or blank text has no words and fails the base; an
empty table gives an empty result; repeated rows get the same verdict; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

SPACE = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of words
ROUNDS = 50
#: Start of the estimates: share of good documents, chance of a bad vote on a bad and on a good document.
START = (0.85, 0.3, 0.02)
#: Priors as votes: (bad, all) for a vote on a bad and on a good document, (good, all) for documents.
CAUGHT_PRIOR, BLAMED_PRIOR, GOOD_PRIOR = (1, 2), (0.1, 2), (4, 5)

#: Frequent words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be this by an or which from at"
    " de la le les et des un une en que qui dans pour par sur est du au"
    " der die das und ist von zu mit den im nicht auch auf als für ein eine dem des sich"
    " el los las y una con para por del se como más su al lo"
).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once a row and use it many times."""
    return F.get(F.transform(F.array(value), body), 0)


def word_array(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return let(F.array_sort(F.transform(twice, lambda x: x["p"])), covered_words)

        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(pairs), of_sorted))

    def covered_words(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    hashes = F.transform(
        F.slice(words, 1, F.size(words) - (WINDOW - 1)),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]),
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, of_hashes))


def feature_struct(text: Column) -> Column:
    """The counts that base conditions and rules use, as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> list[Column]:
        return [
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(F.array_intersect(w, F.lit(STOP_WORDS))).cast("long").alias("n_stop"),
        ]

    def of_lines(ls: Column) -> list[Column]:
        return [
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        ]

    rest = [
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    ]
    with_word = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    return let(word_array(text), lambda w: let(with_word, lambda ls: F.struct(*of_words(w), *of_lines(ls), *rest)))


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str


#: Shares are written as products, so that no rule divides.  Variety is a power, which holds for texts of any length.
RULES = (
    Rule("symbols", "n_symbols * 14 >= word_chars OR n_symbols * 10 >= n_words * 3", "n_symbols * 50 <= n_words"),
    Rule("shouting", "n_shouts * 5 >= n_words", "n_shouts * 50 <= n_words"),
    Rule("capitals", "n_upper * 10 >= word_chars * 4", "n_upper * 10 <= word_chars * 2"),
    Rule("repeated_lines", "n_dup_lines >= 1 AND n_dup_lines * 5 >= n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    Rule("repeated_words", "n_repeat_words * 10 > n_words", "n_repeat_words = 0 AND n_words >= 50"),
    Rule("stop_words", "n_stop <= 1 AND n_words >= 20", "n_stop >= 5"),
    Rule("word_length", "word_chars >= n_words * 7 OR word_chars * 10 <= n_words * 42", "word_chars * 10 BETWEEN n_words * 45 AND n_words * 60"),
    Rule("variety", "n_words >= 20 AND n_distinct <= power(n_words, 0.88)", "n_words >= 20 AND n_distinct >= power(n_words, 0.93)"),
    Rule("length", "n_words < 40", "n_words >= 80"),
)


#: Struct column that holds the features of a row.
HELD = "__features"


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """A column of votes for each rule, from the features in ``HELD``."""

    def sql(condition: str) -> str:
        return re.sub(r"\b(n_\w+|word_chars)\b", rf"{HELD}.\1", condition)

    return [F.expr(f"CASE WHEN {sql(r.bad)} THEN -1 WHEN {sql(r.good)} THEN 1 ELSE 0 END").cast("tinyint").alias(r.name) for r in rules]


@dataclass(frozen=True)
class WeakModel:
    """Share of good documents and, for each rule where it votes, its two accuracies.

    ``caught``: chance of a bad vote on a bad document.  ``blamed``: chance of a
    bad vote on a good one.  Two numbers, because a rule that knows one kind of
    junk is nearly always right when it votes bad and says little when it votes good.
    """

    good: float
    caught: tuple[float, ...]
    blamed: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """Log odds of good that a good and a bad vote of each rule add."""
        return [(math.log((1 - b) / (1 - a)), math.log(b / a)) for a, b in zip(self.caught, self.blamed)]

    def prior(self) -> float:
        return math.log(self.good / (1 - self.good))

    def posterior(self, pattern: tuple[int, ...]) -> float:
        odds = self.prior() + sum((g if v > 0 else b) for v, (g, b) in zip(pattern, self.weights()) if v)
        return 1 / (1 + math.exp(min(-odds, 700)))


def fit(counts: dict[tuple[int, ...], int], rules: int, rounds: int = ROUNDS) -> WeakModel:
    """Expectation maximisation over counts of vote patterns, in a fixed order."""
    items = sorted(counts.items())
    total = sum(n for _, n in items)
    model = WeakModel(START[0], (START[1],) * rules, (START[2],) * rules)
    for _ in range(rounds if total else 0):
        good = 0.0
        bad_votes, all_votes = [[0.0, 0.0] for _ in range(rules)], [[0.0, 0.0] for _ in range(rules)]
        for pattern, n in items:
            p = model.posterior(pattern)
            good += n * p
            for r, v in enumerate(pattern):
                if v:
                    for k, share in enumerate((1 - p, p)):
                        all_votes[r][k] += n * share
                        bad_votes[r][k] += n * share * (v < 0)
        model = WeakModel(
            (good + GOOD_PRIOR[0]) / (total + GOOD_PRIOR[1]),
            tuple((x[0] + CAUGHT_PRIOR[0]) / (y[0] + CAUGHT_PRIOR[1]) for x, y in zip(bad_votes, all_votes)),
            tuple((x[1] + BLAMED_PRIOR[0]) / (y[1] + BLAMED_PRIOR[1]) for x, y in zip(bad_votes, all_votes)),
        )
    return model


def fit_votes(rows: DataFrame, names: list[str]) -> WeakModel:
    """``rows`` has a column of votes for each name.  The driver gets 3 ** len(names) rows at most."""
    counts = {tuple(r[n] for n in names): r["count"] for r in rows.groupBy(*names).count().collect()}
    return fit(counts, len(names))


def posterior(model: WeakModel, cast: list[Column]) -> Column:
    odds = F.lit(model.prior())
    for vote, (good, bad) in zip(cast, model.weights()):
        odds = odds + F.when(vote > 0, F.lit(good)).when(vote < 0, F.lit(bad)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def base_failed() -> Column:
    n, repeated = F.col(f"{HELD}.n_words"), F.col(f"{HELD}.n_repeat_words")
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: features, votes, base_failed, posterior and kept."""
    names = [r.name for r in rules]
    measured = documents(docs).select("doc_id", feature_struct(F.col("text")).alias(HELD))
    rows = stored(measured.select("*", *votes(rules)), "quality-votes")
    model = fit_votes(rows, names)
    scored = rows.select(
        "doc_id", f"{HELD}.*", *names, base_failed().alias("base_failed"), posterior(model, [F.col(n) for n in names]).alias("posterior")
    )
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with its own columns, without the rejected documents.

    Texts are measured once: they are written with their votes, the model is fitted on the votes, and the rows that
    it keeps are read again.  No text is shuffled.
    """
    columns = docs.columns
    names = [f"__vote_{r.name}" for r in rules]
    measured = docs.withColumn(HELD, feature_struct(docs["text"].cast("string")))
    cast = [v.alias(n) for v, n in zip(votes(rules), names)]
    rows = stored(measured.select(*[f"`{c}`" for c in columns], base_failed().alias("__base_failed"), *cast), "quality-rows")
    model = fit_votes(rows, names)
    good = ~F.col("__base_failed") & (posterior(model, [F.col(n) for n in names]) >= 0.5)
    return rows.filter(good).select(*[f"`{c}`" for c in columns])
