"""Quality rules by weak supervision.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the counts of vote patterns, of which
there are at most 3 ** rules whatever the corpus, estimates how often each rule is right on good and on bad documents;
the posterior probability of good replaces a filter that every rule must pass. DataFrame functions only.

Null and empty texts have no words and fail. Repeated rows are judged each for itself. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, let, words
from .weak import Accuracies

WINDOW = 5

#: name -> (votes good when, votes bad when), over the columns of `statistics`
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words >= 50", "n_words < 10"),
    "word_length": ("word_chars BETWEEN 4 * n_words AND 7 * n_words", "word_chars NOT BETWEEN 2 * n_words AND 12 * n_words"),
    "symbols": ("1000 * n_symbols <= 5 * n_words", "10 * n_symbols > n_words"),
    "symbol_share": ("1000 * n_symbols <= word_chars", "50 * n_symbols > word_chars"),
    "plain_words": ("100 * n_plain >= 95 * n_words", "100 * n_plain < 85 * n_words"),
    "dup_lines": ("n_lines >= 3 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    "repeats": ("100 * n_repeat_words <= 5 * n_words", "100 * n_repeat_words > 20 * n_words"),
    "capitals": ("10 * n_upper <= word_chars", "10 * n_upper > 4 * word_chars"),
    "sentences": ("100 * n_ends BETWEEN 2 * n_words AND 30 * n_words",
                  "100 * n_ends > 40 * n_words OR (n_words >= 50 AND n_ends = 0)"),
}


def repeat_words(word_list: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more, the first included.

    Windows are compared by 64-bit hashes within one text. Sorted (hash, place) pairs put equal windows side by side;
    each such window adds the words that the one before it did not cover.
    """

    def covered(places: Column) -> Column:
        new = F.transform(places, lambda p, i: F.least(F.lit(width), p - F.coalesce(F.get(places, i - 1), p - width)))
        return F.aggregate(new, F.lit(0), lambda total, x: total + x)

    def doubled(pairs: Column) -> Column:
        marked = F.transform(pairs, lambda p, i: F.when(
            (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]), p["i"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def over(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        several = F.size(F.array_distinct(windows)) < F.size(windows)
        return F.when(several, let(let(pairs, doubled), covered)).otherwise(0)

    def hashed(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - width)
        windows = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
        return F.when(F.size(hashes) >= width, let(windows, over)).otherwise(0)

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), hashed).cast("long")


def statistics(text: Column) -> Column:
    """One struct of counts over a whole text; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_lines(lines: Column) -> list[Column]:
        full = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        return [let(full, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                             (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))]

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            *[x.alias("of_lines") for x in of_lines(F.split(text, "\n"))],
            repeat_words(w).alias("n_repeat_words"),
            F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.size(F.filter(w, lambda x: x.rlike(r"[.!?]$"))).cast("long").alias("n_ends"),
            F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}+[.,;:]?$"))).cast("long").alias("n_plain"),
        )

    return let(words(text), of_words)


BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def judge(docs: DataFrame, rules: Mapping[str, tuple[str, str]] = RULES, rounds: int = 30,
          least: float = 0.5, carry: Sequence[str] = ("*",)) -> DataFrame:
    """`row` (the columns of the input row named by `carry`), the statistics, `base_failed`, a vote column for each rule, `posterior` and `kept`.

    The counted rows are written once: vote patterns and the verdict both come from them, and no text is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    counted = docs.select(F.struct(*carry).alias("row"), statistics(F.col("text")).alias("s")).select("row", "s.*").select(
        "*", "of_lines.*").drop("of_lines")
    votes = [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END").alias(name)
             for name, (good, bad) in rules.items()]
    voted = scratch.write(counted.select("*", F.expr(BASE_FAILED).alias("base_failed"), *votes), "voted")
    patterns = scratch.write(voted.groupBy(*rules).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    found = Accuracies(rules)
    for _ in range(rounds):
        if found.refit(patterns) < 1e-5:
            break
    scratch.drop("patterns")
    posterior = F.round(found.posterior(), 9).alias("posterior")
    return voted.select("*", posterior).select("*", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"))


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, all their columns as they were."""
    return judge(docs, **options).where("kept").select("row.*")
