"""Expectation-maximisation over the votes of labelers that may abstain."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Accuracies:
    """Prior of good, and for each rule the chance that a vote cast on a good and on a bad document is right."""

    def __init__(self, rules: Iterable[str], prior: float = 0.8, good: float = 0.9, bad: float = 0.5):
        self.prior, self.good, self.start = prior, dict.fromkeys(rules, good), bad
        self.bad = dict.fromkeys(self.good, bad)

    def posterior(self) -> Column:
        """Probability of good given the vote columns: the logistic function of summed log odds."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule in self.good:
            odds = odds + F.when(F.col(rule) == 1, math.log(self.good[rule] / (1 - self.bad[rule]))).when(
                F.col(rule) == -1, math.log((1 - self.good[rule]) / self.bad[rule])).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))

    def refit(self, patterns: DataFrame) -> float:
        """One round: expected votes of each class in one aggregate, then new estimates. Gives the largest change.

        On good items a rule counts as better than chance, which keeps the classes from changing names; on bad ones it
        may miss most, as a rule for one fault does not see the others. No rule is ever certain.
        """
        sums = {"n": F.col("n"), "p": F.col("n") * F.col("p")}
        for rule in self.good:
            for name, vote in (("up", 1), ("down", -1)):
                cast = F.when(F.col(rule) == vote, F.col("n")).otherwise(0)
                sums[f"{rule}:{name}"], sums[f"{rule}:{name}:p"] = cast, cast * F.col("p")
        found = patterns.withColumn("p", self.posterior()).agg(*[F.sum(v).alias(k) for k, v in sums.items()]).first()
        if not found["n"]:
            return 0.0
        before = [self.prior, *self.good.values(), *self.bad.values()]
        self.prior = round(min(max(found["p"] / found["n"], 0.02), 0.98), 6)
        for rule in self.good:
            up, down = found[f"{rule}:up:p"], found[f"{rule}:down:p"]
            not_up, not_down = found[f"{rule}:up"] - up, found[f"{rule}:down"] - down
            self.good[rule] = round(min(max((up + 4) / (up + down + 5), 0.55), 0.99), 6)
            self.bad[rule] = round(min(max((not_down + 4 * self.start) / (not_up + not_down + 4), 0.02), 0.99), 6)
        return max(abs(a - b) for a, b in zip(before, [self.prior, *self.good.values(), *self.bad.values()], strict=True))
