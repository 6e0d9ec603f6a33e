"""Quality rules: a decision list learned by sequential covering.

From labelled statistics, rules for rejection are learned one after another. A rule is a
conjunction of thresholds; it grows by the condition with the best FOIL gain on two thirds
of the rows, is pruned from its end on the other third, and is kept while it stays precise
there. The rows that it covers go, and the next rule is learned. The ordered rules become
one Spark conditional expression.

The rules are fitted on at most ``SAMPLE`` labelled rows, those whose ids hash lowest.

Defined cases: a null text counts as empty and has no words, so the base rules reject it;
labels of one class only, or none, give an empty list that rejects nothing; repeated rows
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled, unused
from .textstats import COUNTS, RATIOS, document_stats, with_stats

#: Most labelled rows that the rules are fitted on.
SAMPLE = 20_000
#: Conditions in a rule, rules in a list, cuts tried for a statistic.
CONDITIONS, RULES, CUTS = 4, 16, 48
#: A rule must be this precise on the rows held back for pruning.
PRECISION = 0.9


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x > self.value if self.above else x <= self.value

    def column(self, prefix: str = "") -> Column:
        c = F.col(prefix + self.name)
        return c > self.value if self.above else c <= self.value

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x[:, names.index(c.name)])
    return out


def grow(x: np.ndarray, y: np.ndarray, names: list[str]) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(y), bool)
    while len(rule) < CONDITIONS and (~y[inside]).any():
        p0, n0 = y[inside].sum(), (~y[inside]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for j, name in enumerate(names):
            v, t = x[inside, j], y[inside]
            cuts = np.unique(np.quantile(np.concatenate([v, v[t]]), np.linspace(0, 1, CUTS)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            for above in (True, False):
                hold = v[:, None] > cuts if above else v[:, None] <= cuts
                p, n = hold[t].sum(axis=0), hold[~t].sum(axis=0)
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), 0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    k = int(gain.argmax())
                    best = (float(gain[k]), Condition(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x[:, names.index(best[1].name)])
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[Rule, float]:
    """The shortest best start of the rule, with its precision."""
    best: tuple[float, Rule, float] = (-2.0, (), 0.0)
    for k in range(1, len(rule) + 1):
        inside = covered(rule[:k], x, names)
        p, n = int(y[inside].sum()), int((~y[inside]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0] + 1e-9:
            best = (worth, rule[:k], (p + 1) / (p + n + 1.1))
    return best[1], best[2]


def learn(x: np.ndarray, y: np.ndarray, fold: np.ndarray, names: list[str]) -> list[Rule]:
    """Ordered rules for y, true to reject; ``fold`` holds a row back for pruning."""
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    while len(rules) < RULES:
        g, h = left & ~fold, left & fold
        if y[g].sum() < 2 or not (~y[g]).any():
            break
        rule, precision = prune(grow(x[g], y[g], names), x[h], y[h], names)
        if not rule or precision < PRECISION or not y[g & covered(rule, x, names)].any():
            break
        rules.append(rule)
        left &= ~covered(rule, x, names)
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """True to keep: the list as one ordered conditional expression."""
    out: Column | None = None
    for rule in rules:
        test = rule[0].column(prefix)
        for c in rule[1:]:
            test = test & c.column(prefix)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def sampled(labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, y, h) of the labelled ids that hash lowest."""
    return labelled(labels, "quality").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)


def fit_rules(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    names = list(RATIOS)
    rows = stats.join(sampled(labels, sample), "doc_id").orderBy("h", "doc_id", *COUNTS).limit(sample).select("h", "y", *names).toPandas()
    if not len(rows):
        return []
    return learn(rows[names].to_numpy(float), (rows["y"] == 0).to_numpy(), (rows["h"] % 3 == 0).to_numpy(), names)


def base_failed(prefix: str = "") -> Column:
    n, again = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 10) | (100 * again > 20 * n)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that the base rules and the learned list keep."""
    few = sampled(labels, sample).select("doc_id")
    rules = fit_rules(document_stats(docs.join(few, "doc_id", "left_semi")), labels, sample)
    prefix = unused(docs, "korpuscle_")
    return with_stats(docs, prefix).where(~base_failed(prefix) & verdict(rules, prefix)).select(*docs.columns)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of docs."""
    stats = cut(document_stats(docs))
    rules = fit_rules(stats, labels, sample)
    return stats.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
