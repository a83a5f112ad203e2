"""Quality rules: a decision list learned by sequential covering, applied as ordered conditional expressions.

Rules cover bad texts. A rule is a conjunction of thresholds on features of the text. It is grown on two thirds of the
labelled rows, one threshold at a time by information gain, then pruned on the other third: the last conditions go
while that raises the rule's accuracy there. Rows that a rule covers are taken out, and the next rule is grown, until a
rule is no better than MIN_PRECISION on rows it was not grown on. Rows that no rule covers are kept. The list becomes a
chain of Spark conditions, so applying it needs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written
from .textstats import FEATURES, text_stats

#: Labelled rows that are learned from at most, those of least hash; the bound on what the driver gathers.
TRAINING_ROWS = 20_000
MIN_PRECISION, MAX_RULES, MAX_CONDITIONS = 0.9, 12, 4


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.expr(FEATURES[self.feature])
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


def _mask(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= x[c.feature] > c.threshold if c.above else x[c.feature] <= c.threshold
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and inside.any() and not bad[inside].all():
        p, n = bad[inside].sum(), inside.sum()
        if not p:
            break
        best = (0.0, None)
        for name in sorted(x):
            values = x[name][inside]
            order = np.argsort(values, kind="stable")
            v, b = values[order], np.cumsum(bad[inside][order])
            cut = np.flatnonzero(v[1:] != v[:-1])
            if not len(cut):
                continue
            for above in (False, True):
                pos = (p - b[cut] if above else b[cut]).astype(float)
                size = (n - cut - 1 if above else cut + 1).astype(float)
                gain = np.where(pos > 0, pos * (np.log2(np.maximum(pos, 1e-9) / size) - np.log2(p / n)), 0)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = float(gain[k]), Condition(name, above, float(v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] is None:
            break
        rule.append(best[1])
        inside = _mask(rule, x, len(bad))
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[list[Condition]]:
    """Rules for the rows where bad is true. No rows, or of one kind only: no rules."""
    rules, left = [], np.ones(len(bad), bool)
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    while len(rules) < MAX_RULES and bad[left & part].any() and bad[left & ~part].any():
        of = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
        rule = _grow(*of(left & part))
        px, pb = of(left & ~part)
        worth = lambda r: ((m := _mask(r, px, len(pb))) & pb).sum() - (m & ~pb).sum()
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _mask(rule, px, len(pb))
        if not rule or not covered.any() or pb[covered].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~_mask(rule, x, len(bad))
    return rules


def verdict(rules: list[list[Condition]]) -> tuple[Column, Column]:
    """Whether a row is kept, and which rule decided (0: none), as ordered conditions."""
    kept, by = F.lit(True), F.lit(0)
    for k in range(len(rules), 0, -1):
        condition = F.lit(True)
        for c in rules[k - 1]:
            condition = condition & c.column()
        kept, by = F.when(condition, F.lit(False)).otherwise(kept), F.when(condition, F.lit(k)).otherwise(by)
    return kept, by


def training_rows(stats: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS):
    """Features and quality of at most `limit` labelled rows, those of least hash."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.join(marked, "doc_id").select("quality", *(F.expr(c).alias(k) for k, c in FEATURES.items()), F.xxhash64("doc_id").alias("h"))
    got = rows.orderBy("h", *FEATURES).limit(limit).toPandas()
    return {k: got[k].to_numpy(float) for k in FEATURES}, got["quality"].to_numpy()


def quality_rules(docs: DataFrame, labels: DataFrame, training_limit: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: neither that nor covered by a
    rule. Null and empty texts have no words and fail. Repeated rows: a row each. Without labels only the base counts.
    """
    stats = written(text_stats(docs), scratch(docs.sparkSession, "rules") + "/stats")
    x, quality = training_rows(stats, labels, training_limit)
    kept, by = verdict(learn(x, quality == 0))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & kept).alias("kept"), by.alias("rule"))
