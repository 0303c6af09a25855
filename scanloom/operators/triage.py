"""Ranking aids: a false-positive model on reviewed findings, rules from examples, catalogue search."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from scanloom.operators.reports import FEATURES, feature_vector

#: Reviewed findings that a model is fitted on at most; beyond it a sample by hash.
SAMPLE_ROWS = 50_000


class FalsePositiveModel:
    """Logistic regression on the features of a finding, fitted on a bounded sample of reviewed rows."""

    def __init__(self) -> None:
        self.weights, self.bias = np.zeros(len(FEATURES)), 0.0

    def fit(self, reviewed: DataFrame, label: str = "is_real", rounds: int = 500, rate: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> FalsePositiveModel:
        """``reviewed``: findings with a boolean label.  At most ``sample_rows`` rows, those with the least hash of row_id, reach the driver."""
        rows = reviewed.where(F.col(label).isNotNull()).orderBy(F.xxhash64("row_id")).limit(sample_rows).select(feature_vector().alias("x"), F.col(label).cast("double").alias("y")).collect()
        if rows:
            x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
            for _ in range(rounds):
                err = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30))) - y
                self.weights -= rate * (x.T @ err) / len(y)
                self.bias -= rate * err.mean()
        return self

    def probability(self) -> Column:
        """Probability that a finding is real, as an expression."""
        f = feature_vector()
        z = F.lit(float(self.bias))
        for n, w in enumerate(self.weights):
            z = z + f[n] * float(w)
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))

    def explain(self) -> Column:
        """(feature number, contribution) by size of the contribution."""
        f = feature_vector()
        parts = F.array(*[F.struct((-F.abs(f[n] * float(w))).alias("order"), F.lit(n).alias("feature"), (f[n] * float(w)).alias("contribution")) for n, w in enumerate(self.weights)])
        return F.transform(F.array_sort(parts), lambda p: F.struct(p["feature"].alias("feature"), p["contribution"].alias("contribution")))


def synthesise_rule(positive: list[str], negative: list[str]) -> str:
    """A pattern of the words that all positive examples share and no negative one has; ValueError if there are none."""
    words = lambda s: set(re.findall(r"[A-Za-z_][A-Za-z0-9_.]{2,}", s))
    common = set.intersection(*map(words, positive)) if positive else set()
    useful = sorted(common - set().union(*map(words, negative)), key=lambda w: (-len(w), w))
    if not useful:
        raise ValueError("the examples share no telling word")
    return r"\b(?:" + "|".join(re.escape(w) for w in useful) + r")\b"


# What a weakness lets happen.
EXPLANATIONS = {
    "CWE-78": "Input can change the command that the operating system runs.",
    "CWE-79": "Unescaped content can run script in another person's browser.",
    "CWE-89": "Untrusted data can change a query's structure and reach or alter data.",
    "CWE-798": "A credential in the code can be read by anyone who has the artefact.",
}


def explanation(cwe: Column, rule_id: Column, description: Column, remediation: Column, education: bool = False) -> Column:
    """Why a finding matters: by its weakness, else its description; with ``education`` also what to do."""
    out = None
    for k, text in EXPLANATIONS.items():
        out = F.when(cwe == k, text) if out is None else out.when(cwe == k, text)
    out = out.otherwise(F.coalesce(description, F.lit("Security risk detected.")))
    if education:
        out = F.concat(out, F.lit(" Rule "), F.coalesce(rule_id, F.lit("unknown")), F.lit("; check the way from source to sink and apply: "), F.coalesce(remediation, F.lit("an equivalent control")), F.lit("."))
    return out


def search_catalogue(rules: DataFrame, query: str) -> DataFrame:
    """Rules whose text holds every word of the query, whatever the case."""
    text = F.lower(F.to_json(F.struct(*rules.columns)))
    out = rules
    for w in query.lower().split():
        out = out.where(F.contains(text, F.lit(w)))
    return out


def precision_recall(cases: DataFrame) -> DataFrame:
    """One row: precision, recall, f1 over cases (expected, actual: arrays of rule ids); 1 where nothing was asked for."""
    tp = F.sum(F.size(F.array_intersect("expected", "actual")))
    fp = F.sum(F.size(F.array_except("actual", "expected")))
    fn = F.sum(F.size(F.array_except("expected", "actual")))
    p = F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp))
    r = F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn))
    return cases.agg(p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))
