"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

P(grade <= j) = sigmoid(threshold_j - w.x): one weight per feature, shared by all ordered thresholds. x says which words and
word starts a text has, not how often or in how long a text. Features that go along with the grade no more than by
chance are screened out first; an L1 penalty, by proximal gradient steps with momentum, leaves weights to those
that matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import fsum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

FIT_DOCS, FIT_CHARS, LEAST_DOCS, LEAST_Z = 8000, 32 << 10, 3, 2.5
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    """The words of a text in lower case."""
    return set(WORDS.findall(text.lower())) if text else set()


def forms(word: str) -> tuple[str, str, str]:
    """A word, and its first four and five letters, which word forms share."""
    return word, word[:4] + "*", word[:5] + "*"


def features_of(text: str | None) -> set[str]:
    """The forms of the words of a text."""
    words = words_of(text)
    return words | {w[:4] + "*" for w in words} | {w[:5] + "*" for w in words}


@dataclass(frozen=True)
class Model:
    grades: tuple[float, ...]
    thresholds: tuple[float, ...]
    weights: dict[str, float]

    def chances(self, texts) -> list:
        """P(grade > j) for every text (a row) and threshold (a column)."""
        import numpy as np

        known: dict[str, tuple] = {}
        bearing: set[str] = set()
        z = np.array([fsum([self.weights[f] for f in self._found(t, known, bearing)]) for t in texts], float)
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - z[:, None], -40, 40)))

    def _found(self, text: str | None, known: dict[str, tuple], bearing: set[str]) -> set[str]:
        """The features of a text that have a weight. Each word is looked up once: ``known`` has what was found for the words
        so far, ``bearing`` those with a feature."""
        words = words_of(text)
        for w in words.difference(known):
            known[w] = tuple([f for f in forms(w) if f in self.weights])
            if known[w]:
                bearing.add(w)
        return {f for w in words & bearing for f in known[w]}


def fit(texts: list[str], grades: list[float], penalty: float = 2e-4, steps: int = 200) -> Model:
    """A model of the grades that occur; with a single grade it has no thresholds, with none its grade is 0."""
    import numpy as np

    found = tuple(sorted(set(grades)))
    if len(found) < 2:
        return Model(found or (0.0,), (), {})
    y = np.searchsorted(found, grades)
    numbers: dict[str, int] = {}
    rows = [np.array([numbers.setdefault(f, len(numbers)) for f in features_of(t)], np.int32) for t in texts]
    row, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    counts = np.bincount(column, minlength=len(numbers))
    above = np.bincount(column, (y - y.mean())[row], len(numbers))
    kept = (counts >= LEAST_DOCS) & (np.abs(above) >= LEAST_Z * np.std(y) * np.sqrt(counts))
    names = [f for f, k in zip(numbers, kept.tolist()) if k]
    some = kept[column]
    row, column = row[some], (np.cumsum(kept) - 1)[column[some]]
    del numbers, rows, some
    n, levels = len(y), len(found) - 1
    share = np.clip(np.cumsum(np.bincount(y, minlength=levels + 1))[:-1] / n, 1e-6, 1 - 1e-6)
    theta, w = np.log(share / (1 - share)), np.zeros(len(names))

    def slope(theta, w):
        # P(y) = s(upper) - s(lower), where s is the sigmoid and the outermost thresholds lie at infinity.
        z = np.bincount(row, w[column], n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        s = 1 / (1 + np.exp(-np.clip(edges[None, :] - z[:, None], -40, 40)))
        s[:, 0], s[:, -1] = 0, 1
        d, i = s * (1 - s), np.arange(n)
        p = np.maximum(s[i, y + 1] - s[i, y], 1e-12)
        g = np.zeros((n, levels + 2))
        g[i, y + 1] -= d[i, y + 1] / p
        g[i, y] += d[i, y] / p
        return g[:, 1:-1].sum(0) / n, np.bincount(column, -(g.sum(1) / n)[row], len(names)), -np.log(p).mean()

    # A curvature bound for each weight by itself: a quarter of how often its feature meets others. Rare ones step far.
    length = np.bincount(row, minlength=n) + 1.0
    step_w = 4 * n / np.maximum(np.bincount(column, length[row], len(names)), 1e-9)
    step_theta, t, before = 4 / length.mean(), 1.0, np.inf
    at_theta, at_w = theta, w
    for _ in range(steps):
        g_theta, g_w, _ = slope(at_theta, at_w)
        new_theta, new_w = np.sort(at_theta - step_theta * g_theta), at_w - step_w * g_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step_w * penalty, 0)
        loss = slope(new_theta, new_w)[2] + penalty * np.abs(new_w).sum()
        if loss > before and t > 1:
            t, at_theta, at_w = 1.0, theta, w
            continue
        following = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at_theta = new_theta + (t - 1) / following * (new_theta - theta)
        at_w = new_w + (t - 1) / following * (new_w - w)
        theta, w, t, before = new_theta, new_w, following, loss
    return Model(found, tuple(theta.tolist()), {names[i]: float(w[i]) for i in np.flatnonzero(w)})


def fit_on(docs: DataFrame, labels: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most ``FIT_DOCS`` labelled texts of at most ``FIT_CHARS`` characters, those whose ids have the smallest
    hashes; only their texts are read. ``grade`` is a column of ``labels``; null grades, ids and texts take no part, and where an id has several
    grades its largest counts."""
    graded = labels.select(F.col(id_col).alias("_id"), grade.cast("double").alias("_grade")).dropna().groupBy("_id").agg(
        F.max("_grade").alias("_grade"))
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.length("_text") <= FIT_CHARS)
    ids = some.select("_id").join(graded, "_id").orderBy(F.xxhash64("_id"), "_id").limit(FIT_DOCS)
    picked = some.join(F.broadcast(ids.dropDuplicates(["_id"])), "_id").select("_text", "_grade").toArrow()
    return fit(picked.column("_text").to_pylist(), picked.column("_grade").to_pylist())


def severity(model: Model, text: Column) -> Column:
    """struct(expected, p_toxic) of a text: the expected grade, and the chance of more than the lowest grade.

    A null or empty text has no words and gets what the thresholds alone say."""
    @pandas_udf("struct<expected: double, p_toxic: double>")
    def score(texts):
        import numpy as np
        import pandas as pd

        p = model.chances(texts)
        steps = np.diff(np.array(model.grades))
        expected = model.grades[0] + (p * steps[None, :]).sum(1) if len(steps) else np.full(len(texts), model.grades[0])
        return pd.DataFrame({"expected": expected, "p_toxic": p[:, 0] if len(steps) else np.zeros(len(texts))})

    return score(text)


def grade_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity, p_toxic and toxic (p_toxic of one half or more) of every row, repeated and null ids too.
    Other columns are left out. An empty table gives no rows."""
    rows = df.select(F.col(id_col).alias("doc_id"), severity(model, F.col(text_col)).alias("s"))
    return rows.select("doc_id", F.col("s.expected").alias("expected_severity"), F.col("s.p_toxic").alias("p_toxic"),
                       (F.col("s.p_toxic") >= 0.5).alias("toxic"))
