"""Quality classification by a sparse ensemble of rules over text statistics.

The statistics are DataFrame expressions. Shallow trees are boosted on a bounded labelled sample (statistics only, so the
driver never sees a text), every path from a root becomes a conjunctive rule, an L1-penalised logistic regression keeps a
few of them, and these are compiled back into one Column: scoring is a projection without Python or a shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, id_remainder, label_sample, ship
from .quality_rules import SPACES, SYMBOLS, TERMINAL, word_array

#: Labelled rows for fitting, per class.
PER_CLASS = 3000
TREES, DEPTH, BINS = 40, 3, 24
CUT = 0.7

FEATURES = ("log_words", "word_length", "upper", "symbols", "digits", "marks", "bars", "bangs", "distinct", "log_lines", "same_lines", "ended_lines", "words_per_line")


def with_statistics(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """df with one more double column per name in FEATURES, and the prefix that they bear, which no column of df has. Null
    text counts as empty."""
    p = free_prefix(df.columns)
    t, w, lines, solid, n_words, n_lines = (F.col(f"{p}{x}") for x in ("t", "w", "l", "solid", "n", "m"))
    d = df.withColumn(f"{p}t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumns({f"{p}w": word_array(t), f"{p}l": F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def share(chars: str) -> Column:
        return (F.char_length(t) - F.char_length(F.translate(t, chars, ""))) / F.greatest(solid, F.lit(1))

    d = d.withColumns({f"{p}solid": F.char_length(F.translate(t, SPACES, "")), f"{p}n": F.size(w), f"{p}m": F.size(lines)})
    n, m = F.greatest(n_words, F.lit(1)), F.greatest(n_lines, F.lit(1))
    values = {
        "log_words": F.log1p(n_words),
        "word_length": solid / n,
        "upper": share(upper),
        "symbols": share(SYMBOLS),
        "digits": share("0123456789"),
        "marks": share(".,;:?"),
        "bars": share("|"),
        "bangs": share("!"),
        "distinct": F.size(F.array_distinct(w)) / n,
        "log_lines": F.log1p(n_lines),
        "same_lines": F.lit(1.0) - F.size(F.array_distinct(lines)) / m,
        "ended_lines": F.size(F.filter(lines, lambda x: x.rlike(TERMINAL))) / m,
        "words_per_line": n_words / m,
    }
    d = d.withColumns({f"{p}{k}": v for k, v in values.items()})
    return d.drop(*(f"{p}{x}" for x in ("t", "w", "l", "solid", "n", "m"))), p


# ---------------------------------------------------------------- learning, on the driver


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set, features: np.ndarray) -> np.ndarray:
    """Fit a regression tree to g; returns its values on all rows and adds its paths to rules."""
    value = np.zeros(len(x))
    value[rows] = g[rows].mean()
    if depth == 0 or len(rows) < 40:
        return value
    best = (1e-9, None, None)
    total, n = g[rows].sum(), len(rows)
    for f in features:
        for c in cuts[f]:
            low = x[rows, f] <= c
            k = int(low.sum())
            if k < 15 or n - k < 15:
                continue
            s = g[rows][low].sum()
            gain = s * s / k + (total - s) ** 2 / (n - k) - total * total / n
            if gain > best[0]:
                best = (gain, f, c)
    if best[1] is None:
        return value
    _, f, c = best
    for above in (False, True):
        part = rows[(x[rows, f] > c) == above]
        own = (*path, (int(f), above, float(c)))
        rules.add(tuple(sorted(own)))
        value[part] = _grow(x, cuts, g, part, depth - 1, own, rules, features)[part]
    return value


def _fires(x: np.ndarray, rule: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, c in rule:
        out &= (x[:, f] > c) == above
    return out


def learn_rules(x: np.ndarray, y: np.ndarray, penalty: float = 0.002, seed: int = 3) -> dict:
    """{rules: [(conditions, weight)], bias}: score = sigmoid(bias + sum of the weights of rules that fire)."""
    if len(y) == 0 or y.min() == y.max():
        p = 0.5 if len(y) == 0 else 0.05 + 0.9 * float(y[0])
        return {"rules": [], "bias": float(np.log(p / (1 - p)))}
    rng = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    # cuts lie midway between quantiles, never on a value that many texts share (such as 0)
    grid = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1))) for f in range(x.shape[1])]
    cuts = [(q[1:] + q[:-1]) / 2 for q in grid]
    rules: set = set()
    z = np.zeros(len(y))
    for _ in range(TREES):
        g = (y - 1 / (1 + np.exp(-z))) * weight
        rows = rng.choice(len(y), min(len(y), 2000), replace=False)
        features = rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False)
        value = _grow(x, cuts, g, np.sort(rows), DEPTH, (), rules, features)
        z += 0.5 * value
    listed = sorted(rules)
    if not listed:  # too few texts for any split
        p = min(max(float(y.mean()), 0.05), 0.95)
        return {"rules": [], "bias": float(np.log(p / (1 - p)))}
    a = np.stack([_fires(x, r) for r in listed], 1).astype(np.float64)
    keep = np.flatnonzero((a.mean(axis=0) > 0.005) & (a.mean(axis=0) < 0.995))
    listed, a = [listed[i] for i in keep], a[:, keep]
    if not listed:
        listed, a = [()], np.zeros((len(y), 1))
    # accelerated proximal gradient for the lasso
    w, v, b, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 0.0, 1.0
    step = 4 / max(1.0, float(np.linalg.norm(a * np.sqrt(weight)[:, None], 2) ** 2 / len(y)))
    for _ in range(600):
        r = (1 / (1 + np.exp(-np.clip(a @ v + b, -30, 30))) - y) * weight / len(y)
        new = v - step * (a.T @ r)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= 0.5 * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    z = a @ w + b
    # place the classes' best divide at CUT: the widest gap among the best ones
    order = np.unique(z)
    edges = np.concatenate(([order[0] - 2], (order[1:] + order[:-1]) / 2))
    gaps = np.concatenate(([0.0], np.diff(order)))
    good = np.array([(weight * ((z > e) == (y == 1))).sum() for e in edges])
    best = np.flatnonzero(good >= good.max() - 1e-9)
    edge = edges[best[gaps[best].argmax()]]
    b += float(np.log(CUT / (1 - CUT)) - edge)
    return {"rules": [(r, float(c)) for r, c in zip(listed, w, strict=True) if abs(c) > 1e-6], "bias": b}


def compile_score(model: dict, prefix: str) -> Column:
    """The model as one expression over the columns that with_statistics adds under prefix."""

    def condition(rule: tuple) -> Column:
        return reduce(lambda p, q: p & q, [F.col(f"{prefix}{FEATURES[f]}") > c if above else F.col(f"{prefix}{FEATURES[f]}") <= c for f, above, c in rule])

    z = F.lit(float(model["bias"]))
    for rule, w in model["rules"]:
        z = z + F.when(condition(rule), w).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


# ---------------------------------------------------------------- the operator


def fit_quality(documents: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = PER_CLASS) -> dict:
    """Learn from at most per_class labelled rows of each class; learn is a condition on doc_id. Rows come in an order of
    their own, so that the model depends on the tables only, not on how they are read."""
    ship(documents.sparkSession)
    rows = label_sample(documents, labels, "quality", F.lit(True) if learn is None else learn, per_class)
    d, p = with_statistics(rows.select("text", "y", "point"))
    names = [f"{p}{f}" for f in FEATURES]
    stats = d.select("y", "point", *names).toArrow()  # at most 2 * per_class rows
    x = np.column_stack([stats[c].to_numpy().astype(np.float64) for c in names]) if len(stats) else np.empty((0, len(names)))
    y = stats["y"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, stats["point"].to_numpy()))
    return learn_rules(x[order], y[order])


def score_quality(documents: DataFrame, model: dict) -> DataFrame:
    """doc_id, score (0 to 1, high is good), predicted (1 if score >= 0.7), by the text alone.

    Null and empty texts are scored as texts without words. Rows are judged one by one; an empty table gives an empty
    result. Other columns are ignored. Without labels of both classes the score is the same for all, as it is with too few
    labelled texts for any rule.
    """
    d, p = with_statistics(documents.select("doc_id", "text"))
    d = d.select("doc_id", compile_score(model, p).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(documents: DataFrame, model: dict) -> DataFrame:
    """Rows of documents that score CUT or more, with all their columns, whatever these are called. Null and empty texts are
    judged as texts without words, repeated rows alike; an empty table stays empty."""
    d, p = with_statistics(documents)
    return d.where(compile_score(model, p) >= CUT).drop(*(f"{p}{f}" for f in FEATURES))


def classify_quality(documents: DataFrame, labels: DataFrame, held_out: int = 2, modulus: int = 4) -> DataFrame:
    """Fit on rows whose id remainder is not held_out, score all rows: doc_id, held_out, score, predicted.

    A null id counts as the empty text for the remainder. Everything else is as in score_quality: null and empty texts have no
    words, repeated rows are scored alike, an empty table gives an empty result, other columns are ignored.
    """
    aside = id_remainder("doc_id", modulus) == held_out
    model = fit_quality(documents, labels, ~aside)
    return score_quality(documents, model).select("doc_id", aside.alias("held_out"), "score", "predicted")
