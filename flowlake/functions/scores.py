"""Expressions over class-score arrays: softmax, decisions, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Probability clip of the log loss, pseudo-probability of a hard prediction.
CLIP = 1e-15
HARD_SHARE = 0.9


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body) -> Column:
    """Bind a value once for a lambda that would otherwise recompute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _exp_shifted(s: Column) -> Column:
    return _let(F.array_max(s), lambda m: F.transform(s, lambda v: F.exp(v - m)))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def softmax(scores: str | Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    return _let(
        _exp_shifted(_c(scores)), lambda raised: _let(_total(raised), lambda t: F.transform(raised, lambda v: v / t))
    )


def log_softmax(scores: str | Column) -> Column:
    s = _c(scores)
    return _let(
        F.array_max(s) + F.ln(_total(_exp_shifted(s))), lambda shift: F.transform(s, lambda v: v - shift)
    )


def argmax(scores: str | Column) -> Column:
    """Index of the first maximum."""
    s = _c(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def confidence(scores: str | Column) -> Column:
    return F.array_max(_c(scores))


def at_class(scores: str | Column, label: str | Column) -> Column:
    """Score of the given class; null when the class is outside the array."""
    return F.get(_c(scores), _c(label).cast("int"))


def one_hot(label: str | Column, classes: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == _c(label), 1.0).otherwise(0.0)
    )


def probability_columns(scores: str | Column, classes: int) -> list[Column]:
    return [F.get(_c(scores), F.lit(i)).alias(f"prob_class_{i}") for i in range(classes)]


def pseudo_probabilities(pred: str | Column, classes: int) -> Column:
    """Hard prediction as probabilities: 0.9 on it, the rest shared; uniform when out of range."""
    p = _c(pred)
    other = (1.0 - HARD_SHARE) / max(1, classes - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda i: F.when(~p.between(0, classes - 1), F.lit(1.0 / classes))
        .when(i == p, F.lit(HARD_SHARE))
        .otherwise(F.lit(other)),
    )


def binary_decision(score: str | Column) -> Column:
    return F.when(_c(score) >= 0.5, 1).otherwise(0)


def binary_name(score: str | Column) -> Column:
    return F.when(_c(score) >= 0.5, "malicious").otherwise("benign")


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0 - CLIP))


def row_log_loss(probs: str | Column, label: str | Column, classes: int) -> Column:
    """-ln p[label], clipped; null when the array has the wrong length.

    Labels outside the classes are clamped into them.
    """
    y = F.least(F.greatest(_c(label), F.lit(0)), F.lit(classes - 1))
    return F.when(F.size(_c(probs)) == classes, -F.ln(clipped(at_class(probs, y))))


def row_hard_log_loss(pred: str | Column, label: str | Column) -> Column:
    """Log loss of a one-hot prediction."""
    hit = _c(pred) == _c(label)
    return -F.ln(F.when(hit, F.lit(1.0 - CLIP)).otherwise(F.lit(CLIP)))


def focal(logits: str | Column, label: str | Column, gamma: float, alpha: Column | None = None) -> Column:
    """alpha * (1 - pt)^gamma * (-ln pt) of one row of logits."""
    logp = at_class(log_softmax(logits), label)
    loss = F.pow(F.lit(1.0) - F.exp(logp), F.lit(gamma)) * -logp
    return loss if alpha is None else alpha * loss


def smoothed_cross_entropy(logits: str | Column, label: str | Column, classes: int, epsilon: float = 0.1) -> Column:
    """Sum over classes of -target * log p with smoothed targets."""
    parts = F.transform(
        log_softmax(logits),
        lambda v, i: -v
        * (F.when(i == _c(label), 1.0 - epsilon).otherwise(0.0) + F.lit(epsilon / classes)),
    )
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)
