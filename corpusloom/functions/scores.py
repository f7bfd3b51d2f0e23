"""Score arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of the semantic score, price of 1,000 tokens, and weights of the overall score.
ALPHA = 0.7
PRICE = 0.002
WEIGHTS = {"groundedness": 0.20, "answer_relevancy": 0.60, "factual_accuracy": 0.10, "section_completeness": 0.10, "retrieval_recall": 0.0}


def min_max(score: Column, least: Column, most: Column) -> Column:
    """0 to 1; one half if all scores are equal."""
    return F.when(most == least, 0.5).otherwise((score - least) / (most - least))


def max_scale(score: Column, most: Column) -> Column:
    """A share of the largest score, 0 if that isn't positive; no score is 0, negative ones stay."""
    return F.when(most > 0, F.coalesce(score, F.lit(0.0)) / most).otherwise(0.0)


def fused(semantic: Column, keyword: Column, alpha: float = ALPHA) -> Column:
    return alpha * semantic + (1 - alpha) * keyword


def cosine(a: Column, b: Column) -> Column:
    """Of arrays of doubles; null if a vector is null, 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


def cost(tokens: Column, price: float = PRICE) -> Column:
    return tokens / 1000.0 * price


def confidence_light(x: Column) -> Column:
    return F.when(x >= 0.7, "green").when(x >= 0.4, "yellow").otherwise("red")


def hallucination_light(x: Column) -> Column:
    return F.when(x <= 0.3, "green").when(x <= 0.6, "yellow").otherwise("red")


def overall(metrics: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of the metrics that are there, not made up for those that aren't, 1 at most."""
    weights = WEIGHTS if weights is None else weights
    return F.least(sum((F.coalesce(c, F.lit(0.0)) * weights[name] for name, c in metrics.items()), F.lit(0.0)), F.lit(1.0))


def shown(x: Column, digits: int = 2) -> Column:
    """A number with so many digits, halves up, so that every engine shows the same."""
    return F.format_string(f"%.{digits}f", F.floor(x * 10**digits + 0.5) / 10**digits)
