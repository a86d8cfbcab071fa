"""One ranking from several differently scaled scores: percentiles, normal scores, weighted mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.ranking import counts_above, global_row_number
from pagewright.operators.skew import join_weighted
from pagewright.plans.materialize import materialize

# Coefficients of Acklam's published rational approximation of the inverse normal
# distribution (central numerator and denominator, tail numerator and denominator), and the
# probability below which the tail form holds.
CENTRE_NUM = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_DEN = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_NUM = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_DEN = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of ``p``, 0 < p < 1, to a relative error of about 1e-9."""
    q = p - 0.5
    r = q * q
    centre = _horner(CENTRE_NUM, r) * q / _horner(CENTRE_DEN, r)
    t = F.sqrt(F.lit(-2.0) * F.ln(F.least(p, F.lit(1.0) - p)))
    tail = _horner(TAIL_NUM, t) / _horner(TAIL_DEN, t)
    return F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(centre)


def score_standings(items: DataFrame, key: str, scores: list[str]) -> DataFrame:
    """Where each item stands by each score.

    Returns ``key`` and, for each score ``s``: ``s_above`` (items with a strictly greater value),
    ``s_ties`` (items with the same one), ``s_valid`` and ``s_pct``, the empirical percentile with averaged ties, (N - above - ties/2) / N.
    A null, NaN or negative value is below all others; such values tie with each other. Repeated rows
    count once; of several different rows with one key the greatest value of each score stays. Rows
    with a null key are left out. An empty table gives no rows.
    """
    valid = [F.max(F.when((F.col(s) >= 0) & ~F.isnan(s), F.col(s).cast("double"))).alias(s) for s in scores]
    once = materialize(items.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*valid), "standings")
    n = once.count()
    out = once
    for s in scores:
        above = counts_above(once, s).withColumnsRenamed({"value": s, "ties": f"{s}_ties", "above": f"{s}_above"})
        present = once.filter(F.col(s).isNotNull()).count()
        placed = join_weighted(out.filter(F.col(s).isNotNull()), above, s, f"{s}_ties", present)
        bottom = out.filter(F.col(s).isNull()).withColumns({f"{s}_ties": F.lit(n - present).cast("long"), f"{s}_above": F.lit(present).cast("long")})
        both = placed.unionByName(bottom)
        pct = (F.lit(float(n)) - F.col(f"{s}_above") - F.col(f"{s}_ties") / 2) / F.lit(float(max(n, 1)))
        out = both.withColumns({f"{s}_valid": F.col(s).isNotNull(), f"{s}_pct": pct})
        if s != scores[-1]:
            out = materialize(out, "standings")
    columns = [c for s in scores for c in (f"{s}_above", f"{s}_ties", f"{s}_valid", f"{s}_pct")]
    return out.select(F.col("_key").alias(key), F.lit(n).cast("long").alias("items"), *columns)


def _mean(values: list[Column], weights: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [v * w for v, w in zip(values, weights, strict=True)]) / sum(weights)


def _weights(scores: list[str], weights: list[float] | None) -> list[float]:
    out = weights or [1.0] * len(scores)
    if len(out) != len(scores) or min(out) < 0 or sum(out) <= 0:
        raise ValueError("one weight for each score, none negative, with a positive sum")
    return out


def fused_scores(standings: DataFrame, scores: list[str], weights: list[float] | None = None) -> DataFrame:
    """Add ``score``, the weighted mean of the standings' normal quantiles."""
    return standings.withColumn("score", F.round(_mean([inverse_normal(F.col(f"{s}_pct")) for s in scores], _weights(scores, weights)), 9))


def fused_ranking(items: DataFrame, key: str, scores: list[str], weights: list[float] | None = None) -> DataFrame:
    """Rank items by the weighted mean of their scores' normal quantiles: ``key, score, rank``.

    Only order counts within a score, so no score prevails through its range. Ties in the fused
    score go by ``key``. See :func:`score_standings` for missing values and repeated rows.
    """
    _weights(scores, weights)
    fused = materialize(fused_scores(score_standings(items, key, scores), scores, weights).select(key, "score"), "fused")
    return global_row_number(fused, "score", key).select(key, "score", "rank")


def best_by_all(standings: DataFrame, key: str, scores: list[str], percent: int = 10) -> DataFrame:
    """Items of which fewer than ``percent`` % are greater by each of the scores.

    Candidates go by the fused score. An item with so few above it by a score stands, with ties averaged,
    at least half its ties below the percentile in question; so its fused score is at least the mean of
    the normal quantiles there. Whoever reaches that is checked score by score, exactly.
    """
    lowest = [inverse_normal(F.greatest(F.lit(1 - percent / 100) - F.col(f"{s}_ties") / 2 / F.col("items"), F.lit(1e-12))) for s in scores]
    likely = materialize(fused_scores(standings, scores), "fused").filter(F.col("score") >= _mean(lowest, [1.0] * len(scores)) - 1e-6)
    best = reduce(lambda a, b: a & b, [F.col(f"{s}_valid") & (F.col(f"{s}_above") * 100 < F.col("items") * percent) for s in scores])
    return likely.filter(best).select(key)
