"""Column expressions whose nulls, zero denominators, ties and clipping have one defined meaning.

A ratio over a denominator that is null or not positive is null; NaN becomes null on the way in; ranks are averaged over ties;
clipping keeps a null null.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    return F.when(col(den) > 0, col(num) / col(den))


def clip(x, low: float, high: float) -> Column:
    return F.when(col(x).isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), col(x))))


def no_nan(x) -> Column:
    return F.when(~F.isnan(col(x)), col(x))


def share(condition: Column) -> Column:
    """Of all rows, those where the condition holds; a null doesn't."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def correlation(x, y) -> Column:
    """Pearson's; null where either side has no variance, by its ends: partial variances of equal values may add up to a rounding
    error."""
    return F.when((F.max(col(x)) > F.min(col(x))) & (F.max(col(y)) > F.min(col(y))), F.covar_pop(col(x), col(y)) / F.sqrt(F.var_pop(col(x)) * F.var_pop(col(y))))


def rounded(df, digits: int = 6):
    """Doubles at ``digits`` decimals, so that sums in another order compare equal; no zero is negative."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rmse_floor(sigma, inverse_docs) -> Column:
    return F.sqrt(col(sigma) * col(sigma) * col(inverse_docs))


def reliability(noise_var, total_var) -> Column:
    return clip(1 - ratio(noise_var, total_var), 0.0, 1.0)


def r2_corrected(r2, rel) -> Column:
    return ratio(r2, rel)


def disattenuated(r, rel) -> Column:
    return F.when(col(rel) > 0, col(r) / F.sqrt(col(rel)))


def fraction_of_ceiling(rmse, rmse_mean, floor) -> Column:
    """1 at the noise floor, 0 at the mean predictor; null where the floor reaches the mean predictor."""
    return ratio(col(rmse_mean) - col(rmse), col(rmse_mean) - col(floor))


Z_ALPHA, Z_POWER = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(0.8)


def mde(se) -> Column:
    """Least effect found in four of five samples at the 5 % level."""
    return F.lit(Z_ALPHA + Z_POWER) * col(se)


def mde_rmse(n, floor, v, rho) -> Column:
    """That effect for an RMSE difference of two models with residual variance v each and correlation rho, n rows."""
    total = col(floor) * col(floor) + col(v)
    return mde(F.sqrt(4 * total * total * (1 - col(rho) * col(rho)) / col(n)) / (2 * F.sqrt(total)))


def chance_above(delta, sigma, n=1.0) -> Column:
    """P(|difference of two noisy values| >= delta), by a normal tail in Abramowitz and Stegun's form 7.1.26."""
    z = col(delta) / (col(sigma) * math.sqrt(2.0 / n)) / math.sqrt(2.0)
    t = 1 / (1 + 0.3275911 * z)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
