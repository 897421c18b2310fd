"""Expected shares of counts, gaps and addresses, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_factorial(n: Column) -> Column:
    """ln n! in constant time: Stirling's series from n + 10 on, and the ten factors above n taken off again."""
    x = n.cast("double") + F.lit(11.0)
    shifted = F.lit(0.0)
    for step in range(1, 11):
        shifted = shifted + F.ln(n.cast("double") + F.lit(float(step)))
    inverse = F.lit(1.0) / (x * x)
    tail = (F.lit(1 / 12) - inverse * (F.lit(1 / 360) - inverse * (F.lit(1 / 1260) - inverse * F.lit(1 / 1680)))) / x
    return (x - F.lit(0.5)) * F.ln(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + tail - shifted


def poisson(k: Column, mean: Column) -> Column:
    return F.exp(k * F.ln(mean) - mean - log_factorial(k))


def negative_binomial_success(mean: Column, dispersion: int) -> Column:
    return F.lit(float(dispersion)) / (F.lit(float(dispersion)) + mean)


def negative_binomial(k: Column, mean: Column, dispersion: int) -> Column:
    """Chance of k for a whole dispersion n: C(k + n - 1, k) p^n (1 - p)^k."""
    p = negative_binomial_success(mean, dispersion)
    ways = F.lit(1.0)
    for step in range(1, dispersion):
        ways = ways * (k + step) / F.lit(float(step))
    return ways * F.pow(p, F.lit(float(dispersion))) * F.pow(F.lit(1.0) - p, k.cast("double"))


def geometric(k: Column, mean: Column) -> Column:
    """Chance of k = 1, 2, ... with the given mean."""
    p = F.lit(1.0) / mean
    return p * F.pow(F.lit(1.0) - p, k.cast("double") - 1)


def exponential_bin(low: Column, width: Column, mean: Column) -> Column:
    return F.exp(-low / mean) - F.exp(-(low + width) / mean)


def geometric_weight(position: Column, quantity: Column, first_share: float) -> Column:
    """Weight of a position from 0 on among `quantity`, renormalised because the tail is cut."""
    decay = F.lit(1.0 - first_share)
    kept = F.lit(1.0) - F.pow(decay, quantity.cast("double"))
    return F.lit(first_share) * F.pow(decay, position.cast("double")) / kept


def never_drawn(probability: Column, draws: Column) -> Column:
    return F.pow(F.lit(1.0) - probability, draws.cast("double"))
