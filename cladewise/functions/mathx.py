"""Special functions and log-space arithmetic as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lgamma(x: Column) -> Column:
    """Log of the gamma function for x > 0: eight steps of the recurrence, then Stirling's series."""
    z = x + 8.0
    steps = x
    for k in range(1, 8):
        steps = steps * (x + float(k))
    inv = F.lit(1.0) / z
    sq = inv * inv
    series = inv * (1 / 12 - sq * (1 / 360 - sq * (1 / 1260 - sq * (1 / 1680 - sq * (1 / 1188)))))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def lgamma_text(x: str) -> str:
    """``lgamma`` as SQL text, for plans with so many of them that building columns one by one is slow."""
    steps = " * ".join(f"({x} + {k}D)" for k in range(8))
    sq = f"(1D / (({x} + 8D) * ({x} + 8D)))"
    series = f"({1 / 12!r}D - {sq} * ({1 / 360!r}D - {sq} * ({1 / 1260!r}D - {sq} * ({1 / 1680!r}D - {sq} * {1 / 1188!r}D))))"
    return f"(({x} + 7.5D) * ln({x} + 8D) - ({x} + 8D) + {0.5 * math.log(2 * math.pi)!r}D + {series} / ({x} + 8D) - ln({steps}))"


#: Grid of the rounded log gamma function, and where it ends.
GRID, GRID_END = 100, 1000.0


def grid_lgamma(x: Column) -> Column:
    """Log gamma at the nearest hundredth up to 1000, exact beyond: for results that must agree with a table's. Below half a hundredth it is null."""
    near = (F.floor(x * GRID - 0.5) + 1) / GRID
    return F.when(x > GRID_END, lgamma(x)).when(near > 0, lgamma(near))


def grid_lbeta(values: list[Column]) -> Column:
    """Log of the multivariate beta function from ``grid_lgamma``."""
    return _sum([grid_lgamma(v) for v in values]) - grid_lgamma(_sum(values))


def digamma(x: Column) -> Column:
    z = x + 8.0
    back = F.lit(0.0)
    for k in range(8):
        back = back + F.lit(1.0) / (x + float(k))
    sq = F.lit(1.0) / (z * z)
    return F.log(z) - 0.5 / z - sq * (1 / 12 - sq * (1 / 120 - sq * (1 / 252 - sq / 240))) - back


def _sum(items: list[Column]) -> Column:
    out = items[0]
    for x in items[1:]:
        out = out + x
    return out


def mbeta_log(values: list[Column]) -> Column:
    """Log of the multivariate beta function; coordinates that are zero are left out."""
    terms = [F.when(v > 0, lgamma(v)).otherwise(0.0) for v in values]
    return _sum(terms) - lgamma(_sum(values))


def dirichlet_multinomial(counts: list[Column], alpha: list[float]) -> Column:
    """Log marginal probability of an ordered sample with these counts."""
    return mbeta_log([c + a for c, a in zip(counts, alpha)]) - mbeta_log([F.lit(a) for a in alpha])


def logadd(a: Column, b: Column) -> Column:
    high = F.greatest(a, b)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(high + F.log1p(F.exp(-F.abs(a - b))))


def logsub(a: Column, b: Column) -> Column:
    """log(exp(a) - exp(b)); null where b > a."""
    return F.when(b.isNull(), a).when(a > b, a + F.log1p(-F.exp(b - a)))


def entropy(probabilities: list[Column], log=F.log) -> Column:
    return -_sum([F.when(p > 0, p * log(p)).otherwise(0.0) for p in probabilities])


def kl_divergence(p: list[Column], q: list[Column]) -> Column:
    """In bits."""
    return _sum([F.when(a > 0, a * F.log2(a / b)).otherwise(0.0) for a, b in zip(p, q)])


def dirichlet_log_pdf(theta: list[Column], alpha: list[float]) -> Column:
    return _sum([(a - 1) * F.log(t) for t, a in zip(theta, alpha)]) - mbeta_log([F.lit(float(a)) for a in alpha])


def gamma_log_pdf(x: Column, shape: float, scale: float) -> Column:
    return (shape - 1) * F.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale)


def gamma_log_pdf_derivative(x: Column, shape: float, scale: float) -> Column:
    return (shape - 1) / x - 1 / scale


def gamma_pdf_derivative(x: Column, shape: float, scale: float) -> Column:
    return F.exp(gamma_log_pdf(x, shape, scale)) * gamma_log_pdf_derivative(x, shape, scale)


def multinomial_pdf(theta: list[Column], counts: list[Column]) -> Column:
    """Without the multinomial coefficient."""
    return F.exp(_sum([n * F.log(t) for n, t in zip(counts, theta)]))


def pitman_yor(size: Column, n: Column, k: Column, alpha: float, discount: float) -> Column:
    """Log predictive weight of a cluster with ``size`` members (0: a new one) among n items in k clusters."""
    fresh = F.log(alpha + discount * k) - F.log(n + alpha)
    return F.when(size == 0, fresh).otherwise(F.log(size - discount) - F.log(n + alpha))


def uniform_process(size: Column, k: Column, alpha: float) -> Column:
    return F.when(size == 0, math.log(alpha) - F.log(alpha + k)).otherwise(-F.log(alpha + k))


def poppe_process(size: Column, n: Column, k: Column) -> Column:
    """Log predictive weight of a cluster of ``size`` among n items in k clusters; certain where there is no cluster yet."""
    fresh = F.when(k == 1, -F.log(n + 1.0)).otherwise(F.log(k * (k - 1.0) / (n * (n + 1.0))))
    member = F.when(k == 1, F.log(n / (n + 1.0))).otherwise(F.log((size + 1.0) / (n + 1.0) * (n - k + 1.0) / n))
    return F.when((k == 0) & (size == 0), 0.0).when(size == 0, fresh).otherwise(member)


def process_joint(sizes: Column, alpha: float) -> Column:
    """Log joint prior of all clusters as an aggregate over their sizes."""
    size = sizes.cast("double")
    return F.count(size) * math.log(alpha) + math.lgamma(alpha) - lgamma(F.coalesce(F.sum(size), F.lit(0.0)) + alpha) + F.coalesce(F.sum(lgamma(size)), F.lit(0.0))


def kahan_sum(values: Column) -> Column:
    """Sum of an array in its order with a running correction of what rounding lost; nulls are left out."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(a: Column, x: Column) -> Column:
        y = x - a["c"]
        t = a["s"] + y
        return F.struct(t.alias("s"), ((t - a["s"]) - y).alias("c"))

    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), zero, step, lambda a: a["s"])


def anneal(t0: float, i: Column, n: int) -> Column:
    return t0 * F.pow(F.lit(1 / t0), i / float(n))


def decay_weight(i: Column) -> Column:
    return F.pow(F.lit(0.5), i)


def mutation_probability(d: Column) -> Column:
    """Probability that a letter is drawn anew along a branch of length d."""
    return -F.expm1(-d)


def dirichlet_moments(alpha: list[Column]) -> tuple[list[Column], list[Column], Callable[[int, int], Column], Column]:
    """Means, variances, the covariance of two different coordinates, and the mean entropy in nats."""
    total = _sum(alpha)
    mean = [a / total for a in alpha]
    entropy = digamma(total + 1.0) - _sum([m * digamma(a + 1.0) for m, a in zip(mean, alpha)])
    return mean, [m * (1 - m) / (total + 1.0) for m in mean], lambda i, j: -mean[i] * mean[j] / (total + 1.0), entropy
