"""Column expressions: measurement noise, geometric means, tolerant comparison, seeded orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


@dataclass(frozen=True)
class Noise:
    """Statistical noise a/t + b and the clock's tick."""

    absolute: float = 0.05
    relative: float = 0.002
    tick: float = 0.1


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def usable(t: Column) -> Column:
    """A cost that can be compared: finite and above zero."""
    return finite(t) & (t > 0)


def sigma(t: Column, noise: Noise) -> Column:
    return F.when(t > 0, noise.absolute / t + noise.relative).otherwise(noise.relative)


def tick_share(t: Column, noise: Noise) -> Column:
    return F.when(t > 0, noise.tick / t).otherwise(INF)


def floor(t: Column, noise: Noise) -> Column:
    """The smallest relative difference that tells two costs apart; 1 where the cost is unusable."""
    return F.when(usable(t), F.greatest(noise.absolute / t + noise.relative, noise.tick / t)).otherwise(1.0)


def tolerance(best: Column, noise: Noise) -> Column:
    return 2 * floor(best, noise)


def resolvable(a: Column, b: Column, noise: Noise, k: float = 2.0) -> Column:
    spread = k * F.sqrt(F.pow(floor(a, noise) * a, F.lit(2)) + F.pow(floor(b, noise) * b, F.lit(2)))
    return F.abs(a - b) > spread


def best_of(t: Column) -> Column:
    """Aggregate: the least usable cost."""
    return F.min(F.when(usable(t), t))


def geomean(x: Column) -> Column:
    """Aggregate: geometric mean of what is finite and above zero; null where nothing is."""
    return F.exp(F.avg(F.when(usable(x), F.log(x))))


def median(x: Column) -> Column:
    """Aggregate: exact median of finite values, linear between the middle two."""
    return F.percentile(F.when(finite(x), x), F.lit(0.5))


def approx_equal(a: Column, b: Column, tol: float = 1e-9) -> Column:
    """Infinities of one sign are equal, NaN equals nothing, and null gives false."""
    bad = F.isnan(a) | F.isnan(b)
    near = F.when((F.abs(a) == F.lit(INF)) | (F.abs(b) == F.lit(INF)), a == b).otherwise(F.abs(a - b) <= tol * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))
    return F.coalesce(F.when(bad, False).otherwise(near), F.lit(False))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the MD5 of the parts: a seeded order that any engine reproduces."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def wilson_upper(k: Column, n: Column, z: float = 1.96) -> Column:
    """95 % upper bound of a proportion; null for no trials."""
    p = k / n
    return F.when(n > 0, (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial p of wins against losses, summed in log space; 1 without any."""
    n, k = wins + losses, F.least(wins, losses)
    logs = lambda upto: F.aggregate(F.when(upto >= 1, F.sequence(F.lit(1).cast("long"), upto)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    term = lambda i: F.exp(logs(n) - logs(i) - logs(n - i) - n * F.log(F.lit(2.0)))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.lit(0.0), lambda a, i: a + term(i))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def band(x: Column, edges: list[Column]) -> Column:
    """Number of edges below x: ties fall into the lower band."""
    return sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0))
