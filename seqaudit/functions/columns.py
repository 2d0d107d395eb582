"""Column expressions that Spark has no function for."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """Evaluate value once a row and hand it to use(): higher-order functions do not share subexpressions."""
    return F.transform(F.array(value), use)[0]


def half_up(x: Column, digits: int = 6) -> Column:
    """x rounded as DuckDB does: halves of x * 10 ** digits, as a double, go away from 0. Spark's round takes halves of the shortest decimal, so 0.0644375 differs."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation of complete pairs, an aggregate; null where a side is constant (F.corr raises there under ANSI rules)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def upper_tail(z: Column | str) -> Column:
    """P(Z >= z) of a standard normal: a series of positive terms for the middle, a continued fraction for the tail."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z) / math.sqrt(2)
    term = lambda acc, n: F.struct((acc["t"] * 2 * x * x / (2 * n + 1)).alias("t"), (acc["s"] + acc["t"]).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(x.alias("t"), F.lit(0.0).alias("s")), term)["s"]
    middle = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda acc, n: x + n / 2 / acc)
    one = F.when(x < 3, middle).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / F.greatest(fraction, F.lit(1e-300))) / 2
    return F.when(z >= 0, one).otherwise(1 - one)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; without keys every pair of rows (for a right side of one row). Columns of left, then the rest of right."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)
    other = right.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    got = left.join(other, functools.reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]), how)
    return got.drop(*[f"_key_{k}" for k in keys])
