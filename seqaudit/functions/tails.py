"""Exact tails of discrete distributions: terms grow from one another by ratios, as one aggregate a row.

The expressions are SQL text, as a tail has some thousand nodes and each Column call from Python costs a round trip.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _log_factorial(n: str) -> str:
    """ln(n!) by Stirling's series at n + 9 and the recurrence."""
    z = f"(cast({n} as double) + 1)"
    x = f"({z} + 8)"
    series = f"({x} - 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5)) - 1 / (1680 * pow({x}, 7))"
    return f"({series} - ln({' * '.join(f'({z} + {i})' for i in range(8))}))"


def _sum(first: str, count: str, spread: str, ratio) -> str:
    """exp(first) * (1 + r(0) + r(0) r(1) + ...) over `count` terms, where ratio(i) is what the term after the i-th has of it.

    Terms fall away from the mode at least as fast as those beside it, so what lies 60 and 12 standard deviations on is
    below 1e-16 of the first; the sum ends there. No term means 0.
    """
    steps = f"cast(least({count} - 1, ceil(60 + 12 * {spread})) as int)"
    term = f"(acc.t * {ratio('i')})"
    total = f"aggregate(case when {steps} >= 1 then sequence(0, {steps} - 1) else cast(array() as array<int>) end, named_struct('t', 1D, 's', 1D), (acc, i) -> named_struct('t', {term}, 's', acc.s + {term})).s"
    return f"(case when {count} >= 1 then exp({first}) * {total} else 0D end)"


def _last(low: str, high: str, holds) -> str:
    """The largest x of low..high for which holds(x), which is true up to some x; low - 1 if for none."""
    half = "((acc.a + acc.b + 1) div 2)"
    step = f"case when acc.a >= acc.b then acc when {holds(half)} then named_struct('a', {half}, 'b', acc.b) else named_struct('a', acc.a, 'b', {half} - 1) end"
    return f"aggregate(sequence(1, 64), named_struct('a', {low} - 1, 'b', {high}), (acc, j) -> {step}).a"


def _laid(df: DataFrame, **columns: str) -> DataFrame:
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def _settled(df: DataFrame, out: str, text: str) -> DataFrame:
    """df with out, through a generator: the optimizer does not copy such a long expression into filters and constraints."""
    return df.select(*[c for c in df.columns if c != out], F.explode(F.array(F.expr(text))).alias(out))


class Hypergeometric:
    """x of r draws among n hit one of k. What is used often is laid out as columns of `rows`, which has those of df."""

    def __init__(self, df: DataFrame, n: Column, r: Column, k: Column):
        rows = df.withColumns({c: v.cast("bigint") for c, v in (("_n", n), ("_r", r), ("_k", k))})
        rows = _laid(rows, _low="greatest(0L, _r + _k - _n)", _high="least(_r, _k)", _spread="coalesce(sqrt(_r * try_divide(_k, _n) * (1 - try_divide(_k, _n))), 0D)")
        fixed = " + ".join(map(_log_factorial, ("_k", "(_n - _k)", "_r", "(_n - _r)")))
        mode = "cast(floor(cast(_r + 1 as double) * (_k + 1) / (_n + 2)) as bigint)"
        self.rows = _laid(rows, _mode=f"least(greatest({mode}, _low), _high)", _fixed=f"{fixed} - {_log_factorial('_n')}")

    def _log(self, x: str) -> str:
        return "(_fixed" + "".join(f" - {_log_factorial(v)}" for v in (x, f"(_k - {x})", f"(_r - {x})", f"(_n - _k - _r + {x})")) + ")"

    def _upper(self, x: str) -> str:
        """Sum of the terms from x, which is past the mode, to the highest."""
        up = lambda i: f"cast(_k - {x} - {i} as double) * (_r - {x} - {i}) / (cast({x} + {i} + 1 as double) * (_n - _r - _k + {x} + {i} + 1))"
        return _sum(self._log(x), f"(_high - {x} + 1)", "_spread", up)

    def _lower(self, x: str) -> str:
        """Sum of the terms from x, which is before the mode, down to the lowest."""
        down = lambda i: f"cast({x} - {i} as double) * (_n - _r - _k + {x} - {i}) / (cast(_k - {x} + {i} + 1 as double) * (_r - {x} + {i} + 1))"
        return _sum(self._log(x), f"({x} - _low + 1)", "_spread", down)

    def at_least(self, x: Column, out: str) -> DataFrame:
        """rows with out: P(X >= x)."""
        own = _laid(self.rows.withColumn("_x", x.cast("bigint")), _x="greatest(_x, _low)", _y="greatest(_x, _low) - 1")
        p = f"case when _x > _high then 0D when _x > _mode then {self._upper('_x')} else 1 - {self._lower('_y')} end"
        return _settled(own, out, f"least(greatest({p}, 0D), 1D)")

    def no_likelier(self, x: Column, out: str) -> DataFrame:
        """rows with out: P of all values whose probability is that of x or less; within 1e-7 counts as equal."""
        own = _laid(self.rows.withColumn("_x", x.cast("bigint")), _most=f"{self._log('_x')} + 1e-7D")
        left = _last("_low", "(_mode - 1)", lambda v: f"{self._log(v)} <= _most")
        right = _last("(_mode + 1)", "_high", lambda v: f"{self._log(v)} > _most")
        own = _laid(own, _left=left, _right=f"{right} + 1")
        return _settled(own, out, f"least(case when {self._log('_mode')} <= _most then 1D else {self._lower('_left')} + {self._upper('_right')} end, 1D)")


def binomial_at_least(df: DataFrame, n: Column, k: Column, p: Column, out: str) -> DataFrame:
    """df with out: P(K >= k) of n draws that each hit with probability p, which lies strictly within 0 and 1."""
    own = df.withColumns({"_n": n.cast("bigint"), "_k": k.cast("bigint"), "_p": p.cast("double")})
    own = _laid(own, _spread="sqrt(_n * _p * (1 - _p))", _mode="cast(floor((_n + 1) * _p) as bigint)", _odds="_p / (1 - _p)", _j="_k - 1")
    log = lambda x: f"({_log_factorial('_n')} - {_log_factorial(x)} - {_log_factorial(f'(_n - {x})')} + {x} * ln(_p) + (_n - {x}) * ln(1 - _p))"
    up = _sum(log("_k"), "(_n - _k + 1)", "_spread", lambda i: f"(_n - _k - {i}) / (_k + {i} + 1) * _odds")
    down = _sum(log("_j"), "_k", "_spread", lambda i: f"(_j - {i}) / (_n - _k + 2 + {i}) / _odds")
    return _settled(own, out, f"least(greatest(case when _k <= 0 then 1D when _k > _n then 0D when _k > _mode then {up} else 1 - {down} end, 0D), 1D)").select(*df.columns, out)
