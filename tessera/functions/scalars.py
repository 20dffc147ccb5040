"""The scalar functions of the dialect as Column functions.

Only those that differ from ``pyspark.sql.functions`` are written here; the rest
are the same functions under the same name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import NotSupported


def divide(a: Column, b: Column) -> Column:
    """Floating point division; zero divisors give infinities or NaN."""
    a, b = a.cast("double"), b.cast("double")
    odd = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, odd))


def integer_divide(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def trunc(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def sign(x: Column) -> Column:
    return F.signum(x).cast("tinyint")


def log(x: Column, base: Column | None = None) -> Column:
    """Base ten, or log(base, x) in the order (x, base)."""
    return F.log10(x) if base is None else F.ln(x) / F.ln(base)


def substring(s: Column, start: int, length: int | None = None) -> Column:
    """From 1 on; a start of 0 spends one of ``length`` before the string."""
    if length is None:
        return F.substr(s, F.lit(start))
    return F.substring(s, 1, max(0, length - 1)) if start == 0 else F.substring(s, start, length)


def date_part(part: str):
    def f(x: Column) -> Column:
        return getattr(F, part)(x).cast("bigint")

    return f


def round_half_even(x: Column, kind: str = "bigint") -> Column:
    """A cast of floating point numbers to integers that rounds."""
    return F.rint(x).cast(kind)


FUNCTIONS = {
    "+": lambda a, b: a + b, "-": lambda a, b=None: -a if b is None else a - b, "*": lambda a, b: a * b, "/": divide, "//": integer_divide, "%": lambda a, b: a % b,
    "abs": F.abs, "floor": floor, "ceil": ceil, "ceiling": ceil, "round": F.round, "trunc": trunc, "sign": sign,
    "log": log, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "ln": F.ln, "log2": F.log2, "log10": F.log10,
    "pow": F.pow, "power": F.pow, "**": F.pow, "^": F.pow,
    "prefix": F.startswith, "suffix": F.endswith, "contains": F.contains, "~~": F.like, "!~~": lambda a, b: ~F.like(a, b),
    "substring": substring, "substr": substring, "year": date_part("year"), "month": date_part("month"), "day": date_part("day"), "error": F.raise_error,
}


def resolve(name: str):
    """The function of that name; others are not part of the dialect."""
    if name not in FUNCTIONS:
        raise NotSupported(f"function {name} is not registered")
    return FUNCTIONS[name]
