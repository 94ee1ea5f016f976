"""Scalar arithmetic of the array engine as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("add", "sub", "mul", "div")


def divide(n: Column, d: Column) -> Column:
    """IEEE division of doubles: x/0 is an infinity and 0/0 is NaN, where ANSI division raises."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(d != 0, n / F.when(d != 0, d)).when(F.isnan(n) | (n == 0), nan).when(n > 0, inf).otherwise(-inf)


def truncating_divide(n: Column, d: Column) -> Column:
    """Integer division that truncates toward zero; null where d is 0."""
    return F.call_function("div", n.cast("long"), F.nullif(d.cast("long"), F.lit(0)))


def apply(op: str, a: Column, b: Column, integer: bool = False) -> Column:
    if op == "add":
        return a + b
    if op == "sub":
        return a - b
    if op == "mul":
        return a * b
    if op == "div":
        return truncating_divide(a, b) if integer else divide(a, b)
    raise ValueError(f"unknown operator {op!r}; one of {OPS}")


def complex_mul(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def complex_div(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """By the conjugate; a divisor of 0 gives NaN in both parts."""
    size = b[0] * b[0] + b[1] * b[1]
    re, im = complex_mul(a, conj(b))
    return divide(re, size), divide(im, size)


def complex_apply(op: str, a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """True complex arithmetic on (re, im)."""
    if op in ("add", "sub"):
        return apply(op, a[0], b[0]), apply(op, a[1], b[1])
    if op == "mul":
        return complex_mul(a, b)
    if op == "div":
        return complex_div(a, b)
    raise ValueError(f"unknown operator {op!r}; one of {OPS}")


def conj(a: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0], -a[1]


def on_grid(e: Column, digits: int = 9) -> Column:
    """``e`` on a grid of so many decimal digits, so that results of different summation orders compare equal; NaN and huge values stay."""
    scale = float(10**digits)
    return F.when(F.isnan(e) | (F.abs(e) > 1e9), e).otherwise(F.floor(e * scale + 0.5) / scale)
