"""Numeric column helpers that keep null, NaN and infinity apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")

_HEX_DIGITS = 13
_HEX_RANGE = float(16**_HEX_DIGITS)


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; null, NaN and infinities are false."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(INFINITY))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of raising when the denominator is zero."""
    return F.when(denominator != 0, numerator / denominator)


def log_if_positive(value: Column, base: int | None = None) -> Column:
    """Natural (or given base) logarithm; null where the value is not positive."""
    log = F.log(value) if base is None else {2: F.log2, 10: F.log10}[base](value)
    return F.when(value > 0, log)


def hash_order(seed: int, *parts: str) -> Column:
    """A text that orders rows pseudo-randomly but reproducibly."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def uniform(seed: int, *parts: str) -> Column:
    """A reproducible draw from [0, 1) with 52 random bits, a function of the row."""
    digits = F.substring(hash_order(seed, *parts), 1, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(_HEX_RANGE)


# The rational approximations of the error function by W. J. Cody
# (Math. Comp. 23, 1969), highest power first.
_ERF_NUM = [1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3]
_ERF_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3]
_MID_NUM = [
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
]
_MID_DEN = [
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
]
_FAR_NUM = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
_FAR_DEN = [1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3]
_INV_SQRT_PI = 5.6418958354775628695e-1


def _number(value: float) -> str:
    return f"{value!r}D".upper()


def _horner(x: str, coefficients: list[float]) -> str:
    text = _number(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {_number(c)})"
    return text


def _rational(x: str, numerator: list[float], denominator: list[float]) -> str:
    return f"{_horner(x, numerator)} / {_horner(x, denominator)}"


def _erfc_text(name: str) -> str:
    """SQL text of erfc of a column; kept to plain columns because it repeats them."""
    x = f"`{name}`"
    square, y = f"({x} * {x})", f"abs({x})"
    inverse = f"(1 / (CASE WHEN {y} > 4 THEN {square} ELSE 16D END))"
    near = f"1 - {x} * {_rational(square, _ERF_NUM, _ERF_DEN)}"
    middle = f"exp(-{square}) * {_rational(y, _MID_NUM, _MID_DEN)}"
    far = f"exp(-{square}) / greatest({y}, 1D) * ({_number(_INV_SQRT_PI)} - {inverse} * {_rational(inverse, _FAR_NUM, _FAR_DEN)})"
    tail = f"(CASE WHEN {y} <= 4 THEN {middle} ELSE {far} END)"
    return f"(CASE WHEN {y} <= 0.46875D THEN {near} WHEN {x} < 0 THEN 2 - {tail} ELSE {tail} END)"


def erfc(name: str) -> Column:
    """Complementary error function of a column, without Python workers."""
    return F.expr(_erfc_text(name))


_SQRT_2 = 2.0**0.5

# J. F. Hart's rational approximation of the normal distribution
# (Computer Approximations, 1968, no. 5666), highest power first.
_HART_NUM = [
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376,
]
_HART_DEN = [
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948,
    440.413735824752,
]
_HART_LIMIT = 7.07106781186547


def normal_cdf(name: str) -> Column:
    """P(Z <= x) of a column, right to 1e-12 in absolute terms.

    Meant for many rows: unlike :func:`erfc` it has one short formula, so generated
    code stays small enough to be compiled.
    """
    x = f"`{name}`"
    y = f"least(abs({x}), {_number(_HART_LIMIT)})"
    tail = f"exp(-{y} * {y} / 2) * {_rational(y, _HART_NUM, _HART_DEN)}"
    return F.expr(f"0.5D + sign({x}) * (0.5D - {tail})")


def with_normal_two_sided(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add ``target = P(|Z| >= source)``; 1 where the source is not positive."""
    scaled = df.withColumn("_x", F.greatest(F.col(source), F.lit(0.0)) / _SQRT_2)
    return scaled.withColumn(target, F.least(F.lit(1.0), erfc("_x"))).drop("_x")
