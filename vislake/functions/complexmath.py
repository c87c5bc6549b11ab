"""Complex numbers as pairs of Columns, and angles. NaN and NULL pass through."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def wrap(x: Column) -> Column:
    """To [-pi, pi], ties half-even (F1)."""
    return x - F.lit(TWO_PI) * F.rint(x / TWO_PI)


@dataclass(frozen=True)
class Complex:
    """re + i*im (F2)."""

    re: Column
    im: Column

    @staticmethod
    def polar(amplitude: Column, phase: Column) -> Complex:
        return Complex(amplitude * F.cos(phase), amplitude * F.sin(phase))

    def __mul__(self, other: Complex | Column | float) -> Complex:
        if isinstance(other, Complex):
            return Complex(self.re * other.re - self.im * other.im, self.re * other.im + self.im * other.re)
        return Complex(self.re * other, self.im * other)

    def __add__(self, other: Complex) -> Complex:
        return Complex(self.re + other.re, self.im + other.im)

    def __sub__(self, other: Complex) -> Complex:
        return Complex(self.re - other.re, self.im - other.im)

    def __truediv__(self, other: Complex) -> Complex:
        """NULL where the divisor is zero."""
        d = F.when(other.abs2() != 0, other.abs2())
        z = self * other.conj()
        return Complex(z.re / d, z.im / d)

    def conj(self) -> Complex:
        return Complex(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.abs2())

    def angle(self) -> Column:
        return F.atan2(self.im, self.re)

    def struct(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"))


def circular_mean(x: Column) -> Column:
    """Angle of the sum of unit vectors (an aggregate); NaN if the sum is exactly zero."""
    s, c = F.sum(F.sin(x)), F.sum(F.cos(x))
    return F.when((s == 0) & (c == 0), F.lit(float("nan"))).otherwise(F.atan2(s, c))


def present(w: Column) -> Column:
    """Positive weight; NaN and NULL weights are not present."""
    return F.coalesce((w > 0) & ~F.isnan(w), F.lit(False))
