"""Forward differentiation of second order: numbers that carry their gradient and Hessian.

A formula written in plain numpy (`np.exp`, `np.arcsinh`, `+`, ...) takes jets in place of arrays and
returns exact first and second derivatives by all variables, the mixed ones included."""

from __future__ import annotations

import numpy as np
from numpy.lib.mixins import NDArrayOperatorsMixin

# ufunc: value, first and second derivative as functions of (argument, value).
UNARY = {
    np.negative: lambda x, v: (-np.ones_like(x), np.zeros_like(x)),
    np.exp: lambda x, v: (v, v),
    np.expm1: lambda x, v: (v + 1, v + 1),
    np.log: lambda x, v: (1 / x, -1 / x**2),
    np.log1p: lambda x, v: (1 / (1 + x), -1 / (1 + x) ** 2),
    np.sqrt: lambda x, v: (0.5 / v, -0.25 / (v * x)),
    np.square: lambda x, v: (2 * x, np.full_like(x, 2.0)),
    np.absolute: lambda x, v: (np.sign(x), np.zeros_like(x)),
    np.sin: lambda x, v: (np.cos(x), -v),
    np.cos: lambda x, v: (-np.sin(x), -v),
    np.sinh: lambda x, v: (np.cosh(x), v),
    np.cosh: lambda x, v: (np.sinh(x), v),
    np.tanh: lambda x, v: (1 - v * v, -2 * v * (1 - v * v)),
    np.arctan: lambda x, v: (1 / (1 + x * x), -2 * x / (1 + x * x) ** 2),
    np.arcsinh: lambda x, v: (1 / np.sqrt(1 + x * x), -x / (1 + x * x) ** 1.5),
}


class Jet(NDArrayOperatorsMixin):
    """Values (n), gradients (m, n) and Hessians (m, m, n) of n numbers by m variables."""

    def __init__(self, v, g, h):
        self.v, self.g, self.h = v, g, h

    def along(self, ufunc, first, second):
        """ufunc of this jet, given its derivatives at the value."""
        outer = self.g[:, None] * self.g[None, :]
        return Jet(ufunc(self.v), first * self.g, first * self.h + second * outer)

    def _chosen(self, other, mine):
        """This jet where `mine`, else `other`."""
        o = other if isinstance(other, Jet) else Jet(other, 0.0, 0.0)
        return Jet(np.where(mine, self.v, o.v), np.where(mine, self.g, o.g), np.where(mine, self.h, o.h))

    def _times(self, other):
        if not isinstance(other, Jet):
            return Jet(self.v * other, self.g * other, self.h * other)
        cross = self.g[:, None] * other.g[None, :]
        h = self.v * other.h + other.v * self.h + cross + cross.swapaxes(0, 1)
        return Jet(self.v * other.v, self.v * other.g + other.v * self.g, h)

    def _plus(self, other):
        if not isinstance(other, Jet):
            return Jet(self.v + other, self.g, self.h)
        return Jet(self.v + other.v, self.g + other.g, self.h + other.h)

    def _power(self, k):
        first, second = k * self.v ** (k - 1.0), k * (k - 1.0) * self.v ** (k - 2.0)
        return self.along(lambda v: v**k, first, second)

    def __array_ufunc__(self, ufunc, method, *args, **kwargs):
        if method != "__call__" or kwargs:
            return NotImplemented
        if ufunc in UNARY:
            return self.along(ufunc, *UNARY[ufunc](self.v, ufunc(self.v)))
        if ufunc is np.power and not isinstance(args[1], Jet):
            return args[0]._power(float(args[1]))
        if len(args) != 2:
            return NotImplemented
        a, b = args
        if ufunc is np.subtract:
            return (a._plus(-b) if isinstance(a, Jet) else (-b)._plus(a))
        if ufunc is np.true_divide:
            return a * (b._power(-1.0) if isinstance(b, Jet) else 1.0 / b)
        mine, other = (a, b) if isinstance(a, Jet) else (b, a)
        if ufunc is np.add:
            return mine._plus(other)
        if ufunc is np.multiply:
            return mine._times(other)
        at = other.v if isinstance(other, Jet) else other
        if ufunc is np.maximum:
            return mine._chosen(other, mine.v >= at)
        if ufunc is np.minimum:
            return mine._chosen(other, mine.v <= at)
        return NotImplemented


def variables(columns) -> list[Jet]:
    """One jet per column, each a variable of its own."""
    m = len(columns)
    out = []
    for k, c in enumerate(columns):
        c = np.asarray(c)
        g = np.zeros((m, len(c)), dtype=c.dtype)
        g[k] = 1.0
        out.append(Jet(c, g, np.zeros((m, m, len(c)), dtype=c.dtype)))
    return out
