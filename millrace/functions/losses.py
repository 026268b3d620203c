"""Losses and gradients as column expressions.

`mean_gradient` says whether the summed gradient is scaled by 2/n afterwards (sum first, scale once). The hinge direction uses the mask a.p <= 0 and its
bias is not negated: both as the engine's users know them.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared(a: Column, p: Column) -> Column:
    return (a - p) * (a - p)


def absolute(a: Column, p: Column) -> Column:
    return F.abs(a - p)


def perceptron(a: Column, p: Column) -> Column:
    return F.greatest(F.lit(0.0), -a * p)


def hinge(a: Column, p: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - a * p)


def wrong_side(a: Column, p: Column) -> Column:
    """The target where target and prediction do not agree in sign, else 0."""
    return F.when(a * p <= 0, a).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Loss:
    name: str
    value: Callable[[Column, Column], Column]
    gradient: Callable[[Column, Column], Column]
    mean_gradient: bool = False
    #: Signs with which the sums enter the update of weights and bias.
    weight_sign: int = -1
    bias_sign: int = -1


MSE = Loss("MSE", squared, lambda a, p: p - a, mean_gradient=True)
MAE = Loss("MAE", absolute, lambda a, p: F.signum(p - a))
PERCEPTRON = Loss("perceptron", perceptron, wrong_side, weight_sign=1, bias_sign=1)
HINGE = Loss("hinge", hinge, wrong_side, weight_sign=1, bias_sign=-1)
LOSSES = {x.name: x for x in (MSE, MAE, PERCEPTRON, HINGE)}


def rmse(a: Column, p: Column) -> Column:
    return F.sqrt(F.avg(squared(a, p)))


def r_squared(a: Column, p: Column) -> Column:
    return 1 - F.sum(squared(a, p)) / (F.var_pop(a) * F.count(a))
