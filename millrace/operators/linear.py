"""Linear learners by full-batch steps: the state lives on the driver, each epoch is one aggregate of one row.

Squared loss without a sign needs the data once: all epochs follow from sums of products. Any other loss takes one scan an epoch, for all models of a
grid together, and models that differ in the number of epochs only share one run with snapshots.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import expand, expand_weights, linear_score, sign_class
from ..functions.losses import LOSSES, MSE, Loss
from .split import seeded_weights

#: From feature names and a degree to the terms of a hypothesis.
Expander = Callable[[list[str], int], list[Column]]


@dataclass(frozen=True)
class Model:
    """Weights (of the terms that the expander makes of the features), bias, and whether the prediction is the score or its sign."""

    weights: tuple[float, ...]
    bias: float
    signed: bool = False
    degree: int = 1
    expander: Expander | None = None

    def terms(self, features: list[str | Column]) -> list[Column]:
        if self.degree == 1 and self.expander is None:
            return [F.col(x) if isinstance(x, str) else x for x in features]
        return (self.expander or expand)(features, self.degree)

    def predict(self, features: list[str | Column]) -> Column:
        return (sign_class if self.signed else linear_score)(self.terms(features), list(self.weights), self.bias)


def stepped(model: Model, loss: Loss, rate: float, sums: list[float], n: int) -> Model:
    """The update from the sums of gradient x feature and the sum of gradients."""
    scale = rate * (2.0 / n if loss.mean_gradient else 1.0)
    w = tuple(a + loss.weight_sign * scale * g for a, g in zip(model.weights, sums[:-1], strict=True))
    return replace(model, weights=w, bias=model.bias + loss.bias_sign * scale * sums[-1])


def gram(df: DataFrame, features: list[str], label: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, and the sums of z z' and z y for z = (features, 1), in one scan."""
    z = [*[F.col(x).cast("double") for x in features], F.lit(1.0)]
    y, k = F.col(label).cast("double"), len(z)
    r = df.agg(F.count("*"), *[F.sum(z[i] * z[j]) for i in range(k) for j in range(i, k)], *[F.sum(a * y) for a in z]).first()
    zz, at = np.zeros((k, k)), 1
    for i in range(k):
        for j in range(i, k):
            zz[i, j] = zz[j, i] = r[at] or 0.0
            at += 1
    return r[0], zz, np.array([x or 0.0 for x in r[at:]])


def fit_gram(df: DataFrame, features: list[str], label: str, start: Model, rate: float, epochs: int) -> list[Model]:
    """Squared loss: models after each epoch from one scan."""
    n, zz, zy = gram(df, features, label)
    out, model = [], start
    for _ in range(epochs):
        sums = zz @ np.array([*model.weights, model.bias]) - zy
        model = stepped(model, MSE, rate, sums.tolist(), n)
        out.append(model)
    return out


def least_squares(df: DataFrame, features: list[str], label: str) -> Model:
    """Closed form; the least solution where features depend on each other."""
    _, zz, zy = gram(df, features, label)
    w = np.linalg.lstsq(zz, zy, rcond=None)[0]
    return Model(tuple(w[:-1].tolist()), float(w[-1]))


def epoch(df: DataFrame, features: list[str], label: str, models: list[tuple[Model, Loss, float]]) -> list[Model]:
    """One step of several models in one scan."""
    if not models:
        return []
    y, sums = F.col(label).cast("double"), []
    for m, loss, _ in models:
        g = loss.gradient(y, m.predict(features))
        sums += [F.sum(x * g) for x in m.terms(features)] + [F.sum(g)]
    r = df.agg(F.count("*"), *sums).first()
    out, at = [], 1
    for m, loss, rate in models:
        k = len(m.weights) + 1
        out.append(stepped(m, loss, rate, [x or 0.0 for x in r[at : at + k]], max(r[0], 1)))
        at += k
    return out


def fit(df: DataFrame, features: list[str], label: str, start: Model, loss: Loss, rate: float, epochs: int) -> list[Model]:
    """Models after each epoch."""
    if loss is MSE and not start.signed:
        return fit_gram(df, features, label, start, rate, epochs)
    df = df.select(*features, label).persist()
    try:
        out, model = [], start
        for _ in range(epochs):
            (model,) = epoch(df, features, label, [(model, loss, rate)])
            out.append(model)
        return out
    finally:
        df.unpersist()


def grid_start(weights: list[float], bias: float, rate: float, signed: bool = True, degree: int = 1, expander: Expander | None = None) -> Model:
    """Where a grid run starts: setting the (expanded) start weights goes through the subtracting update, so a share `rate` is lost."""
    return Model(tuple((1 - rate) * w for w in weights), (1 - rate) * bias, signed, degree, expander)


def grid_fit(df: DataFrame, features: list[str], label: str, runs: list[dict], weights: list[float] | None = None, bias: float = 0.0, expander: Expander | None = None) -> dict[int, Model]:
    """Models by run number for runs of (run, rate, loss, epochs) and, where given, degree, seed (of uniform start weights) and bias.

    One trajectory per combination without the epochs, all of them in one scan an epoch. Start weights are expanded like the features.
    """
    df = df.select(*features, label).persist()
    key = lambda r: (r["rate"], r["loss"], r.get("degree", 1), r.get("seed"), r.get("bias", bias))

    def start(rate: float, loss: str, degree: int, seed: int | None, bias: float) -> Model:
        first = weights if seed is None else seeded_weights(len(features), seed)
        return grid_start(expand_weights(first, degree), bias, rate, True, degree, expander)

    keys = sorted({key(r) for r in runs}, key=str)
    state = {k: start(*k) for k in keys}
    out: dict[int, Model] = {r["run"]: state[key(r)] for r in runs if r["epochs"] == 0}
    try:
        for e in range(1, max(r["epochs"] for r in runs) + 1):
            wanted = {key(r) for r in runs if r["epochs"] >= e}
            live = [k for k in keys if k in wanted]
            for i in range(0, len(live), 64):
                part = live[i : i + 64]
                state |= dict(zip(part, epoch(df, features, label, [(state[k], LOSSES[k[1]], k[0]) for k in part]), strict=True))
            out |= {r["run"]: state[key(r)] for r in runs if r["epochs"] == e}
        return out
    finally:
        df.unpersist()


@dataclass(frozen=True)
class Timing:
    """Elapsed seconds of a grid, and seconds for each of its models."""

    elapsed: float
    per_model: float


def timed_grid_fit(df: DataFrame, features: list[str], label: str, runs: list[dict], **options) -> tuple[dict[int, Model], Timing]:
    began = time.perf_counter()
    models = grid_fit(df, features, label, runs, **options)
    elapsed = time.perf_counter() - began
    return models, Timing(elapsed, elapsed / max(1, len(models)))
