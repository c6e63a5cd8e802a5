"""Mixtures of Gaussians: by plain expectation and maximisation, and Dirichlet-process ones by variational inference, with
stick breaking cut at a number of components.

A round is one aggregation over the rows: responsibilities are column expressions, and what comes to the driver are a
component's weight, its sums and its sums of products. Rounds end when the bound on the evidence hardly grows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to variances, as fixed small numbers of the method.
RIDGE, TINY = 1e-6, 10 * 2.0**-52


def digamma(x: float) -> float:
    """The logarithmic derivative of the gamma function, by its series beyond 6."""
    out = 0.0
    for i in range(6):
        out -= 1 / (x + i)
    y = x + 6
    return out + math.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)


@dataclass
class Mixture:
    """Fitted components, in the features' own units."""

    features: list[str]
    means: np.ndarray
    #: lower triangular factors L of the precisions, which are L L'
    factors: np.ndarray
    #: logarithms of each component's weight and normaliser
    constants: np.ndarray
    #: expected numbers of rows
    counts: np.ndarray
    bounds: list[float] = field(default_factory=list)
    converged: bool = False

    def scores(self) -> list[Column]:
        """Logarithms of weight times density, up to what all components share."""
        out = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            centred = [F.col(f) - float(m) for f, m in zip(self.features, mean, strict=True)]
            square = F.lit(0.0)
            for j in range(len(centred)):
                part = F.lit(0.0)
                for i in range(j, len(centred)):
                    part = part + centred[i] * float(factor[i, j])
                square = square + part * part
            out.append(F.lit(float(constant)) - square * 0.5)
        return out

    def with_responsibilities(self, df: DataFrame, out: str = "r") -> DataFrame:
        """Add an array of each component's share in a row, and the logarithm of their sum (out_log)."""
        k = len(self.counts)
        df = df.withColumn("__s", F.array(*self.scores()))
        most = F.array_max("__s")
        df = df.withColumn("__e", F.transform("__s", lambda s: F.exp(s - most)))
        total = F.aggregate("__e", F.lit(0.0), lambda a, e: a + e)
        df = df.withColumns({out: F.transform("__e", lambda e: e / total), f"{out}_log": most + F.log(total)})
        return df.drop("__s", "__e") if k else df

    def predict(self, df: DataFrame, out: str = "component") -> DataFrame:
        """Add the likeliest component, the first of equals."""
        scores = self.scores()
        best, at = scores[0], F.lit(0)
        for k, s in enumerate(scores[1:], 1):
            at, best = F.when(s > best, F.lit(k)).otherwise(at), F.greatest(best, s)
        return df.withColumn(out, at)

    def pruned(self, least: float = 1.0) -> Mixture:
        """Without the components that are expected to hold fewer rows than that."""
        stay = np.flatnonzero(self.counts >= least)
        return Mixture(self.features, self.means[stay], self.factors[stay], self.constants[stay], self.counts[stay], self.bounds, self.converged)

    def largest(self, feature: str) -> int:
        """The component with the largest mean of a feature."""
        return int(np.argmax(self.means[:, self.features.index(feature)]))


@dataclass
class Prior:
    mean: np.ndarray
    covariance: np.ndarray
    concentration: float
    precision: float = 1.0

    @property
    def freedom(self) -> float:
        return float(len(self.mean))


def update(prior: Prior, n: np.ndarray, sums: np.ndarray, products: np.ndarray, entropy: float, features: list[str]) -> tuple[Mixture, float]:
    """Components and bound from weights (K), sums (K, d) and sums of products (K, d, d) of centred features."""
    d, k = sums.shape[1], len(n)
    n = n + TINY
    means = sums / n[:, None]
    spread = products / n[:, None, None] - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d)
    beta, freedom = prior.precision + n, prior.freedom + n
    shrink = n * prior.precision / beta
    covariance = (prior.covariance + n[:, None, None] * spread + shrink[:, None, None] * means[:, :, None] * means[:, None, :]) / freedom[:, None, None]
    centres = n[:, None] * means / beta[:, None]
    factors = np.stack([np.linalg.cholesky(np.linalg.inv(c)) for c in covariance])
    log_det = np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1)
    a, b = 1 + n, prior.concentration + np.append(np.cumsum(n[::-1])[::-1][1:], 0.0)
    broken = np.array([digamma(y) - digamma(x + y) for x, y in zip(a, b, strict=True)])
    weights = np.array([digamma(x) - digamma(x + y) for x, y in zip(a, b, strict=True)]) + np.append(0.0, np.cumsum(broken)[:-1])
    log_lambda = d * math.log(2) + np.array([sum(digamma(0.5 * (v - i)) for i in range(d)) for v in freedom])
    constants = weights - 0.5 * d * math.log(2 * math.pi) + log_det - 0.5 * d * np.log(freedom) + 0.5 * (log_lambda - d / beta)
    wishart = -(freedom * (log_det - 0.5 * d * np.log(freedom)) + freedom * d * 0.5 * math.log(2) + np.array([sum(math.lgamma(0.5 * (v - i)) for i in range(d)) for v in freedom]))
    betas = sum(math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y) for x, y in zip(a, b, strict=True))
    bound = entropy - wishart.sum() + betas - 0.5 * d * np.log(beta).sum()
    return Mixture(features, centres + prior.mean, factors, constants, n - TINY if k else n), float(bound)


def fit(df: DataFrame, features: list[str], components: int, along: str, rounds: int = 100, tolerance: float = 1e-3) -> Mixture:
    """Fit to rows without nulls. The beginning is fixed: components take equal parts of the range of one standard
    deviation around the mean of the feature `along`, so equal tables give equal results."""
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    n, *m = df.agg(F.count("*"), *[F.avg(f) for f in features]).first()
    if not n or n <= d:
        raise ValueError("a mixture needs more rows than features")
    mean = np.array(m)
    x = [F.col(f) - float(c) for f, c in zip(features, mean, strict=True)]
    second = df.agg(*[F.sum(x[i] * x[j]) for i, j in pairs]).first()

    def square(values: list[float]) -> np.ndarray:
        out = np.zeros((d, d))
        for (i, j), v in zip(pairs, values, strict=True):
            out[i, j] = out[j, i] = v
        return out

    prior = Prior(mean, square(list(second)) / (n - 1), 1 / components)
    axis = features.index(along)
    sigma = math.sqrt(prior.covariance[axis, axis] * (n - 1) / n)
    part = sum((x[axis] >= sigma * (2 * i / components - 1)).cast("int") for i in range(1, components)) if components > 1 else F.lit(0)
    shares = F.transform(F.sequence(F.lit(0), F.lit(components - 1)), lambda k: (k == part).cast("double"))
    rows, model, bounds = df.withColumns({"r": shares, "r_log": F.lit(0.0)}), None, []
    for _ in range(rounds):
        r = [F.get("r", F.lit(k)) for k in range(components)]
        entropy = F.sum(F.aggregate("r", F.lit(0.0), lambda a, e: a - F.when(e > 0, e * F.log(e)).otherwise(0.0)))
        aggs = [entropy, *[F.sum(c) for c in r], *[F.sum(c * v) for c in r for v in x], *[F.sum(c * x[i] * x[j]) for c in r for i, j in pairs]]
        got = list(rows.agg(*aggs).first())
        count, got = got[0], got[1:]
        sums = np.array(got[components : components * (1 + d)]).reshape(components, d)
        products = np.stack([square(got[components * (1 + d) + k * len(pairs) :][: len(pairs)]) for k in range(components)])
        model, bound = update(prior, np.array(got[:components]), sums, products, count, features)
        bounds.append(bound)
        model.bounds = bounds
        if len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) < tolerance:
            model.converged = True
            break
        rows = model.with_responsibilities(df)
    return model


def counted(df: DataFrame, features: list[str], weight: str = "weight") -> DataFrame:
    """Rows that agree in all features as one row with their number."""
    return df.groupBy(*features).agg(F.count("*").alias(weight))


def gaussians(df: DataFrame, features: list[str], components: int, weight: str = "weight", short: int = 20, rounds: int = 300, tolerance: float = 1e-10) -> Mixture:
    """Largest likelihood of weighted rows without nulls, by expectation and maximisation.

    It begins once along each feature, with equal parts of the range of one standard deviation around its mean; after a
    short run the likeliest of these goes on until the mean logarithm hardly grows. Nothing is drawn, so the fit depends
    neither on how rows are dealt to tasks nor on how often a table repeats."""
    if components < 2:
        raise ValueError("a mixture needs two components at least")
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    w = F.col(weight).cast("double")
    n, missing, *m = df.agg(F.sum(w), F.count_if(F.greatest(*[F.col(f).isNull() for f in features])), *[F.sum(w * F.col(f)) for f in features]).first()
    if missing or not n or n <= d:
        raise ValueError("a mixture needs more rows than features, and no nulls in them")
    mean = np.array(m) / n
    x = [F.col(f) - float(c) for f, c in zip(features, mean, strict=True)]
    sigma = np.sqrt(np.array(df.agg(*[F.sum(w * v * v) for v in x]).first()) / n)

    def maximised(rows: DataFrame, bounds: list[float]) -> Mixture:
        """rows: with a share r0, r1, ... of the weight for each component, and a row's part of the likelihood."""
        r = [F.col(f"__r{k}") for k in range(components)]
        got = np.array(rows.agg(F.sum("__log"), *[F.sum(c) for c in r], *[F.sum(c * v) for c in r for v in x], *[F.sum(c * x[i] * x[j]) for c in r for i, j in pairs]).first())
        counts, sums, products = got[1 : 1 + components], got[1 + components :][: components * d].reshape(components, d), got[1 + components * (1 + d) :].reshape(components, len(pairs))
        some = counts + TINY
        centres = sums / some[:, None]
        spread = np.zeros((components, d, d))
        for at, (i, j) in enumerate(pairs):
            spread[:, i, j] = spread[:, j, i] = products[:, at] / some - centres[:, i] * centres[:, j]
        factors = np.stack([np.linalg.cholesky(np.linalg.inv(c + RIDGE * np.eye(d))) for c in spread])
        constants = np.log(some / n) + np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(1) - 0.5 * d * math.log(2 * math.pi)
        return Mixture(features, centres + mean, factors, constants, counts, [*bounds, got[0] / n])

    def expected(model: Mixture) -> DataFrame:
        names = range(components)
        rows = df.select(*features, weight, *[s.alias(f"__s{k}") for k, s in zip(names, model.scores(), strict=True)])
        rows = rows.withColumn("__top", F.greatest(*[f"__s{k}" for k in names])).withColumns({f"__e{k}": F.exp(F.col(f"__s{k}") - F.col("__top")) for k in names})
        rows = rows.withColumn("__sum", sum((F.col(f"__e{k}") for k in names), F.lit(0.0)))
        return rows.withColumns({"__log": w * (F.col("__top") + F.log("__sum")), **{f"__r{k}": w * F.col(f"__e{k}") / F.col("__sum") for k in names}})

    def begun(axis: int) -> Mixture:
        part = sum((x[axis] >= float(sigma[axis] * (2 * i / components - 1))).cast("int") for i in range(1, components))
        model = maximised(df.withColumns({"__log": F.lit(0.0), **{f"__r{k}": w * (part == k).cast("double") for k in range(components)}}), [])
        model.bounds = []
        for _ in range(short):
            model = maximised(expected(model), model.bounds)
        return model

    model = max(map(begun, range(d)), key=lambda found: found.bounds[-1])
    while len(model.bounds) < rounds and not model.converged:
        model = maximised(expected(model), model.bounds)
        model.converged = abs(model.bounds[-1] - model.bounds[-2]) < tolerance
    return model
