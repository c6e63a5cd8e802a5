"""The query of the Dirichlet-process mixture and its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import mixture as X
from ..sources.shared import materialize
from .cell_queries import FEAT
from .views import CELLS, cells

FEATURES = ["f0", "f1", "f2"]
#: Clusters and the feature whose mean tells the wanted one, rounds of the query.
CLUSTERS, ALONG, ROUNDS = 2, "f1", 6


def _features(s: SparkSession, d: str) -> DataFrame:
    return FE.feature_columns(cells(s, d)).where("f0 > -1e300").select("side", "ix", "iy", *FEATURES)


def cls_05_dp_mixture(s: SparkSession, d: str) -> DataFrame:
    """Shares of two components after six rounds, summed by stack, and the cells of the one with the larger second feature."""
    rows = materialize(_features(s, d), "mixture-rows")
    model = X.fit(rows, FEATURES, CLUSTERS, ALONG, ROUNDS, 0.0).pruned()
    best = model.largest(ALONG)
    out = model.predict(model.with_responsibilities(rows))
    share = F.get("r", F.lit(best))
    return out.groupBy("side", "ix", "iy").agg(F.count("*").alias("n"), F.count_if(F.col("component") == best).alias("positive"), F.round(F.sum(share), 4).alias("share"))


# SQL: the rounds are unrolled; a round is a row of sums and a row of parameters
_D = 3
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]


def _psi(x: str) -> str:
    y = f"({x} + 6)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8)" + "".join(f" - 1 / ({x} + {i})" for i in range(6)) + ")"


def _sums(source: str, share) -> str:  # noqa: ANN001
    cols = []
    for k in range(CLUSTERS):
        r = share(k)
        cols += [f"sum({r}) + {X.TINY!r} AS n{k}", *[f"sum({r} * x{i}) AS s{k}_{i}" for i in range(_D)], *[f"sum({r} * x{i} * x{j}) AS q{k}_{i}{j}" for i, j in _PAIRS]]
    return f"SELECT {', '.join(cols)} FROM {source}"


def _parameters(source: str) -> str:
    """Means, inverse covariances and constants of each component, from a row of sums."""
    k_ = range(CLUSTERS)
    means = ", ".join(f"s{k}_{i} / n{k} AS m{k}_{i}" for k in k_ for i in range(_D))
    cov = []
    for k in k_:
        for i, j in _PAIRS:
            ridge = X.RIDGE if i == j else 0.0
            cov.append(f"(c{i}{j} + n{k} * (q{k}_{i}{j} / n{k} - m{k}_{i} * m{k}_{j} + {ridge!r}) + n{k} / (1 + n{k}) * m{k}_{i} * m{k}_{j}) / ({_D} + n{k}) AS v{k}_{i}{j}")
    v = lambda k, i, j: f"v{k}_{min(i, j)}{max(i, j)}"
    minor = lambda k, i, j: "(" + " - ".join(
        [f"{v(k, (i + 1) % 3, (j + 1) % 3)} * {v(k, (i + 2) % 3, (j + 2) % 3)}", f"{v(k, (i + 1) % 3, (j + 2) % 3)} * {v(k, (i + 2) % 3, (j + 1) % 3)}"]) + ")"
    det = ", ".join(f"({' + '.join(f'{v(k, 0, j)} * {minor(k, 0, j)}' for j in range(3))}) AS det{k}" for k in k_)
    inverse = ", ".join(f"{minor(k, i, j)} / det{k} AS i{k}_{i}{j}" for k in k_ for i, j in _PAIRS)
    consts = []
    for k in k_:
        after = " + ".join(f"n{j}" for j in range(k + 1, CLUSTERS)) or "0.0"
        b = f"({1 / CLUSTERS!r} + {after})"
        weight = f"{_psi(f'(1 + n{k})')} - {_psi(f'(1 + n{k} + {b})')}"
        for j in range(k):
            bj = f"({1 / CLUSTERS!r} + {' + '.join(f'n{i}' for i in range(j + 1, CLUSTERS))})"
            weight += f" + {_psi(bj)} - {_psi(f'(1 + n{j} + {bj})')}"
        free = f"({_D} + n{k})"
        lam = f"{_D * math.log(2)!r} + " + " + ".join(_psi(f"(0.5 * ({free} - {i}))") for i in range(_D))
        consts.append(f"{weight} - {0.5 * _D * math.log(2 * math.pi)!r} - 0.5 * ln(det{k}) - 0.5 * {_D} * ln({free}) + 0.5 * ({lam} - {_D} / (1 + n{k})) AS k{k}")
    centres = ", ".join(f"n{k} * m{k}_{i} / (1 + n{k}) AS z{k}_{i}" for k in k_ for i in range(_D))
    return f"""SELECT {', '.join(consts)}, {inverse}, {centres}, {', '.join(f'n{k}' for k in k_)} FROM (SELECT *, {det} FROM (SELECT *, {', '.join(cov)} FROM (SELECT *, {means} FROM {source}, prior)))"""


def _scored(parameters: str) -> str:
    def score(k: int) -> str:
        d = [f"(x{i} - z{k}_{i})" for i in range(_D)]
        square = " + ".join(f"{2 if i != j else 1} * i{k}_{i}{j} * {d[i]} * {d[j]}" for i, j in _PAIRS)
        return f"k{k} - 0.5 * ({square}) AS l{k}"

    total = " + ".join(f"exp(l{k} - top)" for k in range(CLUSTERS))
    shares = ", ".join(f"exp(l{k} - top) / ({total}) AS r{k}" for k in range(CLUSTERS))
    return f"SELECT *, {shares} FROM (SELECT *, greatest({', '.join(f'l{k}' for k in range(CLUSTERS))}) AS top FROM (SELECT x.*, {', '.join(score(k) for k in range(CLUSTERS))} FROM x, {parameters}))"


def _mixture_sql() -> str:
    axis = FEATURES.index(ALONG)
    ctes = [
        CELLS, FEAT, "ok AS MATERIALIZED (SELECT side, ix, iy, f0, f1, f2 FROM feat WHERE f0 > -1e300)", "c AS MATERIALIZED (SELECT avg(f0) AS a0, avg(f1) AS a1, avg(f2) AS a2, count(*) AS nn FROM ok)",
        "x AS MATERIALIZED (SELECT side, ix, iy, f0 - a0 AS x0, f1 - a1 AS x1, f2 - a2 AS x2 FROM ok, c)",
        f"prior AS MATERIALIZED (SELECT {', '.join(f'sum(x{i} * x{j}) / (count(*) - 1) AS c{i}{j}' for i, j in _PAIRS)}, sqrt(sum(x{axis} * x{axis}) / count(*)) AS sigma FROM x)",
    ]
    part = " + ".join(f"CAST(x{axis} >= sigma * {2 * i / CLUSTERS - 1!r} AS INTEGER)" for i in range(1, CLUSTERS))
    ctes.append(f"s0 AS MATERIALIZED ({_sums(f'(SELECT x.*, {part} AS part FROM x, prior)', lambda k: f'CAST(part = {k} AS DOUBLE)')})")
    for t in range(ROUNDS):
        ctes.append(f"p{t} AS MATERIALIZED ({_parameters(f's{t}')})")
        if t + 1 < ROUNDS:
            ctes.append(f"s{t + 1} AS MATERIALIZED ({_sums(f'({_scored(f"p{t}")})', lambda k: f'r{k}')})")
    last = f"p{ROUNDS - 1}"
    best = f"(SELECT CASE WHEN z1_{axis} > z0_{axis} THEN 1 ELSE 0 END FROM {last})"
    return f"WITH {', '.join(ctes)} SELECT side, ix, iy, count(*) AS n, count(*) FILTER (WHERE (l1 > l0) = ({best} = 1)) AS positive, round(sum(CASE WHEN {best} = 1 THEN r1 ELSE r0 END), 4) AS share FROM ({_scored(last)}) GROUP BY ALL"


ORACLE = {"cls_05_dp_mixture": _mixture_sql()}
QUERIES = {"cls_05_dp_mixture": cls_05_dp_mixture}
