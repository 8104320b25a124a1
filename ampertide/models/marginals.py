"""Marginal distributions of unbounded samples, fitted by passes of aggregates.

Every pass turns the data into a few sums per key (combined map-side); the next
parameters follow from those sums. Key sizes do not matter."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric as N
from ..operators.ordered import join_null_safe
from ..operators.stats import delta_histogram
from ..session import cut
from . import special


def _ddl(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in names)


def _ties(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    d = df.select(*by, F.col(value).cast("double").alias("x")).na.drop(subset=["x"])
    return d.groupBy(*by, "x").agg(F.count(F.lit(1)).cast("double").alias("m"))


def _start(ties: DataFrame, by: list[str]) -> DataFrame:
    """n, mean (loc) and sd per key, in two passes: no cancellation."""
    m, x = F.col("m"), F.col("x")
    mean = cut(ties.groupBy(*by).agg(F.sum(m).alias("n"), (F.sum(m * x) / F.sum(m)).alias("loc")))
    dev = x - F.col("loc")
    spread_ = ties.join(mean, by).groupBy(*by, "n", "loc").agg(F.sum(m * dev * dev).alias("_q"))
    return spread_.select(*by, "n", "loc", F.sqrt(F.greatest(F.col("_q") / F.col("n"), F.lit(1e-12))).alias("sd"))


# One tolerance and one limit of passes for keys of every size; fits report whether they met it.
TOLERANCE = 1e-4
PASSES = 30
MAX_DF = 1e4
MIN_DF = 0.1


@dataclass(frozen=True)
class Family:
    """A distribution with parameters (location, log scale, further ones), as Newton steps see it.

    `terms` gives columns to add layer by layer (each used by later ones, so that nothing is computed
    twice), then per row the log density without the parts that depend on parameters alone, its
    score and its second derivatives (upper triangle), both with the location in units of the scale. `norm` adds the missing parts, per row and key:
    (value, score, second derivatives). `low` and `high` bound the parameters."""

    name: str
    first: Callable[[Column, Column], list[Column]]
    terms: Callable[[], tuple[list[dict[str, Column]], Column, list[Column], dict[tuple[int, int], Column]]]
    norm: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]
    low: tuple[float, ...]
    high: tuple[float, ...]

    @property
    def size(self) -> int:
        return len(self.low)

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return [(i, j) for i in range(self.size) for j in range(i, self.size)]


def _student_terms():
    th, x = F.col("student.th"), F.col("x")
    nu, z, q, d, w, pull, slope = (F.col(c) for c in ("nu", "t_z", "q", "d", "w", "pull", "slope"))
    layers = [
        {"nu": F.exp(th[2]), "t_z": (x - th[0]) / F.exp(th[1])},
        {"q": z * z, "d": nu + z * z},
        {"w": (nu + 1.0) / d, "fade": F.log1p(q / nu), "pull": (q - 1.0) / (d * d), "part": q / (nu * d)},
        {"slope": 0.5 * ((nu + 1.0) * F.col("part") - F.col("fade"))},
    ]
    bend = 0.5 * F.col("part") * (1.0 - (nu * nu + 2.0 * nu + q) / (nu * d))
    second = {
        (0, 0): -w * (nu - q) / d, (0, 1): -2.0 * nu * w * z / d, (0, 2): nu * z * pull,
        (1, 1): -2.0 * w * q * nu / d, (1, 2): nu * q * pull, (2, 2): nu * slope + nu * nu * bend,
    }
    return layers, -0.5 * (nu + 1.0) * F.col("fade"), [w * z, w * q, nu * slope], second


def _student_norm(th: np.ndarray):
    nu = math.exp(th[2])
    c1, c2 = (float(v) for v in special.student_log_norm_slopes(nu))
    second = np.zeros((3, 3))
    second[2, 2] = nu * c1 + nu * nu * c2
    return float(special.student_log_norm(nu)) - th[1], np.array([0.0, -1.0, nu * c1]), second


def _johnson_terms():
    th, x = F.col("johnson.th"), F.col("x")
    z, tail, root2, root, a, r, h, hz, ht = (F.col(c) for c in ("j_z", "tail", "root2", "root", "a", "r", "h", "hz", "ht"))
    layers = [
        {"j_z": (x - th[0]) / F.exp(th[1]), "tail": F.exp(th[3])},
        {"root2": z * z + 1.0, "a": tail * F.asinh(z)},
        {"root": F.sqrt(root2), "r": th[2] + a},
        {"h": z / root2 + r * tail / root, "hs": tail / root, "ht": tail * (a + r) / root,
         "hz": ((1.0 - z * z) / root2 + tail * tail - r * tail * z / root) / root2},
        {"zh": z * hz + h},
    ]
    second = {
        (0, 0): -hz, (0, 1): -F.col("zh"), (0, 2): F.col("hs"), (0, 3): ht, (1, 1): -z * F.col("zh"), (1, 2): z * F.col("hs"),
        (1, 3): z * ht, (2, 2): F.lit(-1.0), (2, 3): -a, (3, 3): -a * (a + r),
    }
    return layers, -F.log(root) - 0.5 * r * r, [h, h * z, -r, -r * a], second


def _johnson_norm(th: np.ndarray):
    return th[3] - th[1] - 0.5 * math.log(2 * math.pi), np.array([0.0, -1.0, 0.0, 1.0]), np.zeros((4, 4))


def student(max_df: float = MAX_DF) -> Family:
    return Family(
        "student", lambda loc, sd: [loc, F.log(sd) - 0.25, F.lit(math.log(5.0))], _student_terms, _student_norm,
        (-math.inf, -math.inf, math.log(MIN_DF)), (math.inf, math.inf, math.log(max_df)),
    )


# A Johnson-SU with tail 1 and no skew has 1.79 times its scale as standard deviation.
JOHNSON = Family(
    "johnson", lambda loc, sd: [loc, F.log(sd) - 0.58, F.lit(0.0), F.lit(0.0)], _johnson_terms, _johnson_norm,
    (-math.inf, -math.inf, -50.0, -6.0), (math.inf, math.inf, 50.0, 6.0),
)


def newton_direction(g: np.ndarray, second: np.ndarray, th: np.ndarray, low, high) -> tuple[np.ndarray, float]:
    """Ascent direction and the gain it promises. Directions of wrong or no curvature are turned round;
    a parameter that its bound holds back stays."""
    free = ~((th >= high) & (g > 0) | (th <= low) & (g < 0))
    out = np.zeros(len(g))
    if not free.any():
        return out, 0.0
    values, vectors = np.linalg.eigh(-second[np.ix_(free, free)])
    values = np.maximum(np.abs(values), 1e-8 * np.abs(values).max() + 1e-300)
    out[free] = np.clip(vectors @ (vectors.T @ g[free] / values), -1.0, 1.0)
    return out, float(g @ out)


def _newton_step(family: Family, q: dict, tol: float) -> dict:
    """The next state of one key from the sums of a pass: a shorter step where the likelihood fell,
    else a new direction from the point just reached."""
    th, best, direction = (np.asarray(q[c], float) for c in ("th", "best", "dir"))
    if q["change"] < tol**2:
        return {c: q[c] for c in ("th", "best", "ll", "dir", "size", "change", "rounds")}
    value, score, second = family.norm(th)
    ll = q["value"] + q["n"] * value
    if not np.isfinite(ll) or ll < q["ll"] - 1e-9 * abs(q["ll"]):
        size = q["size"] / 4
        th = np.clip(best + size * direction, family.low, family.high)
        return {
            "th": th.tolist(), "best": best.tolist(), "ll": q["ll"], "dir": direction.tolist(), "size": size,
            "change": 0.0 if size < 1e-3 else 1.0, "rounds": q["rounds"] + 1,
        }
    g = np.array(q["g"], float) + q["n"] * score
    for (i, j), v in zip(family.pairs, q["h"]):
        second[i, j] = second[j, i] = v + q["n"] * second[i, j]
    direction, gain = newton_direction(g, second, th, np.array(family.low), np.array(family.high))
    direction[0] *= math.exp(th[1])
    return {
        "th": np.clip(th + direction, family.low, family.high).tolist(), "best": th.tolist(), "ll": ll,
        "dir": direction.tolist(), "size": 1.0, "change": gain / q["n"], "rounds": q["rounds"] + 1,
    }


STATE = "th array<double>, best array<double>, ll double, dir array<double>, size double, change double, rounds int"


def fit_families(ties: DataFrame, by: list[str], families: list[Family], passes: int = PASSES, tol: float = TOLERANCE) -> DataFrame:
    """Per key: n and, per family, a struct with its best parameters `best`, log likelihood, change and
    rounds. All families advance by one Newton step in each pass over the data."""
    m = F.col("m")

    def opening(f: Family) -> Column:
        zeros = F.array(*[F.lit(0.0)] * f.size)
        th = F.array(*f.first(F.col("loc"), F.col("sd")))
        return F.struct(
            th.alias("th"), zeros.alias("best"), F.lit(float("-inf")).alias("ll"), zeros.alias("dir"), F.lit(1.0).alias("size"),
            F.lit(1.0).alias("change"), F.lit(0).alias("rounds"),
        ).alias(f.name)

    state = cut(_start(ties, by).select(*by, "n", *[opening(f) for f in families]))
    ddl = _ddl(ties, by) + "n double, " + ", ".join(f"{f.name} struct<{STATE}>" for f in families)

    layers = [layer for f in families for layer in f.terms()[0]]

    def sums(f: Family) -> list[Column]:
        _, value, score, second = f.terms()
        out = [F.sum(m * value).alias(f"{f.name}_value")]
        out += [F.sum(m * s).alias(f"{f.name}_g{i}") for i, s in enumerate(score)]
        return out + [F.sum(m * second[p]).alias(f"{f.name}_h{k}") for k, p in enumerate(f.pairs)]

    def step(batches):
        for pdf in batches:
            rows = []
            for q in pdf.to_dict("records"):
                row = [q[b] for b in by] + [q["n"]]
                for f in families:
                    seen = dict(q[f.name]) | {
                        "n": q["n"], "value": q[f"{f.name}_value"], "g": [q[f"{f.name}_g{i}"] for i in range(f.size)],
                        "h": [q[f"{f.name}_h{k}"] for k in range(len(f.pairs))],
                    }
                    row.append(_newton_step(f, seen, tol))
                rows.append(row)
            yield pd.DataFrame(rows, columns=[*by, "n", *[f.name for f in families]])

    # Built once: the passes differ only in the table of states.
    totals = [c for f in families for c in sums(f)]
    held = [F.col(f"`{b}`") for b in by] + [F.struct(f"{f.name}.th").alias(f.name) for f in families]
    going = F.greatest(F.lit(0.0), *[F.col(f"{f.name}.change") for f in families])
    for _ in range(passes):
        rows = ties.join(state.select(*held), by)
        for layer in layers:
            rows = rows.withColumns(layer)
        stats = rows.groupBy(*by).agg(*totals)
        state = cut(stats.join(state, by).mapInPandas(step, ddl))
        if (state.agg(F.max(going)).head()[0] or 0.0) < tol**2:
            break
    return state


def _marks(family: str, tol: float) -> list[Column]:
    return [(F.col(f"{family}.change") < tol**2).alias("converged"), F.col(f"{family}.rounds").alias("rounds")]


def _student_columns(tol: float) -> list[Column]:
    b = F.col("student.best")
    return [b[0].alias("loc"), F.exp(b[1]).alias("scale"), F.exp(b[2]).alias("df"), *_marks("student", tol)]


def _johnson_columns(tol: float) -> list[Column]:
    b = F.col("johnson.best")
    return [
        b[0].alias("loc"), F.exp(b[1]).alias("scale"), b[2].alias("skew"), F.exp(b[3]).alias("tail"),
        F.col("johnson.ll").alias("log_lik"), *_marks("johnson", tol),
    ]


def fit_student(
    ties: DataFrame, by: list[str], passes: int = PASSES, tol: float = TOLERANCE, max_df: float = MAX_DF
) -> DataFrame:
    """Location, scale and degrees of freedom (up to max_df) per key by maximum likelihood.

    Newton steps on summed scores and second derivatives, shortened when the likelihood falls. Converged:
    the gain that the next step promises, per row, is below tol squared. Adds converged and
    rounds; without convergence the best point so far is given."""
    return fit_families(ties, by, [student(max_df)], passes, tol).select(*by, "n", *_student_columns(tol))


def fit_jsu(ties: DataFrame, by: list[str], passes: int = PASSES, tol: float = TOLERANCE) -> DataFrame:
    """Location, scale, skew and tail per key, like fit_student."""
    return fit_families(ties, by, [JOHNSON], passes, tol).select(*by, "n", *_johnson_columns(tol))


@F.pandas_udf(T.DoubleType())
def student_cdf(z: pd.Series, nu: pd.Series) -> pd.Series:
    return pd.Series(special.student_cdf(z.to_numpy(), nu.to_numpy()))


def ks_p_value(ks: Column, n: Column) -> Column:
    """Asymptotic p-value of a Kolmogorov-Smirnov distance."""
    root = F.sqrt(n.cast("double"))
    lam = (root + 0.12 + 0.11 / root) * ks
    total = F.lit(0.0)
    for k in range(1, 31):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam * lam)
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def fit_marginals(
    df: DataFrame, value: str = "vwap_changes", by: list[str] = ("delivery_hour",), flag: str | None = "alpha",
    cell_width: float = 1.0,
) -> DataFrame:
    """Normal, t and Johnson-SU fits of traded price changes per key, each with its KS
    distance and p-value: (by, distribution, n, params, ks, p_value, converged, rounds)."""
    by = list(by)
    d = df.filter(F.col(flag) != 0) if flag else df
    ties = cut(_ties(d, value, by))
    x, m = F.col("x"), F.col("m")
    norm = cut(_start(ties, by).select(*by, "loc", F.col("sd").alias("scale"), F.lit(True).alias("converged"), F.lit(0).alias("rounds")))
    # Both families in the same passes; the written state feeds the distances and the output.
    fits = fit_families(ties, by, [student(), JOHNSON])
    t = fits.select(*by, "n", *_student_columns(TOLERANCE))
    j = fits.select(*by, "n", *_johnson_columns(TOLERANCE))
    cell = F.floor(F.col("x") / cell_width)
    out = None
    for label, par, cdf, cols in (
        ("normal", norm, N.normal_cdf(x, F.col("loc"), F.col("scale")), ["loc", "scale"]),
        ("student_t", t, student_cdf((x - F.col("loc")) / F.col("scale"), F.col("df")), ["df", "loc", "scale"]),
        (
            "johnson_su", j,
            N.jsu_cdf(x, F.col("loc"), F.col("scale"), F.col("skew"), F.col("tail")),
            ["skew", "tail", "loc", "scale"],
        ),
    ):
        placed = ties.join(par.drop("n", "converged", "rounds"), by).select(*by, "x", m.cast("long").alias("m"), cdf.alias("f"))
        ks = ks_distance_ties(placed, by, cell)
        row = ks.join(par.drop("n"), by).select(
            *by, F.lit(label).alias("distribution"), "n",
            F.array(*cols).alias("params"), "ks", ks_p_value(F.col("ks"), F.col("n")).alias("p_value"),
            "converged", "rounds",
        )
        out = row if out is None else out.unionByName(row)
    return out


def ks_distance_ties(placed: DataFrame, keys: list[str], cell: Column) -> DataFrame:
    """KS distance from distinct values x with counts m and cdf values f."""
    from ..operators.ordered import running_total

    cum = running_total(placed, keys, ["x"], ["m"], cell)
    below = (F.col("cum_m") - F.col("m")) / F.col("tot_m")
    upto = F.col("cum_m") / F.col("tot_m")
    return cum.groupBy(*keys).agg(
        F.max("tot_m").alias("n"),
        F.max(F.greatest(upto - F.col("f"), F.col("f") - below)).alias("ks"),
    )


def marginal_curve(
    df: DataFrame, value: str, loc: float, scale: float, nu: float, bins: int = 50, xlim: tuple[float, float] = (-4.0, 4.0)
) -> DataFrame:
    """Histogram density of a sample beside the fitted t and normal densities at the bin
    centres."""
    h = delta_histogram(df.withColumn("_f", F.lit(1)), value, "_f", bins, xlim)
    z = (F.col("center") - loc) / scale
    log_norm = float(special.student_log_norm(np.array([nu]))[0]) if math.isfinite(nu) else None
    t = (
        F.exp(log_norm - 0.5 * (nu + 1.0) * F.log1p(z * z / nu)) / scale
        if log_norm is not None
        else N.normal_pdf(F.col("center"), loc, scale)
    )
    total = df.filter(F.col(value).isNotNull()).agg(F.count(F.lit(1)).alias("c")).scalar()
    width = (xlim[1] - xlim[0]) / bins
    return h.select(
        "slot", "center", (F.col("n") / total / width).alias("density"), t.alias("t_density"),
        N.normal_pdf(F.col("center"), loc, scale).alias("normal_density"),
    )


def nu_profile(
    df: DataFrame, value: str, nus: list[float], loc: float, scale: float, by: list[str] = ()
) -> DataFrame:
    """t log-likelihood over a grid of nu, for the fitted and the empirical location and
    scale, with the maximum of each marked. One pass; the grid is a row of sums."""
    by = list(by)
    emp = cut(df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")))
    rows = df.select(*by, F.col(value).cast("double").alias("x")).na.drop(subset=["x"])
    if by:
        rows = join_null_safe(rows, emp, by)
    else:
        rows = rows.withColumns({c: emp.select(c).scalar() for c in ("_m", "_s")})
    # Fixed by the grid, computed at plan time.
    consts = [float(c) for c in special.student_log_norm(np.array(nus, float))]
    both = {"fitted": (F.lit(loc), F.lit(scale)), "empirical": (F.col("_m"), F.col("_s"))}
    out = None
    for label, (m, s) in both.items():
        z2 = ((F.col("x") - m) / s) ** 2
        sums = [
            F.sum(F.lit(c) - F.log(s) - 0.5 * (v + 1.0) * F.log1p(z2 / v)).alias(f"v{i}")
            for i, (v, c) in enumerate(zip(nus, consts))
        ]
        agg = rows.groupBy(*by).agg(*sums)
        grid = F.array(*[F.struct(F.lit(float(v)).alias("nu"), F.col(f"v{i}").alias("log_lik")) for i, v in enumerate(nus)])
        top = F.array_max(F.transform(grid, lambda e: e["log_lik"]))
        part = agg.select(*by, F.explode(grid).alias("g"), top.alias("_top")).select(
            *by, F.lit(label).alias("kind"), "g.*", (F.col("g.log_lik") == F.col("_top")).alias("is_max")
        )
        out = part if out is None else out.unionByName(part)
    return out
