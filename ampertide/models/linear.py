"""Rolling least squares, lasso paths and L1 logits on sufficient statistics."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import halo_blocks, join_null_safe, row_index
from ..operators.stats import gram, scaler_fit, select_best
from ..session import cut


def rolling_ols(
    df: DataFrame,
    y: str,
    xs: list[str],
    n: int,
    order: list[str],
    cell: Column,
    degree: int = 1,
    by: list[str] = (),
    block: int = 4096,
) -> DataFrame:
    """Least squares on the previous n rows (constant, features, squares for degree
    2), predicting the row itself into `prediction`. Rows with nulls train nothing;
    null features or a short history give a null prediction.

    The cross products of each window are differences of running sums inside
    blocks with a halo of n rows; the solves are batched."""
    by = list(by)
    moments = df.select(y, *xs).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate([y, *xs])],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate([y, *xs])],
    )
    indexed = row_index(df, by, order, cell)
    d = halo_blocks(indexed, n, max(block, n))

    # Scaled columns keep the normal equations well conditioned.
    def scaled(i, c):
        sd = moments.select(F.coalesce(F.nullif(f"s{i}", F.lit(0.0)), F.lit(1.0))).scalar()
        return (F.col(c) - moments.select(f"m{i}").scalar()) / sd

    z = {f"_z{i}": scaled(i, c) for i, c in enumerate([y, *xs])}
    d = d.withColumns(z).withColumn("_sy", moments.select("s0").scalar()).withColumn(
        "_my", moments.select("m0").scalar()
    )
    feats = ["_c"] + [f"_z{i}" for i in range(1, len(xs) + 1)]
    if degree == 2:
        d = d.withColumns({f"_q{i}": F.col(f"_z{i}") ** 2 for i in range(1, len(xs) + 1)})
        feats += [f"_q{i}" for i in range(1, len(xs) + 1)]
    d = d.withColumn("_c", F.lit(1.0))
    k = len(feats)
    usable = F.lit(True)
    for c in [y, *xs]:
        usable = usable & F.col(c).isNotNull()
    terms = [F.col(a) * F.col(b) for a, b in combinations_with_replacement(feats, 2)]
    terms += [F.col(a) * F.col("_z0") for a in feats]
    w = W.partitionBy(*by, "_block").orderBy("_idx")
    upto, before = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.unboundedPreceding, -1 - n)
    zero = F.lit(0.0)
    sums = [
        (F.coalesce(F.sum(F.when(usable, t)).over(upto), zero)
         - F.coalesce(F.sum(F.when(usable, t)).over(before), zero))
        for t in terms
    ]
    out = d.select("*", F.array(*sums).alias("_g"), F.array(*feats).alias("_x"))
    out = out.filter(~F.col("_halo"))
    out = out.withColumn("_g", F.when(F.col("_idx") >= n, F.col("_g")))
    tri = list(combinations_with_replacement(range(k), 2))

    @F.pandas_udf("double")
    def solve(g: pd.Series, x: pd.Series) -> pd.Series:
        res = np.full(len(g), np.nan)
        at = [i for i, (a, b) in enumerate(zip(g, x)) if a is not None and b is not None and not pd.isna(b).any()]
        if at:
            v = np.stack([np.asarray(g.iloc[i], float) for i in at])
            xx = np.stack([np.asarray(x.iloc[i], float) for i in at])
            m = np.zeros((len(at), k, k))
            for c, (i, j) in enumerate(tri):
                m[:, i, j] = m[:, j, i] = v[:, c]
            rhs = v[:, len(tri):]
            beta = np.einsum("bij,bj->bi", np.linalg.pinv(m, rcond=1e-10, hermitian=True), rhs)
            good = m[:, 0, 0] > 0
            res[np.array(at)[good]] = (beta * xx).sum(1)[good]
        return pd.Series(res)

    pred = F.nanvl(solve("_g", "_x"), F.lit(None).cast("double"))
    return out.select(
        *df.columns, "_idx", (pred * F.coalesce(F.nullif("_sy", zero), F.lit(1.0)) + F.col("_my")).alias("prediction")
    )


# --- lasso ----------------------------------------------------------------------


def soft(x, t):
    return np.sign(x) * np.maximum(np.abs(x) - t, 0.0)


# Up to so many coefficients, sweeps run on plain floats.
PLAIN = 24


def descend_sweeps(g, xy, beta, lam, free, lower=None, upper=None, tol=1e-4, max_iter=1000):
    """(beta, sweeps, converged) of coordinate descent on a Gram matrix from `beta`. A full sweep
    comes first; later sweeps visit the active set, and a last full sweep confirms it."""
    if len(beta) <= PLAIN:
        return _plain_sweeps(g, xy, beta, lam, free, lower, upper, tol, max_iter)
    beta = beta.copy()
    lo = np.full(len(beta), -np.inf) if lower is None else lower
    hi = np.full(len(beta), np.inf) if upper is None else upper
    resid = xy - g @ beta
    full = True
    for sweep in range(1, max_iter + 1):
        move = 0.0
        for j in range(len(beta)):
            if g[j, j] <= 0 or not (full or beta[j] != 0):
                continue
            raw = resid[j] + g[j, j] * beta[j]
            new = min(max((raw if free[j] else soft(raw, lam)) / g[j, j], lo[j]), hi[j])
            step = new - beta[j]
            if step:
                resid -= g[:, j] * step
                beta[j] = new
                move = max(move, abs(step))
        done = move <= tol * max(np.abs(beta).max(), 1e-12)
        if done and full:
            return beta, sweep, True
        full = done
    return beta, max_iter, False


def _plain_sweeps(g, xy, beta, lam, free, lower, upper, tol, max_iter):
    """descend_sweeps on Python's own floats: the same operations in the same order, hence the same
    digits, without the cost of an array operation on a few numbers."""
    p = len(beta)
    resid, cols, beta = (xy - g @ beta).tolist(), g.T.tolist(), [float(b) for b in beta]
    lo = [-np.inf] * p if lower is None else [float(v) for v in lower]
    hi = [np.inf] * p if upper is None else [float(v) for v in upper]
    free, lam, every = [bool(f) for f in free], float(lam), range(p)
    usable = [j for j in every if not cols[j][j] <= 0]
    full = True
    for sweep in range(1, max_iter + 1):
        move = 0.0
        for j in usable:
            old = beta[j]
            if not full and old == 0:
                continue
            col = cols[j]
            new = raw = resid[j] + col[j] * old
            if not free[j]:
                size = abs(raw) - lam
                new = math.copysign(0.0, raw) if size <= 0.0 else math.copysign(size, raw) if raw == raw else raw
            new = min(max(new / col[j], lo[j]), hi[j])
            step = new - old
            if step:
                resid = [r - c * step for r, c in zip(resid, col)]
                beta[j] = new
                move = max(move, abs(step))
        top = max(map(abs, beta)) if all(b == b for b in beta) else np.nan
        done = move <= tol * max(top, 1e-12)
        if done and full:
            return np.array(beta), sweep, True
        full = done
    return np.array(beta), max_iter, False


def descend(*args, **kwargs):
    return descend_sweeps(*args, **kwargs)[0]


def lambda_grid(g, xy, free, n_lambda=100, eps=1e-4):
    if free.any():
        j = int(np.flatnonzero(free)[0])
        start = xy - g[:, j] * (xy[j] / g[j, j])
    else:
        start = xy
    top = np.abs(start).max()
    return np.geomspace(max(top, 1e-12), max(top, 1e-12) * eps, n_lambda)


def path_on_gram(g, xy, free, n_lambda=100, eps=1e-4, start=None, lower=None, upper=None, tol=1e-6, max_iter=1000):
    """(lambdas, betas, sweeps, converged), one of each per step."""
    lams = lambda_grid(g, xy, free, n_lambda, eps)
    beta = np.zeros(len(xy))
    out, sweeps, ended = [], [], []
    for i, lam in enumerate(lams):
        if start is not None and i < len(start):
            beta = np.asarray(start[i], float)
        beta, n, done = descend_sweeps(g, xy, beta, lam, free, lower, upper, tol, max_iter)
        out.append(beta)
        sweeps.append(n)
        ended.append(done)
    return lams, np.array(out), np.array(sweeps), np.array(ended)


def gram_arrays(stats: DataFrame, k: int) -> DataFrame:
    """gram() output with the triangle as one array `g`, X'y as `xy`."""
    tri = [f"g_{i}_{j}" for i, j in combinations_with_replacement(range(k), 2)]
    xy = [f"xy_{i}" for i in range(k)]
    keep = [c for c in stats.columns if c not in tri and c not in xy]
    return stats.select(*keep, F.array(*tri).alias("g"), F.array(*xy).alias("xy"))


def _unpack(tri, k):
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = np.asarray(tri, float)
    return g + np.triu(g, 1).T


def path_from_gram(
    stats: DataFrame, k: int, by: list[str], free: list[bool], n_lambda=100, eps=1e-4,
    lower: list[float] | None = None, upper: list[float] | None = None, start: str | None = None, max_iter: int = 1000,
) -> DataFrame:
    """Lasso path per key from one row of sufficient statistics: lambda, beta, RSS,
    BIC, converged and rounds (sweeps) for each step. `start` names an array column with a previous path."""
    free_ = np.array(free)
    lo = None if lower is None else np.array(lower, float)
    hi = None if upper is None else np.array(upper, float)
    by = list(by)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                g, xy = _unpack(r["g"], k), np.asarray(r["xy"], float)
                prev = r.get(start) if start else None
                lams, betas, sweeps, done = path_on_gram(g, xy, free_, n_lambda, eps, prev, lo, hi, max_iter=max_iter)
                rss = r["yy"] - 2 * betas @ xy + np.einsum("li,ij,lj->l", betas, g, betas)
                rss = np.maximum(rss, 1e-300)
                size = (np.abs(betas) > 1e-8).sum(1)
                n = float(r["n"])
                bic = n * np.log(rss / n) + size * np.log(n)
                for i in range(len(lams)):
                    rows.append([r[b] for b in by] + [i, lams[i], betas[i].tolist(), rss[i], bic[i], int(size[i]), bool(done[i]), int(sweeps[i])])
            yield pd.DataFrame(rows, columns=by + ["step", "lam", "beta", "rss", "bic", "n_active", "converged", "rounds"])

    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in stats.schema.fields if f.name in by)
    ddl = "step int, lam double, beta array<double>, rss double, bic double, n_active int, converged boolean, rounds int"
    packed = stats if "g" in stats.columns else gram_arrays(stats, k)
    return packed.mapInPandas(run, keys + ddl)


def lasso_path(
    df: DataFrame, y: str, xs: list[str], by: list[str] = (), w: str | None = None, intercept: bool = True, **kw
) -> DataFrame:
    """Lasso path per key. Spark reduces the data to Gram matrices whatever the key
    sizes are; only p x p statistics reach the solver. The constant is not
    penalised and comes first."""
    cols = (["_const"] if intercept else []) + list(xs)
    d = df.withColumn("_const", F.lit(1.0)) if intercept else df
    stats = gram(d, cols, y, w, list(by))
    free = [True] + [False] * len(xs) if intercept else [False] * len(xs)
    return path_from_gram(stats, len(cols), list(by), free, **kw)


def best_step(path: DataFrame, by: list[str] = ()) -> DataFrame:
    return select_best(path, list(by), "bic", ["step", "lam", "beta", "rss", "n_active"])


# --- L1 logit over a grid of C ------------------------------------------------------


def logit_path_bic(
    df: DataFrame, y: str, xs: list[str], cs: list[float], by: list[str] = (), rounds: int = 30, tol: float = 1e-5
) -> DataFrame:
    """L1-penalised logit for every C of the grid and every key, on scaled inputs,
    with log-likelihood and BIC; the penalty is |beta|_1 + C * loss.

    Each round is one pass over the data: a task turns its rows into weighted Gram
    sums for all C at once, Spark adds them, and a proximal Newton step updates
    the small coefficient table. Key sizes are unbounded; nothing is collected but
    the largest change. A C that has converged keeps its coefficients and takes no further part in a
    key's passes; `rounds` counts those it took."""
    by = list(by)
    key = by or ["_all"]
    d = df.select(*by, F.col(y).cast("double").alias("_y"), *xs).na.drop()
    # Small and written before it meets the data: its size is known to the join.
    mom = cut(scaler_fit(d, xs, by).drop("n"))
    if by:
        d = join_null_safe(d, mom, by)
    else:
        d = d.withColumns({c: mom.select(c).scalar() for c in mom.columns}).withColumn("_all", F.lit(0))
    z = [
        F.when(F.col(f"var_{c}") > 0, (F.col(c) - F.col(f"mean_{c}")) / F.sqrt(f"var_{c}")).otherwise(0.0)
        for c in xs
    ]
    # Rows are read once per round: kept in the checkpoint folder.
    data = cut(d.select(*key, "_y", F.array(F.lit(1.0), *z).alias("_x")))
    p, nc = len(xs) + 1, len(cs)
    c_arr = np.array(cs, float)
    tri = np.triu_indices(p)
    key_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in data.schema.fields if f.name in key)

    width = len(tri[0]) + p + 2
    cols = [f"v{i}" for i in range(width)]

    def partial(batches):
        """One row of sums per key and open C of a batch."""
        for pdf in batches:
            out = []
            for kv, part in pdf.groupby(key, sort=False):
                x = np.stack([np.asarray(v, float) for v in part["_x"]])
                t = part["_y"].to_numpy(float)
                for c, beta in zip(part["cs"].iloc[0], part["betas"].iloc[0]):
                    eta = np.clip(x @ np.asarray(beta, float), -30, 30)
                    pr = 1.0 / (1.0 + np.exp(-eta))
                    g = (x * (pr * (1.0 - pr))[:, None]).T @ x
                    ll = (t * eta - np.logaddexp(0.0, eta)).sum()
                    out.append([*kv, c, *g[tri], *(x.T @ (t - pr)), ll, len(t)])
            yield pd.DataFrame(out, columns=[*key, "c", *cols])

    free = np.array([True] + [False] * (p - 1))

    def update(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                old, best = np.asarray(r["beta"], float), np.asarray(r["best"], float)
                tail = [r["rounds"] + 1]
                if np.isnan(r["v0"]):  # converged in an earlier round
                    rows.append([*[r[q] for q in (*key, "c", "beta", "best", "obj", "ll", "n", "change", "rounds")]])
                    continue
                v = np.array([r[q] for q in cols])
                g = _unpack(v[: len(tri[0])], p) + 1e-9 * np.eye(p)
                grad, ll, n = v[len(tri[0]) : -2], v[-2], v[-1]
                obj = -ll + np.abs(old[1:]).sum() / c_arr[r["c"]]
                if obj > r["obj"] + 1e-10 * abs(r["obj"]):
                    # The last step went too far: halve it from the best point.
                    new = best + 0.5 * (old - best)
                    rows.append([*[r[q] for q in key], r["c"], new.tolist(), best.tolist(), r["obj"], r["ll"], n,
                                 float(np.abs(new - best).max()), *tail])
                    continue
                new = descend(g, grad + g @ old, old, 1.0 / c_arr[r["c"]], free, tol=1e-8)
                rows.append([*[r[q] for q in key], r["c"], new.tolist(), old.tolist(), obj, ll, n,
                             float(np.abs(new - old).max()), *tail])
            yield pd.DataFrame(rows, columns=[*key, "c", "beta", "best", "obj", "ll", "n", "change", "rounds"])

    state_cols = "c int, beta array<double>, best array<double>, obj double, ll double, n double, change double, rounds int"
    zeros = F.array_repeat(F.lit(0.0), p)
    state = cut(data.select(*key).distinct()).select(
        *key, F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("c"),
        zeros.alias("beta"), zeros.alias("best"), F.lit(float("inf")).alias("obj"),
    ).withColumns({"ll": F.lit(0.0), "n": F.lit(0.0), "change": F.lit(float("inf")), "rounds": F.lit(0)})
    sums_ddl = key_ddl + "c int, " + ", ".join(f"{c} double" for c in cols)
    totals = [F.sum(c).alias(c) for c in cols]
    for _ in range(rounds):
        going = state.filter(F.col("change") >= tol)
        current = going.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("c", "beta"))).alias("_b"))
        current = current.select(
            *key, F.transform("_b", lambda e: e["c"]).alias("cs"), F.transform("_b", lambda e: e["beta"]).alias("betas")
        )
        total = data.join(current, key).mapInPandas(partial, sums_ddl).groupBy(*key, "c").agg(*totals)
        state = cut(state.join(total, [*key, "c"], "left").mapInPandas(update, key_ddl + state_cols))
        if (state.agg(F.max("change")).head()[0] or 0.0) < tol:
            break
    c_col = F.get(F.array(*[F.lit(float(c)) for c in cs]), F.col("c"))
    n_free = F.size(F.filter("best", lambda b: F.abs(b) > 1e-8)).cast("double")
    n_par = n_free + F.when(F.abs(F.get("best", F.lit(0))) > 1e-8, 0.0).otherwise(1.0)
    return state.select(
        *by, c_col.alias("C"), F.col("best").alias("beta"), F.col("ll").alias("log_lik"), F.col("n").cast("long").alias("n"),
        (-2.0 * F.col("ll") + n_par * F.log("n")).alias("bic"), (F.col("change") < tol).alias("converged"), "rounds",
    )
