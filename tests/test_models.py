import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ampertide.models import gamlss as G
from ampertide.models import linear as L
from ampertide.models import marginals as A
from ampertide.models import mvt as M
from ampertide.models import special


def _t_sample(n, p, nu, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(p, p)) / np.sqrt(p) + np.eye(p)
    z = rng.normal(size=(n, p)) @ a.T
    return z / np.sqrt(rng.chisquare(nu, n) / nu)[:, None], a @ a.T


def test_ecm_recovers_parameters():
    x, sigma = _t_sample(4000, 4, 5.0, 18)
    fit = M.fit_windows(x, np.ones((1, len(x))), "ecm")
    d = np.diag(fit["sd"][0])
    got = d @ fit["sigma"][0] @ d
    assert abs(fit["nu"][0] - 5.0) < 0.8
    assert np.linalg.norm(got - sigma) / np.linalg.norm(sigma) < 0.1
    assert np.abs(fit["mean"][0] + fit["sd"][0] * fit["mu"][0]).max() < 0.1


def test_windows_fit_alone_equals_together():
    x, _ = _t_sample(300, 3, 6.0, 2)
    m = np.zeros((3, 300))
    m[0, :150], m[1, 60:260], m[2] = 1, 1, 1
    both = M.fit_windows(x, m, "ecm")
    for b in range(3):
        one = M.fit_windows(x[m[b] == 1], np.ones((1, int(m[b].sum()))), "ecm")
        assert abs(np.log(both["nu"][b] / one["nu"][0])) < 0.02
        assert np.allclose(both["sigma"][b], one["sigma"][0], atol=5e-3)


def _panel(spark, days=24, seed=5):
    x, _ = _t_sample(days * 4, 3, 6.0, seed)
    rows = []
    for i in range(days * 4):
        day = dt.date(2024, 1, 1) + dt.timedelta(i // 4)
        ts = dt.datetime.combine(day, dt.time(9, 15 * (i % 4)))
        rows.append((day, 10, 1, ts, *map(float, x[i])))
    return spark.createDataFrame(
        rows, "delivery_date date, delivery_hour int, wh int, ts timestamp_ntz, y double, a double, b double"
    ), x


def test_mardia_prediction_is_the_conditional_moment(spark):
    rows, x = _panel(spark)
    names = ["y", "a", "b"]
    params = M.fit_mvt(rows, names, 10, "mardia", 4)
    ok = {r.date: r for r in params.collect()}
    day = dt.date(2024, 1, 20)
    train = x[(19 - 10) * 4 : 19 * 4]
    assert ok[day].n == 40
    z = (train - train.mean(0)) / train.std(0)
    s = np.cov(z, rowvar=False)
    d2 = np.einsum("ni,ij,nj->n", z, np.linalg.inv(s), z)
    k = (d2**2).mean() / 15
    nu = (4 * k - 2) / (k - 1) if k > 1 else np.inf
    assert ok[day].df == pytest.approx(nu, rel=1e-9) or (np.isinf(nu) and np.isinf(ok[day].df))
    pred = M.predict_mvt(rows, params, names)
    got = {r.timestamp: r for r in pred.collect()}[dt.datetime(2024, 1, 20, 9, 30)]
    row = (x[19 * 4 + 2] - train.mean(0)) / train.std(0)
    sig = s * (nu - 2) / nu if np.isfinite(nu) and nu > 2 else s
    inv = np.linalg.inv(sig[1:, 1:])
    mean = sig[0, 1:] @ inv @ row[1:] * train.std(0)[0] + train.mean(0)[0]
    schur = sig[0, 0] - sig[0, 1:] @ inv @ sig[1:, 0]
    factor = (nu + row[1:] @ inv @ row[1:]) / nu if np.isfinite(nu) else 1.0
    var = schur * ((nu + row[1:] @ inv @ row[1:]) / (nu + 2 - 2.0) if np.isfinite(nu) else 1.0) * train.var(0)[0]
    assert got.mu_cond == pytest.approx(mean, rel=1e-8)
    assert got.var_cond == pytest.approx(var, rel=1e-8)
    scored = M.score_density(pred).toPandas()
    assert scored.crps.notna().all() and (scored.crps > 0).all()
    assert factor > 0


def test_early_days_report_failure(spark):
    rows, _ = _panel(spark, days=4)
    got = M.fit_mvt(rows, ["y", "a", "b"], 10, "ecm", 4).orderBy("date").collect()
    assert [r.calibration_ok for r in got] == [False, False, True, True]
    assert got[0].error == "too few samples"


def test_fits_say_when_they_stop_short(spark):
    rows, _ = _panel(spark, days=8)
    got = M.fit_mvt(rows, ["y", "a", "b"], 10, "ecm", 4, max_iter=1).filter("rounds IS NOT NULL").collect()
    assert got and all(not r.converged and not r.calibration_ok and r.rounds == 1 and r.df is not None for r in got)
    assert got[0].error == "no convergence in 1 rounds"
    full = M.fit_mvt(rows, ["y", "a", "b"], 10, "ecm", 4).filter("rounds IS NOT NULL").collect()
    assert all(r.converged == r.calibration_ok and 1 <= r.rounds <= 200 for r in full) and any(r.converged for r in full)
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(300), rng.normal(size=(300, 3))])
    t = (rng.random(300) < 1 / (1 + np.exp(-x @ [0.2, 1.0, -2.0, 0.0]))).astype(float)
    beta, done, rounds = G.fit_l1_logit(x, t, 5.0, rounds=1)
    assert not done and rounds == 1
    beta, done, rounds = G.fit_l1_logit(x, t, 5.0)
    assert done and 1 < rounds < 50
    d = spark.createDataFrame(pd.DataFrame(x[:, 1:], columns=["a", "b", "c"]).assign(y=t, k=1))
    short = L.logit_path_bic(d, "y", ["a", "b", "c"], [0.1, 10.0], ["k"], rounds=1).collect()
    assert len(short) == 2 and all(not r.converged and r.rounds == 1 for r in short)
    path = L.logit_path_bic(d, "y", ["a", "b", "c"], [0.01, 0.1, 10.0], ["k"]).collect()
    assert all(r.converged and r.rounds <= 30 and r.n == 300 for r in path) and len({r.rounds for r in path}) > 1
    lasso = L.lasso_path(d, "a", ["b", "c"], ["k"], max_iter=1).collect()
    assert not any(r.converged for r in lasso if r.n_active > 1) and all(r.rounds == 1 for r in lasso)
    assert all(r.converged for r in L.lasso_path(d, "a", ["b", "c"], ["k"]).collect())


def test_covariance_of_a_fit(spark):
    rows, _ = _panel(spark)
    params = M.fit_mvt(rows, ["y", "a", "b"], 10, "mardia", 4).filter("calibration_ok AND df > 2").limit(1)
    p = params.collect()[0]
    c = M.model_covariance(params).collect()[0].covariance
    sd = np.array(p.scaler_scale)
    f = p.df / (p.df - 2) if np.isfinite(p.df) else 1.0
    assert np.allclose(np.array(c), np.array([list(r) for r in p.Sigma_scaled]) * f * np.outer(sd, sd))


@pytest.mark.parametrize("name", ["normal", "normal_var", "jsu", "jsu_native"])
def test_scores_are_derivatives(name):
    dist = G.DISTRIBUTIONS[name]()
    rng = np.random.default_rng(6)
    y = rng.normal(size=40)
    th = np.tile([0.3, 1.4, 0.5, 1.2][: len(dist.links)], (40, 1))
    for k in range(len(dist.links)):
        h = 1e-6
        up, dn = th.copy(), th.copy()
        up[:, k] += h
        dn[:, k] -= h
        want = (dist.log_pdf(y, up) - dist.log_pdf(y, dn)) / (2 * h)
        assert np.allclose(dist.score(y, th, k), want, atol=1e-5)
        bend = (dist.score(y, up, k) - dist.score(y, dn, k)) / (2 * h)
        assert np.allclose(dist.curvature(y, th, k), bend, atol=1e-4, rtol=1e-4)


@pytest.mark.parametrize("name", ["normal", "normal_var", "jsu", "jsu_native"])
def test_second_derivatives_equal_differences_in_high_precision(name):
    dist = G.DISTRIBUTIONS[name]()
    y = np.random.default_rng(6).normal(size=40).astype(np.longdouble)
    th = np.tile(np.array([0.3, 1.4, 0.5, 1.2][: len(dist.links)], dtype=np.longdouble), (40, 1))
    eta = [ln.link(c) for ln, c in zip(dist.links, th.T)]
    jet = dist.jet(y.astype(float), [e.astype(float) for e in eta])
    h = np.longdouble(1e-3)

    def value(moves):
        at = [e + sum(d for i, d in moves if i == k) for k, e in enumerate(eta)]
        return dist.log_pdf(y, np.column_stack([ln.inverse(e) for ln, e in zip(dist.links, at)]))

    for k in range(len(eta)):
        near = [value([(k, i * h)]) for i in (-2, -1, 0, 1, 2)]
        want = (-near[0] + 16 * near[1] - 30 * near[2] + 16 * near[3] - near[4]) / (12 * h * h)
        assert np.allclose(jet.h[k, k], want.astype(float), rtol=1e-7, atol=1e-7)
        up, down = th.copy(), th.copy()
        up[:, k] += h * 1e-2
        down[:, k] -= h * 1e-2
        bend = (dist.log_pdf(y, up) - 2 * dist.log_pdf(y, th) + dist.log_pdf(y, down)) / (h * 1e-2) ** 2
        assert np.allclose(dist.curvature(y.astype(float), th.astype(float), k), bend.astype(float), rtol=1e-6, atol=1e-6)
        for m in range(k):
            mixed = sum(i * j * value([(k, i * h), (m, j * h)]) for i in (-1, 1) for j in (-1, 1)) / (4 * h * h)
            assert np.allclose(jet.h[k, m], mixed.astype(float), rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("name", ["normal", "jsu_native"])
def test_newton_on_exact_curvature_ends_where_the_gradient_vanishes(name):
    rng = np.random.default_rng(31)
    z = rng.normal(size=(1500, 3))
    x = np.column_stack([np.ones(1500), z])
    y = z[:, 0] + np.exp(0.3 * z[:, 1]) * np.sinh((rng.normal(size=1500) + 0.4) / 1.5)
    dist = G.DISTRIBUTIONS[name]()
    b, nll, done, rounds = G.fit_regression(x, y, dist, information="curvature", rel_tol=1e-9)
    slow, worse, *_ = G.fit_regression(x, y, dist)
    assert done and rounds <= 25 and nll <= worse + 1e-6
    assert np.abs(dist.jet(y, [x @ c for c in b]).g @ x).max() < 1e-2


def logistic():
    # A local class: its code travels to the tasks.
    class Logistic(G.Distribution):
        """A user's own family: location and scale."""

        names = ("mu", "s")
        links = (G.IDENTITY, G.LOG)

        def start(self, y):
            return np.array([y.mean(), y.std() * np.sqrt(3) / np.pi])

        def log_density(self, y, mu, s):
            z = abs(y - mu) / s
            return -z - np.log(s) - 2 * np.log1p(np.exp(-z))

        def cdf(self, y, th):
            return 1 / (1 + F.exp(-(y - th[0]) / th[1]))

        def quantile(self, u, th):
            return th[0] + th[1] * F.log(u / (1 - u))

        def density(self, y, th):
            c = self.cdf(y, th)
            return c * (1 - c) / th[1]

        def moments(self, th):
            return th[0], th[1] * np.pi / np.sqrt(3)

    return Logistic()


def one_step_rows(spark, days=40, bins=8):
    rng = np.random.default_rng(8)
    rows = []
    for d in range(days):
        for b in range(bins):
            f, traded = float(rng.normal()), int(rng.random() < 0.7)
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(d), 7, b, 40.0, 41.0, traded, f, traded * float(f + rng.logistic())))
    names = "delivery_date date, delivery_hour int, ttd int, vwap double, vwap_lag1 double, alpha int, f double, vwap_changes double"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("dist", [logistic(), "jsu_native", "normal_var"])
@pytest.mark.parametrize("information", ["scores", "curvature"])
def test_any_family_goes_from_fit_to_score(spark, dist, information):
    rows = one_step_rows(spark)
    fit = G.fit_gamlss(rows, "vwap_changes", ["f"], dist, 25, 20, 12, information=information)
    logit = G.fit_trade_logit(rows, ["f"], 25, 20)
    got = G.one_step_forecast(rows, fit, logit, ["f"], ["f"], nodes=400, dist=dist).toPandas()
    assert len(got) and got[["crps", "log_score", "mu_hat", "sigma_hat_sd"]].notna().all().all()
    if not isinstance(dist, str):
        g = got[got.alpha_true == 1].iloc[0]
        s = g.sigma_hat_sd * np.sqrt(3) / np.pi
        z = np.exp(-(g.delta_true - g.mu_hat) / s)
        assert g.log_score == pytest.approx(np.log(g.pi_hat * z / (s * (1 + z) ** 2)))
        # CRPS of the mixture by its definition, the integral of (cdf - step)^2.
        t = np.linspace(-60, 60, 400001)
        cdf = g.pi_hat / (1 + np.exp(-(t - g.mu_hat) / s)) + (1 - g.pi_hat) * (t >= 0)
        assert g.crps == pytest.approx((((cdf - (t >= g.delta_true)) ** 2).sum() * (t[1] - t[0])), rel=5e-3)


def test_families_as_columns(spark):
    th = {"normal": [0.4, 1.3], "normal_var": [0.4, 1.7], "jsu": [0.4, 1.3, 0.6, 1.2], "jsu_native": [0.4, 1.3, 0.6, 1.2]}
    y = np.linspace(-3, 4, 50)
    d = spark.createDataFrame([(float(v), float(u)) for v, u in zip(y, np.linspace(0.001, 0.999, 50))], "y double, u double")
    for name, p in th.items():
        dist = G.family(name)
        cols = [F.lit(v) for v in p]
        q = d.select("y", "u", dist.quantile(F.col("u"), cols).alias("q")).toPandas()
        q = spark.createDataFrame(q)
        got = q.select("u", "y", dist.density(F.col("y"), cols).alias("pdf"), dist.cdf(F.col("q"), cols).alias("back")).toPandas()
        assert np.allclose(np.log(got.pdf), dist.log_pdf(y, np.tile(p, (50, 1))), atol=1e-9)
        assert np.allclose(got.back, got.u, atol=1e-12)


def test_regression_finds_mean_and_spread():
    rng = np.random.default_rng(7)
    z = rng.normal(size=(3000, 2))
    x = np.column_stack([np.ones(3000), z])
    y = 1.0 + 2.0 * z[:, 0] + np.exp(0.2 + 0.5 * z[:, 1]) * rng.normal(size=3000)
    for penalty in ("none", "lasso_bic"):
        betas, _, converged, _ = G.fit_regression(x, y, G.Normal(), penalty)
        assert converged
        assert np.allclose(betas[0], [1, 2, 0], atol=0.12)
        assert np.allclose(betas[1], [0.2, 0, 0.5], atol=0.12)
    betas, nll, converged, _ = G.fit_regression(x, y, G.JohnsonSU())
    assert converged
    assert np.allclose(betas[0], [1, 2, 0], atol=0.2)
    th = np.column_stack([lk.inverse(x @ b) for lk, b in zip(G.JohnsonSU.links, betas)])
    assert nll == pytest.approx(-G.JohnsonSU().log_pdf(y, th).sum())


def test_lasso_path_is_optimal():
    rng = np.random.default_rng(8)
    x = np.column_stack([np.ones(200), rng.normal(size=(200, 5))])
    y = 1 + x[:, 1] - 2 * x[:, 3] + 0.3 * rng.normal(size=200)
    g, xy = x.T @ x, x.T @ y
    free = np.array([True] + [False] * 5)
    lams, path, _, done = L.path_on_gram(g, xy, free, tol=1e-10)
    assert done.all()
    assert np.abs(path[0][1:]).max() < 1e-8
    for lam, b in zip(lams, path):
        grad = xy - g @ b
        assert abs(grad[0]) < 1e-4
        assert (np.abs(grad[1:]) <= lam + 1e-4).all()
        on = b[1:] != 0
        assert np.allclose(grad[1:][on], lam * np.sign(b[1:][on]), atol=1e-4)
    assert np.allclose(path[-1], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-2)
    bounded = L.path_on_gram(g, xy, free, lower=np.full(6, -1.0), upper=np.full(6, 0.5))[1]
    assert bounded.min() >= -1.0 and bounded.max() <= 0.5


def test_logit_path_by_key_equals_the_single_solver(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(900, 3)), columns=["a", "b", "c"])
    pdf["k"] = np.where(np.arange(900) % 3 == 0, 1, 0)
    pdf["y"] = (rng.random(900) < 1 / (1 + np.exp(-(0.3 + 1.5 * pdf.a - pdf.b * pdf.k)))).astype(int)
    cs = [0.01, 0.1, 1.0]
    got = L.logit_path_bic(spark.createDataFrame(pdf), "y", ["a", "b", "c"], cs, ["k"], tol=1e-7).toPandas()
    assert len(got) == 6
    for k in (0, 1):
        part = pdf[pdf.k == k]
        z = part[["a", "b", "c"]]
        z = ((z - z.mean()) / z.std(ddof=0)).to_numpy()
        x = np.column_stack([np.ones(len(z)), z])
        for c in cs:
            b = np.array(got[(got.k == k) & (got.C == c)].beta.iloc[0])
            t = part.y.to_numpy()
            grad = c * x.T @ (t - 1 / (1 + np.exp(-x @ b)))
            assert abs(grad[0]) < 1e-2
            assert (np.abs(grad[1:]) <= 1 + 1e-2).all()
            on = np.abs(b[1:]) > 1e-8
            assert np.allclose(grad[1:][on], np.sign(b[1:][on]), atol=1e-2)


@pytest.mark.parametrize("degree", [1, 2])
def test_rolling_ols_equals_least_squares(spark, degree):
    rng = np.random.default_rng(10)
    n, back = 260, 40
    pdf = pd.DataFrame({"t": np.arange(n), "a": rng.normal(50, 5, n), "b": rng.normal(size=n)})
    pdf["y"] = 3 + pdf.a - 2 * pdf.b + 0.1 * pdf.b**2 + 0.1 * rng.normal(size=n)
    pdf.loc[100, "a"] = np.nan
    d = spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    got = L.rolling_ols(d, "y", ["a", "b"], back, ["t"], F.floor(F.col("t") / 30), degree, block=64)
    got = got.toPandas().sort_values("t").prediction.to_numpy()

    def design(f):
        cols = [np.ones(len(f)), f.a, f.b] + ([f.a**2, f.b**2] if degree == 2 else [])
        return np.column_stack(cols)

    for i in range(n):
        if i < back or i == 100:
            assert np.isnan(got[i])
            continue
        w = pdf.iloc[i - back : i].dropna()
        beta = np.linalg.lstsq(design(w), w.y, rcond=None)[0]
        assert abs(got[i] - (design(pdf.iloc[i : i + 1]) @ beta)[0]) < 1e-5


def test_marginal_fits_are_optimal(spark):
    rng = np.random.default_rng(11)
    x = np.round(3 + 2 * rng.standard_t(4, 4000), 2)
    k = np.arange(4000) % 2
    ties = A._ties(spark.createDataFrame(pd.DataFrame({"k": k, "x": x})), "x", ["k"])
    t = A.fit_student(ties, ["k"]).toPandas()
    assert t.converged.all() and (t.rounds < A.PASSES).all()
    assert (np.abs(t["loc"] - 3) < 0.2).all() and (np.abs(t["df"] - 4) < 1.2).all()

    def t_ll(part, loc, scale, df):
        z = (part - loc) / scale
        norm = special.student_log_norm(np.array([df]))[0] - np.log(scale)
        return (norm - 0.5 * (df + 1) * np.log1p(z * z / df)).sum()

    for r in t.itertuples():
        part, best = x[k == r.k], None
        best = t_ll(part, r.loc, r.scale, r.df)
        for a, b, c in [(1, 1, 1.03), (1, 1, 0.97), (1, 1.01, 1), (1, 0.99, 1), (1.01, 1, 1), (0.99, 1, 1)]:
            assert t_ll(part, r.loc * a, r.scale * b, r.df * c) <= best + 1e-3
    j = A.fit_jsu(ties, ["k"]).toPandas()
    assert j.converged.all()
    for r in j.itertuples():
        grad = G.johnson_score(x[k == r.k], r.loc, np.log(r.scale), r.skew, np.log(r.tail)).sum(axis=0)
        assert np.abs(grad).max() < 0.5


def test_both_families_need_few_passes_and_bounds_hold(spark):
    rng = np.random.default_rng(21)
    n = 3000
    samples = {
        0: rng.standard_t(3, n), 1: rng.normal(7, 3, n), 2: 1e6 + 50 * rng.standard_t(6, n), 3: 300 - 0.01 * np.sinh((rng.normal(0, 1, n) - 1.5) / 2.0),
        4: np.sinh((rng.normal(0, 1, n) + 0.7) / 1.3) * 4 - 2,
    }
    d = spark.createDataFrame(pd.concat([pd.DataFrame({"k": k, "x": x}) for k, x in samples.items()]))
    fits = A.fit_families(A._ties(d, "x", ["k"]), ["k"], [A.student(50.0), A.JOHNSON]).toPandas().set_index("k")
    for k, x in samples.items():
        t, j = fits.student[k], fits.johnson[k]
        assert t["rounds"] <= 12 and j["rounds"] <= 12 and max(t["change"], j["change"]) < A.TOLERANCE**2
        loc, ls, ln = t["best"]

        def t_ll(loc, ls, ln):
            nu = np.exp(ln)
            z = (x - loc) / np.exp(ls)
            return (special.student_log_norm(nu) - ls - 0.5 * (nu + 1) * np.log1p(z * z / nu)).sum()

        top = t_ll(loc, ls, ln)
        assert t["ll"] == pytest.approx(top, rel=1e-9)
        for a, b, c in [(0.02, 0, 0), (0, 0.02, 0), (0, 0, 0.05)]:
            for s in (-1, 1):
                if ln + s * c <= np.log(50.0):
                    assert t_ll(loc + s * a * np.exp(ls), ls + s * b, ln + s * c) < top + 1e-6
        grad = G.johnson_score(x, j["best"][0], j["best"][1], j["best"][2], j["best"][3]).sum(axis=0)
        grad[0] *= np.exp(j["best"][1])
        # Normal data have no best tail: there only the promised gain is small.
        assert k == 1 or np.abs(grad).max() < 0.5
    assert np.exp(fits.student[1]["best"][2]) == pytest.approx(50.0)  # normal data: held by the bound


def test_psi_values():
    assert special.psi(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert special.psi(0.5, 1) == pytest.approx(np.pi**2 / 2, abs=1e-10)
    nu = np.array([0.3, 2.0, 40.0])
    first, second = special.student_log_norm_slopes(nu)
    h = 1e-4
    up, mid, down = (special.student_log_norm(nu + s) for s in (h, 0, -h))
    assert np.allclose(first, (up - down) / (2 * h), rtol=1e-5) and np.allclose(second, (up - 2 * mid + down) / h**2, rtol=1e-3, atol=1e-6)


def test_a_fit_does_not_depend_on_how_a_key_is_split(spark):
    x = np.random.default_rng(14).standard_t(5, 600)
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "x": x}))
    one = A.fit_student(A._ties(d.coalesce(1), "x", ["k"]), ["k"]).toPandas()
    many = A.fit_student(A._ties(d.repartition(13), "x", ["k"]), ["k"]).toPandas()
    assert np.allclose(one[["loc", "scale", "df"]], many[["loc", "scale", "df"]], rtol=1e-6)
    few = A.fit_student(A._ties(d, "x", ["k"]), ["k"], passes=2).toPandas()
    assert not few.converged.any() and (few.rounds == 2).all()


def test_fit_marginals_reports_distances(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(1, 2, 1500)
    d = spark.createDataFrame(pd.DataFrame({"k": 0, "x": x}))
    got = A.fit_marginals(d, "x", ["k"], None, 0.5).toPandas().set_index("distribution")
    s = np.sort(x)
    import math

    f = np.array([0.5 * math.erfc(-(v - x.mean()) / x.std() / math.sqrt(2)) for v in s])
    n = len(s)
    want = max((np.arange(1, n + 1) / n - f).max(), (f - np.arange(n) / n).max())
    assert got.ks["normal"] == pytest.approx(want, abs=1e-9)
    assert got.p_value["normal"] > 0.05


def test_student_cdf_values():
    # t with 1 and 2 degrees of freedom have closed forms.
    z = np.array([-3.0, -0.5, 0.0, 1.0, 4.0])
    assert np.allclose(special.student_cdf(z, np.ones(5)), 0.5 + np.arctan(z) / np.pi)
    assert np.allclose(special.student_cdf(z, np.full(5, 2.0)), 0.5 + z / (2 * np.sqrt(2 + z * z)))


def test_sweeps_on_plain_floats_give_the_same_digits_in_less_time(monkeypatch):
    import time

    rng = np.random.default_rng(11)
    a = rng.normal(size=80)
    x = np.column_stack([np.ones(80), a, a + 1e-4 * rng.normal(size=80), rng.normal(size=(80, 3)), a - 1e-3 * rng.normal(size=80)])
    y = 2000 * (x[:, 2] - x[:, 1]) + x[:, 3] + 0.01 * rng.normal(size=80)
    g, xy, free = x.T @ x + 1e-8 * np.eye(7), x.T @ y, np.array([True] + [False] * 6)
    took = {}
    for plain in (0, 24):
        monkeypatch.setattr(L, "PLAIN", plain)
        begun = time.process_time()
        for bounds in ({}, {"lower": np.full(7, -1.0), "upper": np.full(7, 0.5)}):
            took[plain, len(bounds)] = L.path_on_gram(g, xy, free, 30, 1e-4, **bounds)
        took[plain] = time.process_time() - begun
    for k in (0, 2):  # also the sign of zeros
        for arrays, plain in zip(took[0, k], took[24, k]):
            assert np.array_equal(arrays, plain)
        assert np.array_equal(np.signbit(took[0, k][1]), np.signbit(took[24, k][1]))
    assert took[24] < 0.7 * took[0]
