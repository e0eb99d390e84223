"""Numeric kernels against closed forms and enumeration."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from splicespark.functions import kernels as K
from splicespark.operators import quant as Q
from splicespark.operators import stats as S


def test_log_gamma():
    x = np.array([1e-3, 0.25, 0.5, 1, 2.5, 10, 171.3, 5000])
    assert np.allclose(K.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def binomial_beta(x, a, b):
    n = a + b - 1
    return sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))


def test_beta_cdf_with_whole_parameters():
    for a, b in [(1, 1), (2, 5), (7, 3), (20, 20), (1, 40)]:
        for x in (0, 1e-9, 0.01, 0.3, 0.5, 0.77, 0.999, 1):
            assert K.beta_cdf(x, a, b) == pytest.approx(binomial_beta(x, a, b), abs=1e-11)


def test_beta_cdf_with_small_alpha():
    x = np.array([0.01, 0.2, 0.5, 0.9])
    assert np.allclose(K.beta_cdf(x, 0.5, 0.5), 2 / np.pi * np.arcsin(np.sqrt(x)), atol=1e-10)
    assert np.allclose(K.beta_cdf(x, 0.25, 1.0), x**0.25, atol=1e-10)
    assert np.allclose(K.beta_cdf(x, 0.25, 30.0) + K.beta_cdf(1 - x, 30.0, 0.25), 1, atol=1e-10)


def test_student_t():
    t = np.array([0.0, 0.5, 2.0, 10.0])
    assert np.allclose(K.t_two_sided(t, 1.0), 1 - 2 / np.pi * np.arctan(t), atol=1e-10)
    assert np.allclose(K.t_two_sided(t, 2.0), 1 - t / np.sqrt(2 + t * t), atol=1e-10)


def test_poisson_tail():
    for mean in (0.5, 3.0, 40.0):
        for k in (0, 1, 5, 60):
            exact = 1 - sum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(k + 1))
            assert float(K.poisson_above(np.array([k]), np.array([mean]))[0]) == pytest.approx(exact, abs=1e-12)


@pytest.mark.parametrize("n,m", [(1, 1), (2, 3), (4, 4), (3, 5)])
def test_exact_tests_by_enumeration(n, m):
    values = np.arange(n + m, dtype=float)
    orders = [set(c) for c in itertools.combinations(range(n + m), n)]

    def parts(chosen):
        return np.array([v for v in values if int(v) in chosen]), np.array([v for v in values if int(v) not in chosen])

    x, y = (np.array(z).T for z in zip(*map(parts, orders)))  # an order in each column
    both, turned = S.Ordered.of(x, y), S.Ordered.of(y, x)
    us = (x[:, None] > y[None]).sum((0, 1))
    least = np.minimum(us, n * m - us)
    tnoms, infos = S.tnom_test(both)[1], S.infoscore_test(both)[1]
    share = lambda v, most: np.array([(v <= z).mean() for z in most])
    assert np.allclose(S.wilcoxon(both)[0], np.minimum(1, 2 * share(us, least)))
    assert np.allclose(S.tnom_test(both)[0], share(tnoms, tnoms))
    assert np.allclose(S.infoscore_test(both)[0], share(infos, infos + 1e-8))
    for f in S.TESTS.values():
        p = f(both)[0]
        assert (p >= 0).all() and (p <= 1 + 1e-12).all() and np.allclose(p, f(turned)[0])


def test_ties_and_scores_one_by_one():
    rng = np.random.default_rng(5)
    for n, m in ((3, 4), (1, 5), (30, 50)):
        x, y = rng.integers(0, 4, (n, 60)) / 4, rng.integers(0, 4, (m, 60)) / 4
        o = S.Ordered.of(x, y)
        u, tnom, info = S.wilcoxon(o)[0], S.tnom_test(o)[1], S.infoscore_test(o)[1]
        for k in range(60):
            a, b = x[:, k], y[:, k]
            ties = [int(c) for c in np.unique(np.concatenate((a, b)), return_counts=True)[1]]
            value = sum((i > j) + 0.5 * (i == j) for i in a for j in b)
            assert u[k] == pytest.approx(K.u_test(value, n, m, ties))
            splits = [((a <= t).sum(), (b <= t).sum()) for t in np.unique(np.concatenate((a, b)))]
            assert tnom[k] == min(n, m, *(min(i + m - j, n - i + j) for i, j in splits))
            assert info[k] == pytest.approx(min(K.entropy(i, j) + K.entropy(n - i, m - j) for i, j in splits))


def test_tests_at_the_edges():
    of = lambda x, y: S.Ordered.of(np.asarray(x, float).reshape(len(x), -1), np.asarray(y, float).reshape(len(y), -1))
    assert all(f(S.Ordered.of(np.full((1, 2), 0.5), np.zeros((0, 2))))[0].tolist() == [1.0, 1.0] for f in S.TESTS.values())
    assert S.ttest(of([0.5] * 4, [0.5] * 4))[0] == 1.0
    big = np.linspace(0, 1, 40)
    assert S.wilcoxon(of(big, big + 2))[0] < 1e-10 and S.wilcoxon(of(big, big))[0] > 0.9
    assert S.chosen_tests(["ttest", "TNOM", "ttest"]) == ["TNOM", "TTEST"] and len(S.chosen_tests(["ALL"])) == 4


def unrolled(*lsvs):
    column = [[{"junc_idx": j, "boots": list(map(float, b))} for j, b in enumerate(x)] for x in lsvs]
    return Q.Unrolled.of(pa.array(column, pa.list_(pa.struct([("junc_idx", pa.int32()), ("boots", pa.list_(pa.float64()))]))))


def test_unrolled_lsvs():
    u = unrolled([[1, 2], [3, 4], [0, 0]], [[5, 6], [0, 1]])
    assert u.lsv.tolist() == [0, 0, 0, 1, 1] and u.junc_idx.tolist() == [0, 1, 2, 0, 1] and u.n.tolist() == [3, 3, 3, 2, 2]
    assert u.totals.tolist() == [[4, 6]] * 3 + [[5, 7]] * 2
    a, b = u.alpha_beta()
    assert np.allclose(a[4], [0.5, 1.5]) and np.allclose(b[4], [5.5, 6.5]) and np.allclose(u.means()[2], np.median([(1 / 3) / 5, (1 / 3) / 7]))


def test_histograms():
    rng = np.random.default_rng(1)
    u = unrolled(rng.integers(0, 30, (3, 10)))
    a, b = u.alpha_beta()
    h = Q.psi_masses(a, b, 40)
    assert h.shape == (3, 10, 40) and np.allclose(h.sum(2), 1)
    means = (h.mean(1) * ((np.arange(40) + 0.5) / 40)).sum(1)
    assert np.allclose(means, (a / (a + b)).mean(1), atol=0.02)


@pytest.mark.parametrize("prior", [Q.default_prior(), np.log(np.full(39, 1 / 39))])
def test_joint_posterior_cell_by_cell(prior):
    rng = np.random.default_rng(2)
    p, q = rng.random((4, 3, 20)), rng.random((4, 3, 20))
    p, q = p / p.sum(2, keepdims=True), q / q.sum(2, keepdims=True)
    matrix = Q.prior_matrix(prior)
    got = Q.joint_posterior(p, q, np.stack([matrix] * 4)).reshape(4, -1) @ Q.diagonals()
    for j in range(4):
        want = np.zeros(39)
        for r in range(3):
            cells = {(x, y): p[j, r, x] * q[j, r, y] * np.exp(prior[y - x + 19]) for x in range(20) for y in range(20)}
            whole = sum(cells.values())
            for (x, y), v in cells.items():
                want[y - x + 19] += v / whole / 3
        assert np.allclose(got[j], want) and got[j].sum() == pytest.approx(1)
    assert np.exp(Q.default_prior()).sum() == pytest.approx(1)


def test_least_samples():
    assert Q.least_samples(0.01, 4) == 625 and Q.least_samples(1.0, 4) == 1


@pytest.mark.parametrize("mean", [0.01, 3.0, 40.0, 1e3, 1e4, 1e6])
def test_poisson_tail_of_large_means(mean):
    spread = math.sqrt(mean)
    for k in {max(0, int(mean + d * spread)) for d in (-8, -3, -1, 0, 1, 3, 6)}:
        if k <= 20_000:
            logs = [i * math.log(mean) - mean - math.lgamma(i + 1) for i in range(k + 1)]
            below = math.fsum(math.exp(x) for x in logs)
            assert K.poisson_above(k, mean) == pytest.approx(1 - below, abs=1e-9)
        z = (k + 0.5 - mean) / spread
        if mean >= 1e4:
            assert K.poisson_above(k, mean) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), abs=3e-3)
    assert K.poisson_above(10, 1250) == pytest.approx(1.0)
    assert K.poisson_above(0, 1e-9) == pytest.approx(1e-9)


def test_beta_of_large_parameters():
    for n in (1e3, 1e5, 1e7):
        assert K.beta_cdf(0.5, n, n) == pytest.approx(0.5, abs=1e-6)
