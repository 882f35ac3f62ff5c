"""Kernels against numpy, closed forms and properties."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from roadgeo.config import FEET_PER_METER, Params, build_params, smoothing_factor
from roadgeo.kernels import chains, profile, smooth
from roadgeo.plans import flow


def test_spline_meets_the_bound():
    rng = np.random.default_rng(1)
    x = np.linspace(0, 100, 200)
    y = np.sin(x / 7) + rng.normal(0, 0.1, 200)
    for s in (0.5, 2.0, 10.0):
        fit = smooth.smoothing_spline(x, y, s)
        assert ((y - fit) ** 2).sum() <= s * 1.002
    line = smooth.smoothing_spline(x, y, 1e9)
    assert np.allclose(line, np.polyval(np.polyfit(x, y, 3), x), atol=1e-6)
    assert np.allclose(smooth.smoothing_spline(x[:4], y[:4], 1.0), y[:4])


def test_savgol_keeps_parabolas():
    x = np.arange(50.0)
    y = 3 + 2 * x - 0.1 * x**2
    assert np.allclose(smooth.savgol(y), y)
    assert np.allclose(smooth.savgol(y[:2]), y[:2])
    i = 25
    noisy = y + np.random.default_rng(0).normal(0, 1, 50)
    assert np.isclose(smooth.savgol(noisy)[i], np.polyval(np.polyfit(x[15:36], noisy[15:36], 2), x[i]))


def test_high_pass():
    t = np.arange(400)
    slow, fast = np.sin(t / 60), np.sin(t * 2.0)
    out = smooth.zero_phase(slow + fast, 0.1)
    assert np.abs(out[50:-50] - fast[50:-50]).max() < 0.1
    assert np.abs(smooth.zero_phase(np.full(50, 7.0), 0.1)).max() < 1e-9
    assert not smooth.roughness(np.ones(10), 1.5).any()
    assert smooth.roughness(fast, 1.5)[200] == pytest.approx(np.sqrt(0.5) * FEET_PER_METER * 12, rel=0.1)


def test_filled():
    z = np.array([np.nan, 1, np.nan, 3, np.nan])
    assert smooth.filled(z).tolist() == [1, 1, 2, 3, 3]
    assert smooth.filled(np.array([np.nan] * 3)).tolist() == [0, 0, 0]


def test_dip_is_bridged_once():
    z = np.full(200, 100.0)
    z[90:110] -= 8
    trend = np.full(200, 100.0)
    out, tier = profile.repair_dips(z, trend, np.zeros(200, int), 3.0, Params())
    assert np.allclose(out, 100) and set(tier[89:111]) == {3} and not tier[:89].any() and not tier[111:].any()  # the anchors belong to the bridge
    long = np.full(2000, 100.0)
    long[50:1950] -= 8
    out, tier = profile.repair_dips(long, np.full(2000, 100.0), np.zeros(2000, int), 3.0, Params())
    assert np.array_equal(out, long) and not tier.any()


@pytest.mark.parametrize(("g1", "g2", "kind"), [(3, -2, "CREST"), (-3, 2, "SAG")])
def test_parabola(g1, g2, kind):
    d = np.arange(0, 1200, 3.0)
    a, b = 400.0, 700.0
    t = np.clip(d - a, 0, b - a)
    z = g1 / 100 * d + (g2 - g1) / 100 * t**2 / (2 * (b - a)) + (g2 - g1) / 100 * np.maximum(0, d - b)
    found = profile.vertical_curves(d, z, np.gradient(z, d) * 100, Params())
    assert len(found) == 1
    c = found[0]
    assert c["kind"] == kind and c["alg_diff"] == pytest.approx(g2 - g1, abs=0.2) and c["length_m"] == pytest.approx(300, abs=12)
    assert profile.vertical_curves(d, 0.02 * d, np.full(len(d), 2.0), Params()) == []


def test_stitching():
    whole = [(x / 1000, 45.0) for x in range(41)]
    cut = [{"points": whole[i : i + 11], "low": i / 10, "high": (i + 10) / 10} for i in range(0, 40, 10)]
    shuffled = [cut[0], cut[2] | {"points": cut[2]["points"][::-1]}, cut[1], cut[3]]
    got = chains.stitched(shuffled)
    assert len(got) == 1 and got[0]["points"] == whole and (got[0]["low"], got[0]["high"]) == (0, 4)
    down = [{"points": c["points"], "low": 4 - c["high"], "high": 4 - c["low"]} for c in cut]
    assert chains.stitched(down)[0]["points"] == whole[::-1]
    step = 400 / chains.distance_ft((0, 45), (1, 45))
    two = [{"points": [(0.0, 45.0), (0.01, 45.0)], "low": 0, "high": 1}, {"points": [(0.01 + step, 45.0), (0.05, 45.0)], "low": 1, "high": 2}]
    apart = chains.stitched(two, 1e-4)
    assert len(apart) == 2 and len(chains.merged(apart)) == 1 and len(chains.merged(apart, 300)) == 2
    assert chains.stitched([]) == []


def test_parameters():
    own = {"53": {"V_SMOOTH_FACTOR": 900, "V_SMOOTH_FACTOR_FS3": 700}}
    p = build_params({"dip_ft": "7", "savgol_window": 3, "trend_ft": "", "V_SMOOTH_FACTOR": "5"}, "53", own)
    assert (p.dip_ft, p.savgol_window, p.trend_ft) == (7.0, 5, 1000.0)
    assert smoothing_factor(p, "V", 1) == 900 and smoothing_factor(p, "V", 3) == 700 and smoothing_factor(p, "H", 2) == 200
    assert smoothing_factor(build_params({"V_SMOOTH_FACTOR": "5"}, "53", own, ignore_user_factors=False), "V", 1) == 5


def test_spline_as_by_dense_matrices():
    """The banded system against the same normal equations, and its penalty against jumps taken from the splines themselves."""
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.uniform(0.5, 2, 60))
    t = np.concatenate((np.full(4, x[0]), x[5:55:5], np.full(4, x[-1])))
    k, b = smooth._basis(x, t)
    a = np.zeros((60, len(t) - 4))
    for j in range(4):
        a[np.arange(60), k - 3 + j] = b[:, j]
    y = rng.normal(size=60)
    gram, rhs = smooth._normal(k, b, y, a.shape[1])
    assert np.allclose(gram.solve(rhs), np.linalg.solve(a.T @ a, a.T @ y))
    rough, jumps = smooth._jumps(t), []
    for j in range(a.shape[1]):
        c = np.zeros(a.shape[1])
        c[j] = 1
        third = []
        for lo, hi in zip(t[3:-4], t[4:-3], strict=True):  # of the cubic on each interval
            u = np.linspace(lo, hi, 6)[1:-1]
            kk, bb = smooth._basis(u, t)
            third.append(6 * np.polyfit(u - lo, (bb * c[kk[:, None] - 3 + np.arange(4)]).sum(axis=1), 3)[0])
        jumps.append(np.diff(third))
    dense = np.array(jumps) @ np.array(jumps).T
    band = np.zeros_like(dense)
    for d in range(5):
        for c in range(len(band) - d):
            band[c + d, c] = band[c, c + d] = rough.diagonals[d, c]
    assert np.allclose(band, dense, atol=1e-6 * np.abs(dense).max())
    for size in (1, 2, 4, 5, 9, 33, 100):
        m = smooth._Band(size)
        full = rng.normal(size=(size, size))
        full = np.tril(np.triu(full @ full.T + size * np.eye(size), -4), 4) + 50 * np.eye(size)
        for d in range(min(5, size)):
            m.diagonals[d, : size - d] = np.diagonal(full, -d)
        v = rng.normal(size=size)
        assert np.allclose(m.solve(v), np.linalg.solve(full, v))


def test_spline_of_100000_points_takes_seconds():
    rng = np.random.default_rng(3)
    x = np.arange(100_000) * 1.5
    y = np.cumsum(rng.normal(0, 0.2, len(x))) + 20 * np.sin(x / 500)
    began = time.monotonic()
    fit = smooth.smoothing_spline(x, y, 1400.0)
    assert time.monotonic() - began < 60 and ((y - fit) ** 2).sum() == pytest.approx(1400, rel=2e-3)


def test_stitching_of_thousands_of_pieces():
    rng = np.random.default_rng(4)
    whole = [(i * 2e-3, 45.0 + 1e-2 * np.sin(i / 50)) for i in range(20_001)]
    cut = [{"points": whole[i : i + 5], "low": i / 100, "high": (i + 4) / 100} for i in range(0, 20_000, 4)]
    began = time.monotonic()
    got = chains.stitched([cut[k] | ({"points": cut[k]["points"][::-1]} if k % 3 == 0 else {}) for k in rng.permutation(len(cut))])
    assert len(got) == 1 and got[0]["points"] == whole
    gap = 300 / chains.distance_ft((0, 45), (1, 45))
    apart = [{"points": [(i * 0.01, 45.0), (i * 0.01 + 0.01 - gap, 45.0)], "low": float(i), "high": float(i + 1), "parts": [i], "mids": [i + 0.5]} for i in rng.permutation(3000)]
    joined = chains.merged(apart)
    assert len(joined) == 1 and (joined[0]["low"], joined[0]["high"]) == (0, 3000) and joined[0]["mids"] == sorted(joined[0]["mids"])
    assert time.monotonic() - began < 60


def test_trend_and_clearances():
    z = np.full(400, 100.0)
    z[150:250] -= 30
    tier = np.zeros(400, int)
    tier[150:250] = 1
    p = Params()
    assert np.allclose(profile.trend_of(z, tier, 3.0, p), 100) and profile.trend_of(z, tier * 0, 3.0, p)[200] < 100
    out, tiers = profile.repair_dips(z, profile.trend_of(z, tier, 3.0, p), tier, 3.0, p)
    assert np.allclose(out, 100) and set(tiers[150:250]) == {1} and tiers[149] == tiers[250] == 3
    deck = profile.anchored(np.array([1.0, 2.0, 3.0]), np.array([10.0, 20.0, 30.0]), np.array([np.nan, 4.35, 0.0]))
    assert np.allclose(deck, [1, 20 + 4.35 + 4 / FEET_PER_METER, 3])


def test_sight_over_a_crest_and_tangent_grades():
    z = np.concatenate((np.linspace(0, 30, 300), np.linspace(30, 0, 300)))
    s = profile.sight(z, 1.5)
    assert s[0] > 1400 and s[290] < 400 and s[-1] == 0

    def plain(i):
        best, top = 0.0, -np.inf
        for k in range(1, min(len(z) - i, int(1500 / FEET_PER_METER / 1.5) + 1)):
            eye = z[i] + 3.5 / FEET_PER_METER
            top = max(top, (z[i + k] - eye) / (k * 1.5))
            if (z[i + k] + 2 / FEET_PER_METER - eye) / (k * 1.5) >= top:
                best = k * 1.5 * FEET_PER_METER
        return best

    assert all(s[i] == pytest.approx(plain(i)) for i in range(0, 600, 37))
    g = profile.tangent_grade(z, 1.5, 15.0)
    x = np.arange(600) * 1.5
    for i in (0, 3, 150, 298, 305, 599):
        lo, hi = max(0, i - 10), min(600, i + 10)
        assert g[i] == pytest.approx(np.polyfit(x[lo:hi], z[lo:hi], 1)[0] * 100, abs=1e-9)
    assert profile.tangent_grade(z[:2], 1.5, 15.0).tolist() == [0, 0]


def test_short_profiles_are_one_matrix(monkeypatch):
    rng = np.random.default_rng(4)
    short = [rng.normal(0, 50, n) for n in (5, 6, 12, 67, 90)]
    fit = lambda: [smooth.smoothing_spline(np.arange(len(z)) * 5.0, z, 100.0 * len(z)) for z in short]
    with monkeypatch.context() as m:
        m.setattr(smooth, "DENSE", smooth.BAND)
        m.setattr(smooth, "FEW", 0)
        by_blocks = fit()
    monkeypatch.setattr(smooth, "_reduced", None)  # no elimination by blocks, whose rounds cost more than such a system
    for a, b in zip(fit(), by_blocks, strict=True):
        assert np.allclose(a, b, atol=1e-6, rtol=0)


def test_long_chains_take_a_few_numbers_a_point(monkeypatch):
    """What a kernel makes on the way is as large as a part of the chain, not as the chain; parts give what one part does."""
    rng = np.random.default_rng(6)
    d = np.arange(300_000) * 1.5
    z = np.cumsum(rng.normal(0, 0.01, len(d))) + 20 * np.sin(d / 500)
    peaks = []
    for kernel in (lambda: smooth.smoothing_spline(d, z, 4000.0), lambda: smooth.roughness(z, 1.5), lambda: profile.trend_of(z, np.arange(len(z)) % 500 // 495, 1.5, Params())):
        tracemalloc.start()
        kernel()
        peaks.append(tracemalloc.get_traced_memory()[1] / len(d))
        tracemalloc.stop()
    assert max(peaks) < 80, peaks  # bytes
    d, z, known = d[:5000], z[:5000], np.arange(5000) % 500 // 495
    head = rng.uniform(-180, 180, 5000)
    out = lambda: [
        smooth.smoothing_spline(d, z, 5.0), smooth.smoothing_spline(d, z, 1e9), smooth.roughness(z, 1.5), profile.trend_of(z, known, 1.5, Params()), smooth.unwrapped(head.copy()), profile.slope(z, d),
        *[np.concatenate(c) for c in zip(*[profile.along(z, 1.5, 150.0, a, b) for a, b in smooth.parts(5000)], strict=True)],
    ]
    whole = out()
    assert np.array_equal(whole[4], np.unwrap(head, period=360)) and np.array_equal(whole[7], profile.sight(z, 1.5))
    monkeypatch.setattr(smooth, "PART", 333)
    for a, b in zip(whole, out(), strict=True):
        assert np.allclose(a, b, atol=1e-6, rtol=0)


def test_columns_of_a_chain_are_held_once_and_in_order():
    rng = np.random.default_rng(7)
    n = 300_000
    idx = rng.permutation(n)
    frames = lambda: (pd.DataFrame({"path": "A/1", "idx": idx[a : a + 10_000], "z": idx[a : a + 10_000] * 0.5, "known": idx[a : a + 10_000] % 3}) for a in range(0, n, 10_000))
    tracemalloc.start()
    first, v = flow.gathered(frames(), {"z": float, "known": np.int8})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first["path"] == "A/1" and list(v) == ["idx", "z", "known"] and v["known"].dtype == np.int8
    assert np.array_equal(v["idx"], np.arange(n)) and np.array_equal(v["z"], np.arange(n) * 0.5) and np.array_equal(v["known"], np.arange(n) % 3)
    assert peak < 60 * n
