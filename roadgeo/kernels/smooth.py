"""Smoothing in numpy: cubic spline under a bound on the residuals, Savitzky-Golay, roughness by a high-pass filter."""

from __future__ import annotations

import numpy as np

from ..config import FEET_PER_METER

#: Half-bandwidth of a cubic spline's normal equations with damped jumps; unknowns up to which a system is one dense matrix; entries up to which a basis is one.
BAND, DENSE, FEW = 4, 96, 1 << 15
#: Points of a long chain that are worked on at a time: what is made on the way stays this small, whatever the chain's length.
PART = 1 << 15


def parts(n: int, size: int = 0) -> list[tuple[int, int]]:
    """Begin and end of the parts of n points, PART (or size) in each."""
    size = size or PART
    return [(a, min(n, a + size)) for a in range(0, n, size)]


def _basis(x: np.ndarray, t: np.ndarray, k: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Interval of each x in the knots t (cubic, clamped), if it isn't given, and its four non-zero B-splines."""
    if k is None:
        k = np.clip(np.searchsorted(t, x, side="right") - 1, 3, len(t) - 5)
    b = np.zeros((4, len(x)))
    b[0] = 1.0
    near = {j: t[k + j] for j in range(-2, 4)}
    ahead, behind = {j: near[j] - x for j in (1, 2, 3)}, {j: x - near[j] for j in (-2, -1, 0)}
    for d in range(1, 4):
        saved = np.zeros(len(x))
        for r in range(d):
            term = b[r] / (near[r + 1] - near[r + 1 - d])
            b[r] = saved + ahead[r + 1] * term
            saved = behind[r + 1 - d] * term
        b[d] = saved
    return k, b.T


class _Band:
    """A symmetric positive definite matrix of half-bandwidth BAND, by its diagonals; sums, and solves by block cyclic reduction.

    Blocks of BAND rows are block tridiagonal. Each round eliminates every other block, all at once, so a system of n
    unknowns takes log2(n) rounds of numpy work on stacks of small matrices, and time and memory in proportion to n.
    """

    def __init__(self, size: int):
        self.size, self.diagonals = size, np.zeros((BAND + 1, size))

    def add(self, row: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
        """Add values at places on or below the diagonal."""
        np.add.at(self.diagonals, (row - column, column), value)

    def trace(self) -> float:
        return float(self.diagonals[0].sum())

    def plus(self, other: _Band, times: float) -> _Band:
        out = _Band(self.size)
        out.diagonals = self.diagonals + times * other.diagonals
        return out

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        if (n := self.size) <= DENSE:
            whole = np.zeros(n * n)
            for d in range(min(BAND + 1, n)):
                whole[d * n :: n + 1] = whole[d : (n - d) * n : n + 1] = self.diagonals[d, : n - d]
            return np.linalg.solve(whole.reshape(n, n), rhs)
        k = -(-self.size // BAND)
        low = np.zeros((BAND + 1, k * BAND))
        low[0, self.size :] = 1.0
        low[:, : self.size] = self.diagonals
        b = np.zeros(k * BAND)
        b[: self.size] = rhs
        main, side = np.zeros((k, BAND, BAND)), np.zeros((k, BAND, BAND))  # side[i] joins block i + 1 with block i
        for d in range(BAND + 1):
            at = low[d].reshape(k, BAND)
            for c in range(BAND):
                r = c + d
                if r < BAND:
                    main[:, r, c] = main[:, c, r] = at[:, c]
                else:
                    side[:, r - BAND, c] = at[:, c]
        return _reduced(main, side[:-1], b.reshape(k, BAND, 1)).reshape(-1)[: self.size]


def _reduced(main: np.ndarray, side: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a block tridiagonal system; the odd blocks are eliminated, the even ones solved for, the odd ones put back. A few blocks are one matrix."""
    k = len(main)
    if k * BAND <= DENSE:
        whole, i = np.zeros((k, BAND, k, BAND)), np.arange(k)
        whole[i, :, i] = main
        whole[i[1:], :, i[:-1]] = side
        whole[i[:-1], :, i[1:]] = side.transpose(0, 2, 1)
        return np.linalg.solve(whole.reshape(k * BAND, k * BAND), b.reshape(k * BAND, 1)).reshape(b.shape)
    odd, even = main[1::2], main[0::2].copy()
    left, right = side[0::2], side[1::2]  # of each odd block with the even one before, of the even one after with it
    many = len(right)
    known = np.linalg.solve(odd, np.concatenate([left, b[1::2]], axis=2))
    by_left, by_b = known[:, :, :-1], known[:, :, -1:]
    by_right = np.linalg.solve(odd[:many], right.transpose(0, 2, 1))
    rhs = b[0::2].copy()
    even[: len(odd)] -= left.transpose(0, 2, 1) @ by_left
    rhs[: len(odd)] -= left.transpose(0, 2, 1) @ by_b
    even[1 : 1 + many] -= right @ by_right
    rhs[1 : 1 + many] -= right @ by_b[:many]
    x_even = _reduced(even, -(right @ by_left[:many]), rhs)
    out = np.empty_like(b)
    out[0::2] = x_even
    out[1::2] = by_b - by_left @ x_even[: len(odd)]
    out[1::2][:many] -= by_right @ x_even[1 : 1 + many]
    return out


def _normal(k: np.ndarray, b: np.ndarray, y: np.ndarray, size: int) -> tuple[_Band, np.ndarray]:
    """Normal equations of a spline with the basis b of each point in its knot interval k."""
    gram, rhs = _Band(size), np.zeros(size)
    if len(y) * size <= FEW:
        a = np.zeros((len(y), size))
        a[np.arange(len(y))[:, None], k[:, None] - 3 + np.arange(4)] = b
        whole = a.T @ a
        for d in range(min(BAND, size)):
            gram.diagonals[d, : size - d] = whole.diagonal(d)
        return gram, a.T @ y
    for p in range(4):
        rhs += np.bincount(k - 3 + p, b[:, p] * y, size)[:size]
        for q in range(p + 1):
            gram.diagonals[p - q] += np.bincount(k - 3 + q, b[:, p] * b[:, q], size)[:size]
    return gram, rhs


def _jumps(t: np.ndarray) -> _Band:
    """Sum of the squared jumps of the third derivative at the inner knots, as a form of the coefficients."""
    m = len(t) - 4
    d = np.ones((m, 1))
    for order in range(1, 4):
        span = t[4 : 4 + m - order] - t[order:m]
        d = (np.pad(d[1:], ((0, 0), (1, 0))) - np.pad(d[:-1], ((0, 0), (0, 1)))) * ((4 - order) / span)[:, None]
    d = np.pad(d[1:], ((0, 0), (1, 0))) - np.pad(d[:-1], ((0, 0), (0, 1)))  # five coefficients from the row's own on
    rough, at = _Band(m), np.arange(len(d))
    for p in range(5):
        for q in range(p + 1):
            rough.add(at + p, at + q, d[:, p] * d[:, q])
    return rough


class _Fit:
    """A spline with knots at both ends and at some of the points (inner): normal equations, least squares, values.

    The basis is made part by part, again for each use; only that of a single part is kept. So beside the points
    themselves nothing grows with their number but one value a point.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, inner: np.ndarray):
        self.x, self.y, self.inner = x, y, inner
        self.t = np.concatenate((np.full(4, x[0]), x[inner], np.full(4, x[-1])))
        self.size = len(self.t) - 4
        self.one = next(self._made()) if len(x) <= PART else None

    def _made(self):
        for a, b in parts(len(self.x)):
            first, last = np.searchsorted(self.inner, (a, b))
            step = np.zeros(b - a, np.int64)
            step[self.inner[first:last] - a] = 1
            yield a, b, *_basis(self.x[a:b], self.t, np.cumsum(step) + (3 + first))

    def _bases(self):
        return (self.one,) if self.one else self._made()

    def normal(self) -> tuple[_Band, np.ndarray]:
        gram, rhs = _Band(self.size), np.zeros(self.size)
        for a, b, k, basis in self._bases():
            low, high = (0, self.size) if self.one else (int(k[0]) - 3, int(k[-1]) + 1)
            own, right = _normal(k - low, basis, self.y[a:b], high - low)
            gram.diagonals[:, low:high] += own.diagonals
            rhs[low:high] += right
        return gram, rhs

    def least_squares(self) -> np.ndarray:
        """Coefficients by the normal equations, which B-splines keep well conditioned; by SVD where they are few, of QR factors where the points are many."""
        if self.size <= 8:
            kept = np.zeros((0, self.size + 1))
            for a, b, k, basis in self._bases():
                rows = np.zeros((b - a, self.size + 1))
                for j in range(4):
                    rows[np.arange(b - a), k - 3 + j] = basis[:, j]
                rows[:, -1] = self.y[a:b]
                kept = rows if self.one else np.linalg.qr(np.concatenate((kept, rows)), mode="r")
            return np.linalg.lstsq(kept[:, :-1], kept[:, -1], rcond=None)[0]
        gram, rhs = self.normal()
        gram.diagonals[0] += 1e-13 * gram.trace() / self.size
        return gram.solve(rhs)

    def values(self, c: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.x))
        for a, b, k, basis in self._bases():
            own = c[int(k[0]) - 3 : int(k[-1]) + 1]
            at = k - int(k[0])
            out[a:b] = sum((basis[:, p] * own[at + p] for p in range(1, 4)), basis[:, 0] * own[at])
        return out


def _squares(y: np.ndarray, fit: np.ndarray) -> np.ndarray:
    r = y - fit
    r *= r
    return r


def smoothing_spline(x: np.ndarray, y: np.ndarray, s: float, tol: float = 1e-3) -> np.ndarray:
    """Values at x of a cubic spline with a sum of squared residuals of s (within tol), with as few knots as do.

    If a cubic polynomial already has no more than s, it is the result. Else knots are added where residuals are
    largest until least squares get below s, and the jumps of the third derivative are then damped as far as s allows
    (Dierckx). x must increase; fewer than five points come back as they are. All systems are banded, so time grows with
    the number of points, and memory by a few numbers a point and some hundred bytes a knot.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    if n < 5:
        return y.copy()
    inner = np.zeros(0, np.int64)
    fit = None
    while True:
        spline = _Fit(x, y, inner)
        del fit
        fit = spline.values(spline.least_squares())
        total = _squares(y, fit)
        above = total.sum() > s
        if not above or len(inner) >= n - 4:
            break
        edges = np.concatenate(([0], inner, [n - 1]))
        np.cumsum(total, out=total)
        gain = total[edges[1:]] - np.where(edges[:-1] > 0, total[edges[:-1] - 1], 0.0)
        wide = np.nonzero(np.diff(edges) >= 2)[0]
        if not len(wide):
            break
        worst = wide[np.argsort(-gain[wide], kind="stable")][: max(1, len(edges) // 2)]
        inner = np.sort(np.concatenate((inner, (edges[worst] + edges[worst + 1]) // 2)))
    del total
    if not len(inner) or above:
        return fit
    gram, rhs = spline.normal()
    rough = _jumps(spline.t)
    scale = gram.trace() / rough.trace()
    low, high = -14.0, 8.0  # of log10 of the damping
    f_low = f_high = None
    for _ in range(60):
        mid = (low + high) / 2
        if f_low is not None and f_high is not None and f_high > f_low:  # a secant of logarithms, kept off the ends
            mid = low + (high - low) * min(0.9, max(0.1, -f_low / (f_high - f_low)))
        del fit
        fit = spline.values(gram.plus(rough, scale * 10.0**mid).solve(rhs))
        got = float(_squares(y, fit).sum())
        if abs(got - s) <= tol * s:
            break
        f = np.log(max(got, 1e-300) / s)
        if f < 0:
            low, f_low = mid, f
        else:
            high, f_high = mid, f
    return fit


def savgol(y: np.ndarray, window: int = 21, degree: int = 2) -> np.ndarray:
    """Local polynomial of the degree over an odd window; at the ends that of the first or last window. Too few points come back as they are."""
    y = np.asarray(y, float)
    n = len(y)
    window = min(window, n if n % 2 else n - 1)
    window -= 1 - window % 2
    if window <= degree:
        return y.copy()
    half = window // 2
    i = np.arange(-half, half + 1.0)
    v = np.vander(i, degree + 1, increasing=True)
    hat = v @ np.linalg.pinv(v)
    out = np.convolve(y, hat[half][::-1], mode="same")
    out[:half], out[n - half :] = hat[:half] @ y[:window], hat[half + 1 :] @ y[n - window :]
    return out


def _highpass(cut: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth high-pass, cut as a share of the sampling rate, by the bilinear transform."""
    w = np.tan(np.pi * cut)
    n = 1 + np.sqrt(2) * w + w * w
    return np.array([1.0, -2.0, 1.0]) / n, np.array([n, 2 * (w * w - 1), 1 - np.sqrt(2) * w + w * w]) / n


def _filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form II transposed, begun in the steady state of the first sample."""
    gain = b.sum() / a.sum()
    z1, z2 = (gain - b[0]) * x[0], (b[2] - a[2] * gain) * x[0]
    out = np.empty(len(x))
    b0, b1, b2, a1, a2 = (*b.tolist(), *a[1:].tolist())
    for begin, end in parts(len(x)):
        some = x[begin:end].tolist()
        for i, v in enumerate(some):
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            some[i] = y
        out[begin:end] = some
    return out


def zero_phase(x: np.ndarray, cut: float) -> np.ndarray:
    """The high-pass forth and back over the samples, extended by nine odd reflections at either end."""
    b, a = _highpass(cut)
    pad = min(9, len(x) - 1)
    ext = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    return _filtered(b, a, _filtered(b, a, ext)[::-1])[::-1][pad : pad + len(x)]


def unwrapped(angles: np.ndarray) -> np.ndarray:
    """Angles in degrees without jumps of whole turns, in place."""
    for a, b in parts(len(angles)):
        a = max(0, a - 1)
        angles[a:b] = np.unwrap(angles[a:b], period=360)
    return angles


def filled(z: np.ndarray) -> np.ndarray:
    """Gaps filled linearly by position, ends with the nearest; zeros if nothing is known."""
    z, i = np.asarray(z, float), np.arange(len(z))
    ok = np.isfinite(z)
    if ok.all():
        return z.copy()
    return np.interp(i, i[ok], z[ok]) if ok.any() else np.zeros(len(z))


def roughness(residual: np.ndarray, spacing_m: float, wave_m: float = 30.0) -> np.ndarray:
    """Roughness in inches: RMS over wave_m of what of the residual has wavelengths below wave_m.

    Zeros for fewer than 15 samples; the running deviation where the sampling is too coarse for the filter.
    """
    n = len(residual)
    if n < 15:
        return np.zeros(n)
    r, w = filled(residual), max(3, int(wave_m / spacing_m))
    cut = spacing_m / wave_m
    left = w // 2
    if cut >= 0.5:
        return np.array([np.std(r[max(0, i - left) : i - left + w], ddof=1) if min(n, i - left + w) - max(0, i - left) > 1 else 0.0 for i in range(n)]) * FEET_PER_METER * 12
    high = zero_phase(r, cut)
    out = r
    for a, b in parts(n):
        first, last = max(0, a - left), min(n, b - left + w)
        sq = np.concatenate(([0.0], np.cumsum(high[first:last] ** 2)))
        i = np.arange(a, b) - left
        lo, hi = np.maximum(0, i), np.minimum(n, i + w)
        out[a:b] = np.sqrt((sq[hi - first] - sq[lo - first]) / (hi - lo)) * FEET_PER_METER * 12
    return out
