"""NumPy kernels that run inside pandas UDFs and grouped maps: spectra, filters, spatial patterns, small solvers."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def welch(x: np.ndarray, sfreq: float, nperseg: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and power spectral density along the last axis.

    Segments overlap by half, lose their mean, take a Hann window, and are averaged; one-sided, per Hz.
    """
    nperseg = min(nperseg, x.shape[-1])
    step = nperseg - nperseg // 2
    w = hann(nperseg)
    seg = np.lib.stride_tricks.sliding_window_view(x, nperseg, axis=-1)[..., ::step, :]
    seg = (seg - seg.mean(axis=-1, keepdims=True)) * w
    p = np.abs(np.fft.rfft(seg, axis=-1)) ** 2 / (sfreq * (w**2).sum())
    p[..., 1 : -1 if nperseg % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(nperseg, 1 / sfreq), p.mean(axis=-2)


def band_integral(freqs: np.ndarray, psd: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """The trapezoid over the bins from lo to below hi; a single bin integrates to 0."""
    own = (freqs >= lo) & (freqs < hi)
    return np.trapezoid(psd[..., own], freqs[own], axis=-1)


def butter_bandpass(lo: float, hi: float, sfreq: float, order: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a digital Butterworth band-pass, by the bilinear transform of the analogue prototype."""
    if not 0 < lo < hi < sfreq / 2:
        raise ValueError("a pass band lies between 0 and half the sampling rate")
    warp = 2 * sfreq * np.tan(np.pi * np.array([lo, hi]) / sfreq)
    width, centre = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre**2)
    poles = np.concatenate([poles + root, poles - root])
    fs2 = 2 * sfreq
    gain = (width**order * fs2**order / np.prod(fs2 - poles)).real
    zeros = np.concatenate([np.ones(order), -np.ones(order)])
    return gain * np.poly(zeros).real, np.poly((fs2 + poles) / (fs2 - poles)).real


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed along the last axis; rows side by side."""
    out, z = np.empty_like(x), state.copy()
    for t in range(x.shape[-1]):
        now = x[..., t]
        y = b[0] * now + z[0]
        for k in range(len(z) - 1):
            z[k] = b[k + 1] * now + z[k + 1] - a[k + 1] * y
        z[-1] = b[-1] * now - a[-1] * y
        out[..., t] = y
    return out


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering: forwards and backwards, with odd extension by three filter lengths and settled states."""
    pad = 3 * max(len(a), len(b))
    if x.shape[-1] <= pad:
        raise ValueError(f"more than {pad} samples are needed")
    left, right = 2 * x[..., :1] - x[..., pad:0:-1], 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    ext = np.concatenate([left, x, right], axis=-1)
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:] / a[0]
    companion[1:, :-1] += np.eye(n - 1)
    settled = np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])
    shape = (n, *([1] * (x.ndim - 1)))
    y = _filter(b, a, ext, settled.reshape(shape) * ext[..., 0])
    y = _filter(b, a, y[..., ::-1], settled.reshape(shape) * y[..., -1])[..., ::-1]
    return y[..., pad:-pad]


def csp(x: np.ndarray, y: np.ndarray, components: int) -> np.ndarray:
    """Spatial filters (components, channels) that part two classes' variances; x: (epochs, channels, times)."""
    cov = []
    for c in (0, 1):
        own = np.concatenate(list(x[y == c]), axis=1)
        own = own - own.mean(axis=1, keepdims=True)
        cov.append(own @ own.T / own.shape[1])
    return spatial_filters(cov[0], cov[1], components)


def spatial_filters(first: np.ndarray, second: np.ndarray, components: int) -> np.ndarray:
    """The same from the classes' covariances: a generalised eigenproblem, solved in the whitened space of their sum."""
    vals, vecs = np.linalg.eigh(first + second)
    keep = vals > vals.max() * 1e-10
    white = vecs[:, keep] / np.sqrt(vals[keep])
    share, rot = np.linalg.eigh(white.T @ first @ white)
    order = np.argsort(-np.abs(share - 0.5), kind="stable")[:components]
    return (white @ rot[:, order]).T


def log_variance(filters: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log of the mean power of each component, a row an epoch."""
    return np.log(((filters @ x) ** 2).mean(axis=-1))


def lda(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of the discriminant with pooled covariance; the log-odds of class 1 are x @ w + b."""
    m = np.stack([x[y == c].mean(axis=0) for c in (0, 1)])
    prior = np.array([(y == c).mean() for c in (0, 1)])
    within = sum((x[y == c] - m[c]).T @ (x[y == c] - m[c]) for c in (0, 1)) / max(1, len(y) - 2)
    w = np.linalg.lstsq(within, m[1] - m[0], rcond=None)[0]
    return w, float(-w @ m.mean(axis=0) + np.log(prior[1] / prior[0]))


def sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -500, 500)))


def scale(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation; a constant column is divided by 1."""
    sd = train.std(axis=0)
    return train.mean(axis=0), np.where(sd > 0, sd, 1.0)


def logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, balanced: bool = True, rounds: int = 100) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression by Newton steps; the offset isn't penalised."""
    n, p = x.shape
    weight = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum()))) if balanced else np.ones(n)
    a = np.hstack([x, np.ones((n, 1))])
    pen = np.append(np.full(p, 1 / c), 0.0)
    beta = np.zeros(p + 1)

    def loss(b: np.ndarray) -> float:
        s = a @ b
        return float((weight * (np.logaddexp(0, s) - y * s)).sum() + (pen * b**2).sum() / 2)

    now = loss(beta)
    for _ in range(rounds):
        q = sigmoid(a @ beta)
        grad = a.T @ (weight * (q - y)) + pen * beta
        hess = (a * (weight * q * (1 - q))[:, None]).T @ a + np.diag(pen) + 1e-12 * np.eye(p + 1)
        move, size = np.linalg.solve(hess, grad), 1.0
        while loss(beta - size * move) > now and size > 1e-8:
            size /= 2
        beta = beta - size * move
        before, now = now, loss(beta)
        if np.abs(size * move).max() < 1e-10 or abs(before - now) < 1e-14:
            break
    return beta[:-1], float(beta[-1])


#: Rows whose kernel is held at once: a fold of more is solved in sets of so many. Rows of a block, its least violation
#: of the conditions that hold at the best weights (LIBSVM's default), and sweeps over a set.
SET, ROWS, SLACK, SWEEPS = 2048, 256, 1e-3, 60


def _with_norms(x: np.ndarray, gamma: float, first: bool) -> np.ndarray:
    """Columns whose products with those of the other side are -gamma times the squared distances."""
    own, one = -gamma * (x**2).sum(axis=1), np.ones(len(x))
    return np.column_stack([x * (2 * gamma if first else 1.0), *((own, one) if first else (one, own))])


def _gauss(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The Gaussian kernel with a bias inside it, of two sides that _with_norms gave."""
    k = left @ right.T
    np.exp(np.minimum(k, 0, out=k), out=k)
    k += 1.0
    return k


def _ascend(k: np.ndarray, s: np.ndarray, box: np.ndarray, alpha: np.ndarray, f: np.ndarray, rounds: int, least: float) -> None:
    """Coordinate ascent on the dual, in place, until a sweep moves no weight by `least`."""
    for _ in range(rounds):
        most = 0.0
        for i in range(len(s)):
            new = min(max(alpha[i] + (1 - s[i] * f[i]) / k[i, i], 0.0), box[i])
            if new != alpha[i]:
                f += (new - alpha[i]) * s[i] * k[i]
                most, alpha[i] = max(most, abs(new - alpha[i])), new
        if most < least:
            break


def rbf_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, balanced: bool = True, rounds: int = 2000) -> dict:
    """A kernel machine by dual coordinate ascent on the Gaussian kernel with a bias inside it, and a sigmoid on its scores.

    Above SET rows the ascent goes over sets of rows: those that are off their conditions, drawn at random, with the free
    ones first. The kernel is made anew from the features where it is needed, so memory grows with the rows alone, not
    with their square; time is that of a few passes over all pairs.
    """
    gamma = 1 / (x.shape[1] * max(x.var(), 1e-12))
    n, s = len(y), 2.0 * y - 1
    box = c * (np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum()))) if balanced else np.ones(n))
    left, right = _with_norms(x, gamma, True), _with_norms(x, gamma, False)
    alpha, f = np.zeros(n), np.zeros(n)
    if n <= SET:
        _ascend(_gauss(left, right), s, box, alpha, f, rounds, 1e-6)
    rng = np.random.default_rng(0)
    for _ in range(rounds * -(-n // SET) if n > SET else 0):
        slope = 1 - s * f
        off = np.where(alpha <= 0, np.maximum(slope, 0), np.where(alpha >= box, np.maximum(-slope, 0), np.abs(slope)))
        if off.max() < SLACK:
            break
        inside = (alpha > 0) & (alpha < box)
        free, bound = np.flatnonzero(inside & (off > SLACK / 10)), np.flatnonzero(~inside & (off > SLACK))
        free = rng.permutation(free)[: SET // 2]
        own = np.sort(np.concatenate([free, rng.permutation(bound)[: SET - len(free)]]))
        some, there = alpha[own], f[own]
        _ascend(_gauss(left[own], right[own]), s[own], box[own], some, there, SWEEPS, SLACK / 10)
        move = (some - alpha[own]) * s[own]
        alpha[own] = some
        _add_scores(f, left, right[own[move != 0]], move[move != 0])
    w, b = logistic(f[:, None], y, c=1e3, balanced=False)
    return {"x": x, "a": alpha * s, "gamma": gamma, "w": float(w[0]), "b": b}


def _add_scores(f: np.ndarray, left: np.ndarray, right: np.ndarray, weights: np.ndarray) -> None:
    for at in range(0, len(f), ROWS):
        f[at : at + ROWS] += _gauss(left[at : at + ROWS], right) @ weights


def svm_score(m: dict, x: np.ndarray) -> np.ndarray:
    out, held = np.zeros(len(x)), np.flatnonzero(m["a"])
    left = _with_norms(x, m["gamma"], True)
    for at in range(0, len(held), SET):
        own = held[at : at + SET]
        _add_scores(out, left, _with_norms(m["x"][own], m["gamma"], False), m["a"][own])
    return out
