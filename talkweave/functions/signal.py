"""Array signal processing in numpy, for use inside grouped maps.

Axes: d channel, t frame, f frequency, k class.  Formulas follow the published
papers: weighted prediction error dereverberation, complex angular central
Gaussian mixtures guided by activity, the MVDR beamformer without steering
vector, the generalised eigenvalue beamformer, and blind analytic
normalisation.
"""

from __future__ import annotations

import numpy as np

EPS = 1e-10


def window(size: int) -> np.ndarray:
    """Periodic Blackman window."""
    n = np.arange(size) / size
    return 0.42 - 0.5 * np.cos(2 * np.pi * n) + 0.08 * np.cos(4 * np.pi * n)


def stft(x: np.ndarray, size: int = 1024, shift: int = 256, fading: bool = True) -> np.ndarray:
    """(..., t, f) of (..., sample); with ``fading`` the signal is padded by size - shift on both sides."""
    pad = [(0, 0)] * (x.ndim - 1)
    if fading:
        x = np.pad(x, [*pad, (size - shift, size - shift)])
    n = x.shape[-1]
    frames = 1 if n <= size else -(-(n - size) // shift) + 1
    x = np.pad(x, [*pad, (0, max(0, (frames - 1) * shift + size - n))])
    at = np.arange(frames)[:, None] * shift + np.arange(size)
    return np.fft.rfft(x[..., at] * window(size))


def istft(spectrum: np.ndarray, size: int = 1024, shift: int = 256, fading: bool = True, samples: int | None = None) -> np.ndarray:
    """Inverse by overlap-add with the synthesis window that makes the pair exact."""
    w = window(size)
    norm = np.zeros(size)
    for k in range(-(size // shift), size // shift + 1):
        lo, hi = max(0, k * shift), min(size, size + k * shift)
        norm[lo:hi] += w[lo - k * shift : hi - k * shift] ** 2
    frames = np.fft.irfft(spectrum, size) * (w / np.maximum(norm, EPS))
    t = frames.shape[-2]
    out = np.zeros((*frames.shape[:-2], (t - 1) * shift + size))
    for k in range(t):
        out[..., k * shift : k * shift + size] += frames[..., k, :]
    if fading:
        out = out[..., size - shift : out.shape[-1] - (size - shift)]
    return out if samples is None else out[..., :samples]


def stable_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Batched solve; where a matrix is singular, that one by least squares."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        pass
    a2, b2 = a.reshape(-1, *a.shape[-2:]), b.reshape(-1, *b.shape[-2:])
    out = np.empty(b2.shape, np.result_type(a, b))
    for i, (x, y) in enumerate(zip(a2, b2)):
        try:
            out[i] = np.linalg.solve(x, y)
        except np.linalg.LinAlgError:
            out[i] = np.linalg.lstsq(x, y, rcond=None)[0]
    return out.reshape(b.shape)


def wpe(y: np.ndarray, taps: int = 10, delay: int = 2, iterations: int = 3, psd_context: int = 0) -> np.ndarray:
    """Dereverberated (d, t) of one frequency."""
    d, t = y.shape
    delayed = np.zeros((taps * d, t), y.dtype)
    for k in range(taps):
        lag = delay + k
        if lag < t:
            delayed[k * d : (k + 1) * d, lag:] = y[:, : t - lag]
    x = y
    for _ in range(iterations):
        power = (np.abs(x) ** 2).mean(0)
        if psd_context:
            kernel = np.ones(2 * psd_context + 1)
            power = np.convolve(power, kernel, "same") / np.convolve(np.ones(t), kernel, "same")
        inverse = 1 / np.maximum(power, EPS * max(power.max(), EPS))
        weighted = delayed * inverse
        g = stable_solve((weighted @ delayed.conj().T)[None], (weighted @ y.conj().T)[None])[0]
        x = y - g.conj().T @ delayed
    return x


def wpe_arrays(y: np.ndarray, taps: int = 10, delay: int = 2, iterations: int = 3, psd_context: int = 0, stack: bool = True) -> np.ndarray:
    """Dereverberated (a, d, t) of several arrays at one frequency: all channels together (``stack``) or each array by itself."""
    if stack:
        return wpe(y.reshape(-1, y.shape[-1]), taps, delay, iterations, psd_context).reshape(y.shape)
    return np.stack([wpe(x, taps, delay, iterations, psd_context) for x in y])


def initial_masks(activity: np.ndarray) -> np.ndarray:
    """(k, t) activity as start of the EM: no zeros, classes sum to one."""
    m = np.where(activity > 0, 1.0, 1e-10)
    return m / m.sum(0)


class AngularMixture:
    """A complex angular central Gaussian mixture at one frequency."""

    def __init__(self, weight: np.ndarray, shape: np.ndarray):
        self.weight, self.shape = weight, shape

    @staticmethod
    def quadratic(z: np.ndarray, shape: np.ndarray) -> np.ndarray:
        inner = np.einsum("dt,kdt->kt", z.conj(), stable_solve(shape, np.broadcast_to(z, (len(shape), *z.shape)))).real
        return np.maximum(inner, EPS)

    @classmethod
    def fit(cls, z: np.ndarray, masks: np.ndarray, quadratic: np.ndarray) -> AngularMixture:
        d = len(z)
        total = np.maximum(masks.sum(1), EPS)
        shape = d * np.einsum("kt,dt,et->kde", masks / quadratic, z, z.conj()) / total[:, None, None]
        shape = (shape + shape.conj().swapaxes(-1, -2)) / 2
        trace = np.maximum(np.trace(shape, axis1=-2, axis2=-1).real, EPS)
        shape = shape / trace[:, None, None] * d + 1e-6 * np.eye(d)
        return cls(masks.mean(1), shape)

    def predict(self, z: np.ndarray, activity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(k, t) masks and the quadratic forms; classes that aren't active get nothing."""
        q = self.quadratic(z, self.shape)
        log = np.log(np.maximum(self.weight, EPS))[:, None] - np.linalg.slogdet(self.shape)[1][:, None] - len(z) * np.log(q)
        p = np.exp(log - log.max(0))
        if activity is not None:
            p = p * np.where(activity > 0, 1.0, 1e-10)
        return p / np.maximum(p.sum(0), EPS), q


def guided_masks(y: np.ndarray, activity: np.ndarray, iterations: int = 20, iterations_post: int = 1) -> np.ndarray:
    """(k, t) masks of (d, t) at one frequency by EM guided by activity.

    ``iterations_post``: 0 predicts with the activity, 1 without, n > 1 after n - 1 more unguided steps.
    """
    z = y / np.maximum(np.linalg.norm(y, axis=0), EPS)
    masks, q = initial_masks(activity), np.ones(activity.shape)
    mixture = None
    for k in range(iterations):
        if k:
            masks, q = mixture.predict(z, activity)
        mixture = AngularMixture.fit(z, masks, q)
    for _ in range(iterations_post - 1):
        masks, q = mixture.predict(z)
        mixture = AngularMixture.fit(z, masks, q)
    return mixture.predict(z, activity if iterations_post == 0 else None)[0]


def covariance(y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(d, d): mask-weighted, normalised by the mask's sum."""
    return (mask * y) @ y.conj().T / max(mask.sum(), EPS)


def mvdr_souden(target: np.ndarray, noise: np.ndarray, reference: int | None = None) -> np.ndarray:
    """Weights (f, d) from (f, d, d) covariances; the reference channel of best output SNR over all frequencies unless given."""
    d = target.shape[-1]
    noise = noise + 1e-10 * np.trace(noise, axis1=-2, axis2=-1).real[:, None, None] * np.eye(d) / d
    phi = stable_solve(noise, target)
    w = phi / np.maximum(np.abs(np.trace(phi, axis1=-2, axis2=-1)), EPS)[:, None, None]
    if reference is None:
        gain = np.einsum("fdc,fde,fec->c", w.conj(), target, w).real
        reference = int(np.argmax(gain / np.maximum(np.einsum("fdc,fde,fec->c", w.conj(), noise, w).real, EPS)))
    return w[..., reference]


def gev(target: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Weights of greatest SNR: the principal generalised eigenvector of each frequency."""
    d = target.shape[-1]
    root = np.linalg.cholesky(noise + 1e-8 * (np.trace(noise, axis1=-2, axis2=-1).real[:, None, None] / d + EPS) * np.eye(d))
    inverse = np.linalg.inv(root)
    _, v = np.linalg.eigh(inverse @ target @ inverse.conj().swapaxes(-1, -2))
    return np.einsum("fed,fe->fd", inverse.conj(), v[..., -1])


def lcmv(steering: np.ndarray, response: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Weights that give (k, f, d) steering vectors the responses (k,)."""
    c = steering.transpose(1, 2, 0)
    x = stable_solve(noise, c)
    inner = c.conj().swapaxes(-1, -2) @ x
    return (x @ stable_solve(inner, np.broadcast_to(response[:, None], (len(c), len(response), 1)).astype(complex)))[..., 0]


def principal(target: np.ndarray) -> np.ndarray:
    """Steering vectors: the principal eigenvector of each covariance."""
    return np.linalg.eigh(target)[1][..., -1]


def normalise_ban(w: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Blind analytic normalisation of weights (f, d)."""
    a = np.einsum("fd,fde,feg,fg->f", w.conj(), noise, noise, w)
    b = np.einsum("fd,fde,fe->f", w.conj(), noise, w)
    return w * (np.sqrt(np.abs(a) / w.shape[-1]) / np.maximum(np.abs(b), EPS))[:, None]


def lorenz_mask(power: np.ndarray, fraction: float = 0.98, weight: float = 0.999) -> np.ndarray:
    """Soft mask of the strongest bins that hold ``fraction`` of the power."""
    flat = np.sort(power.reshape(-1))[::-1]
    k = int(np.searchsorted(np.cumsum(flat), fraction * flat.sum()))
    on = power > flat[min(k, len(flat) - 1)]
    return 0.5 + weight * (on - 0.5)


def quantile_mask(power: np.ndarray, quantile: float = 0.1, weight: float = 0.999) -> np.ndarray:
    """Soft mask of each frequency's frames above (or for a negative quantile below) a quantile."""
    cut = np.quantile(power, 1 - quantile if quantile >= 0 else -quantile, axis=0, keepdims=True)
    on = power > cut if quantile >= 0 else power < cut
    return 0.5 + weight * (on - 0.5)


def beamform(y: np.ndarray, target_mask: np.ndarray, noise_mask: np.ndarray, kind: str = "mvdrSouden_ban", postfilter: str | None = None) -> np.ndarray:
    """(t, f) of (d, t, f): kinds mvdrSouden, mvdrSouden_ban, gev, gev_ban, lcmv, ch<n>, sum; postfilter None or mask_mul.

    Masks are (t, f), or (d, t, f), which their median over channels reduces.
    """
    d = len(y)
    if d >= 30:
        raise ValueError(f"{d} channels")
    target_mask, noise_mask = (np.median(m, 0) if m.ndim == 3 else m for m in (target_mask, noise_mask))
    if kind == "sum":
        out = y.sum(0)
    elif kind.startswith("ch") and kind[2:].isdigit():
        out = y[int(kind[2:])]
    else:
        name, _, post = kind.partition("_")
        if name not in ("mvdrSouden", "gev", "lcmv") or post not in ("", "ban"):
            raise ValueError(f"no beamformer {kind!r}")
        of = lambda m: np.stack([covariance(y[..., f], m[:, f]) for f in range(y.shape[-1])])
        target, noise = of(target_mask), of(noise_mask)
        if name == "lcmv":
            w = lcmv(np.stack([principal(target), principal(noise)]), np.array([1.0, 0.0]), noise + EPS * np.eye(d))
        else:
            w = mvdr_souden(target, noise) if name == "mvdrSouden" else gev(target, noise)
        w = normalise_ban(w, noise) if post else w
        out = np.einsum("fd,dtf->tf", w.conj(), y)
    if postfilter not in (None, "mask_mul"):
        raise ValueError(f"no postfilter {postfilter!r}")
    return out * target_mask if postfilter else out


def beamform_by_power(y: np.ndarray, mask: str = "lorenz", kind: str = "mvdrSouden", **options: float) -> np.ndarray:
    """(t, f) of (d, t, f) with masks from the power alone: ``lorenz`` (its complement is the noise's) or ``quantile`` (the strongest frames and the weakest)."""
    power = np.abs(y) ** 2
    if mask == "lorenz":
        target = np.stack([lorenz_mask(p, **options) for p in power])
        return beamform(y, target, 1 - target, kind)
    if mask != "quantile":
        raise ValueError(f"no mask {mask!r}")
    quantile = options.pop("quantile", 0.1)
    return beamform(y, *(np.stack([quantile_mask(p, q, **options) for p in power]) for q in (quantile, -quantile)), kind)


def pair_masks(masks: np.ndarray, own: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Target (t, f) and distortion (sum of the others) of (k, t, f); frames outside ``[first, last)`` are zero."""
    masks = masks.copy()
    masks[:, :first] = 0
    if last is not None:
        masks[:, last:] = 0
    return masks[own], np.delete(masks, own, 0).sum(0)


def stack_arrays(arrays: list[np.ndarray], which: str | bool = True) -> np.ndarray:
    """(d, sample) of several arrays' (d_i, sample_i): all, outer or first microphones, cut to the shortest."""
    pick = {True: lambda a: a, "outer_array_mics": lambda a: a[[0, -1]], "first_array_mics": lambda a: a[:1]}[which]
    n = min(a.shape[-1] for a in arrays)
    return np.concatenate([pick(a)[..., :n] for a in arrays])
