"""The numerics against plain loops and their defining properties."""

from __future__ import annotations

import math

import numpy as np
import pytest

from talkweave.functions import signal
from talkweave.operators import enhance


def noise(seed: int, *shape: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(size=shape) + 1j * rng.normal(size=shape)


def covariances(seed: int, f: int, d: int) -> np.ndarray:
    x = noise(seed, f, d, 3 * d)
    return x @ x.conj().swapaxes(-1, -2)


def plain_wpe(y, taps, delay, iterations, context):
    d, t = y.shape
    x = y.copy()
    for _ in range(iterations):
        power = [sum(abs(x[c, n]) ** 2 for c in range(d)) / d for n in range(t)]
        if context:
            power = [np.mean([power[m] for m in range(max(0, n - context), min(t, n + context + 1))]) for n in range(t)]
        past = lambda n: np.array([y[c, n - delay - k] if n - delay - k >= 0 else 0 for k in range(taps) for c in range(d)])
        r = sum(np.outer(past(n), past(n).conj()) / power[n] for n in range(t))
        p = sum(np.outer(past(n), y[:, n].conj()) / power[n] for n in range(t))
        g = np.linalg.solve(r, p)
        x = np.stack([y[:, n] - g.conj().T @ past(n) for n in range(t)], 1)
    return x


@pytest.mark.parametrize("context", [0, 2])
def test_wpe(context):
    y = noise(1, 2, 60)
    assert np.allclose(signal.wpe(y, 3, 2, 2, context), plain_wpe(y, 3, 2, 2, context))


def test_wpe_takes_reverberation_out():
    s, h = noise(2, 1500), [noise(3 + k, 6) * 0.5 ** np.arange(6) for k in range(3)]
    y = np.stack([s * x[0] + sum(np.concatenate([np.zeros(k), s[:-k]]) * x[k] for k in range(2, 6)) for x in h])
    dry = np.stack([s * x[0] for x in h])
    error = lambda x: np.mean(np.abs(x - dry) ** 2)
    assert error(signal.wpe(y, 8, 2, 3)) < 0.2 * error(y)


def test_wpe_of_arrays():
    y = noise(4, 2, 2, 50)
    assert np.allclose(signal.wpe_arrays(y, 2, 2, 1), signal.wpe(y.reshape(4, 50), 2, 2, 1).reshape(y.shape))
    assert np.allclose(signal.wpe_arrays(y, 2, 2, 1, stack=False), np.stack([signal.wpe(x, 2, 2, 1) for x in y]))


def plain_masks(y, on, iterations, post):
    """The same EM, a frame and a class at a time."""
    d, t = y.shape
    k = len(on)
    z = y / np.linalg.norm(y, axis=0)
    m = np.where(on > 0, 1, 1e-10) / np.where(on > 0, 1, 1e-10).sum(0)
    q = np.ones((k, t))
    model = None

    def fit(m, q):
        out = []
        for c in range(k):
            b = sum(m[c, n] / q[c, n] * np.outer(z[:, n], z[:, n].conj()) for n in range(t)) * d / m[c].sum()
            out.append((m[c].mean(), b / np.trace(b).real * d + 1e-6 * np.eye(d)))
        return out

    def predict(model, guided):
        p, q = np.zeros((k, t)), np.zeros((k, t))
        for n in range(t):
            for c, (w, b) in enumerate(model):
                q[c, n] = (z[:, n].conj() @ np.linalg.inv(b) @ z[:, n]).real
                p[c, n] = w / np.linalg.det(b).real / q[c, n] ** d * ((1 if on[c, n] else 1e-10) if guided else 1)
        return p / p.sum(0), q

    for i in range(iterations):
        if i:
            m, q = predict(model, True)
        model = fit(m, q)
    for _ in range(post - 1):
        m, q = predict(model, False)
        model = fit(m, q)
    return predict(model, post == 0)[0]


@pytest.mark.parametrize("post", [0, 1, 2])
def test_guided_masks(post):
    rng = np.random.default_rng(5)
    y = noise(6, 3, 80)
    on = np.stack([np.arange(80) < 50, np.arange(80) >= 30, np.ones(80)]).astype(float)
    y[:, :50] += 3 * noise(7, 3)[:, None] * rng.normal(size=50)
    assert np.allclose(signal.guided_masks(y, on, 4, post), plain_masks(y, on, 4, post), atol=1e-5)


def test_masks_find_the_speakers():
    """Two directions that are active in turns and together: masks follow who is louder."""
    d, t = 4, 400
    a, b = noise(8, d), noise(9, d)
    s1, s2 = noise(10, t) * (np.arange(t) < 260), noise(11, t) * (np.arange(t) >= 140)
    y = np.outer(a, s1) + np.outer(b, s2) + 0.05 * noise(12, d, t)
    on = np.stack([np.arange(t) < 260, np.arange(t) >= 140, np.ones(t)]).astype(float)
    m = signal.guided_masks(y, on, 20, 1)
    both = slice(140, 260)
    louder = np.abs(s1[both]) * np.linalg.norm(a) > np.abs(s2[both]) * np.linalg.norm(b)
    assert np.mean((m[0, both] > m[1, both]) == louder) > 0.85


def test_mvdr():
    target, rest = covariances(13, 5, 4), covariances(14, 5, 4)
    phi = [np.linalg.inv(n) @ s for s, n in zip(target, rest)]
    for ref in range(4):
        want = np.stack([(p / abs(np.trace(p)))[:, ref] for p in phi])
        assert np.allclose(signal.mvdr_souden(target, rest, ref), want, rtol=1e-6)
    gain = []
    for ref in range(4):
        w = signal.mvdr_souden(target, rest, ref)
        gain.append(sum((x.conj() @ s @ x).real for x, s in zip(w, target)) / sum((x.conj() @ n @ x).real for x, n in zip(w, rest)))
    assert np.allclose(signal.mvdr_souden(target, rest), signal.mvdr_souden(target, rest, int(np.argmax(gain))))
    v = noise(15, 5, 4)  # one source: what it is at the reference stays
    w = signal.mvdr_souden(np.einsum("fd,fe->fde", v, v.conj()), rest, 2)
    assert np.allclose(np.einsum("fd,fd->f", w.conj(), v), v[:, 2], rtol=1e-6)


def test_gev():
    target, rest = covariances(16, 6, 3), covariances(17, 6, 3)
    w = signal.gev(target, rest)
    for x, s, n in zip(w, target, rest):
        best = max(np.linalg.eigvals(np.linalg.solve(n, s)).real)
        assert math.isclose((x.conj() @ s @ x).real / (x.conj() @ n @ x).real, best, rel_tol=1e-5)


def test_lcmv():
    rest, steering, response = covariances(18, 4, 5), noise(19, 2, 4, 5), np.array([1.0, 0.0])
    w = signal.lcmv(steering, response, rest)
    assert np.allclose(np.einsum("fd,kfd->kf", w.conj(), steering), response[:, None], atol=1e-9)
    rng = np.random.default_rng(20)
    for f in range(4):
        free = np.linalg.svd(steering[:, f].conj())[2][2:].conj()  # directions that keep both constraints
        for _ in range(20):
            other = w[f] + (rng.normal(size=3) + 1j * rng.normal(size=3)) @ free * 0.1
            assert np.allclose(other.conj() @ steering[:, f].T, response, atol=1e-9)
            assert (other.conj() @ rest[f] @ other).real >= (w[f].conj() @ rest[f] @ w[f]).real


def test_ban():
    w, rest = noise(21, 4, 3), covariances(22, 4, 3)
    for x, y, n in zip(signal.normalise_ban(w, rest), w, rest):
        scale = math.sqrt(abs(y.conj() @ n @ n @ y) / 3) / abs(y.conj() @ n @ y)
        assert np.allclose(x, y * scale)


def test_power_masks():
    power = np.random.default_rng(23).random((30, 4)) ** 3
    on = signal.lorenz_mask(power, 0.9) > 0.5
    assert set(np.round(np.unique(signal.lorenz_mask(power, 0.9)), 4)) == {0.0005, 0.9995}
    held = power[on].sum() / power.sum()
    assert held <= 0.9 < held + np.sort(power[~on])[-2:].sum() / power.sum() and power[on].min() > power[~on].max()
    for q in (0.2, -0.3):
        on = signal.quantile_mask(power, q) > 0.5
        for f in range(4):
            cut = np.quantile(power[:, f], 0.8 if q > 0 else 0.3)
            assert (on[:, f] == (power[:, f] > cut if q > 0 else power[:, f] < cut)).all()


@pytest.mark.parametrize("kind", ["mvdrSouden", "mvdrSouden_ban", "gev", "gev_ban", "lcmv"])
def test_beamformers_lift_the_target(kind):
    d, t, f = 4, 300, 3
    v, u = noise(24, f, d), noise(25, f, d)
    on = np.arange(t) < 150
    s, n = np.einsum("fd,tf->dtf", v, noise(26, t, f) * on[:, None]), np.einsum("fd,tf->dtf", u, noise(27, t, f)) + 0.1 * noise(28, d, t, f)
    mask = np.repeat(on[:, None], f, 1).astype(float)
    out = signal.beamform(s + n, mask, 1 - mask, kind)
    ratio = lambda x, at: (np.abs(x[at]) ** 2).mean()
    before = (np.abs(s[0, on]) ** 2).mean() / (np.abs(n[0]) ** 2).mean()
    assert ratio(out, on) / ratio(out, ~on) > 5 * before
    assert np.allclose(signal.beamform(s + n, np.stack([mask] * d), np.stack([1 - mask] * d), kind), out)  # masks of channels: their median
    assert np.allclose(signal.beamform(s + n, mask, 1 - mask, kind, "mask_mul"), out * mask)


def test_beamform_by_power():
    y = noise(29, 3, 100, 2)
    y[:, :20] += 8 * noise(30, 3, 1, 2)
    lorenz = np.stack([signal.lorenz_mask(np.abs(x) ** 2) for x in y])
    assert np.allclose(signal.beamform_by_power(y), signal.beamform(y, lorenz, 1 - lorenz, "mvdrSouden"))
    strong, weak = (np.stack([signal.quantile_mask(np.abs(x) ** 2, q) for x in y]) for q in (0.1, -0.1))
    assert np.allclose(signal.beamform_by_power(y, "quantile", "gev"), signal.beamform(y, strong, weak, "gev"))
    with pytest.raises(ValueError, match="no mask"):
        signal.beamform_by_power(y, "other")


def test_stack_arrays():
    a, b = np.arange(12.0).reshape(3, 4), np.arange(10.0).reshape(2, 5)
    assert signal.stack_arrays([a, b]).shape == (5, 4)
    assert np.array_equal(signal.stack_arrays([a, b], "outer_array_mics"), np.concatenate([a[[0, 2]], b[:, :4]]))
    assert np.array_equal(signal.stack_arrays([a, b], "first_array_mics"), np.stack([a[0], b[0, :4]]))


def test_chain_with_default_parameters(spark):
    """Spark's rows give the samples of the chain written out in numpy, at the default sizes and iterations."""
    rng, config = np.random.default_rng(31), enhance.Config(wpe_taps=2)
    n = 6000
    x = rng.normal(size=(3, n)) * np.linspace(0.2, 1, n)
    spans = {0: (1500, 4200), 1: (0, 2500), 2: (0, n)}
    channels = spark.createDataFrame([("u", k, x[k].tolist()) for k in range(3)], "utt string, channel int, samples array<double>")
    activity = spark.createDataFrame([("u", k, *s) for k, s in spans.items()], "utt string, class_idx int, start bigint, end bigint")
    targets = spark.createDataFrame([("u", 0, 1500, 2700)], "utt string, class_idx int, context_start bigint, num_samples bigint")
    (got,) = enhance.enhance(channels, activity, activity.select("utt", "class_idx"), targets, config).collect()
    y = signal.stft(x, config.stft_size, config.stft_shift)
    frames = y.shape[1]
    pad = config.stft_size - config.stft_shift
    on = np.array([[any(lo < i * config.stft_shift - pad + config.stft_size and i * config.stft_shift - pad < hi for lo, hi in [s]) for i in range(frames)] for s in spans.values()], float)
    y = np.stack([signal.wpe(y[..., f], 2, config.wpe_delay, config.wpe_iterations, config.wpe_psd_context) for f in range(y.shape[-1])], -1)
    m = np.stack([signal.guided_masks(y[..., f], on, config.em_iterations, config.em_iterations_post) for f in range(y.shape[-1])], -1)
    inside = [i for i in range(frames) if i * config.stft_shift - pad + config.stft_size > 1500 and i * config.stft_shift - pad < 4200]
    m[:, [i for i in range(frames) if i not in inside]] = 0
    want = signal.istft(signal.beamform(y, m[0], m[1] + m[2]), config.stft_size, config.stft_shift, True, n)[1500:4200]
    assert len(got.samples) == 2700 and np.allclose(got.samples, want, atol=1e-6 * np.abs(want).max())
