"""Enhancement of utterances: the signal chain as grouped maps.

Rows in: one a channel of an utterance, (utt, channel, samples), and the
activity of every class of the utterance as sample intervals relative to its
start, (utt, class_idx, start, end).  Spark has no complex type: spectra travel
as interleaved real and imaginary parts, one row a (utt, frequency), so that
the EM of one frequency is one small group and all frequencies run in parallel.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkweave.functions import signal

from . import catalog
from . import sessions as ss


@dataclass(frozen=True)
class Config:
    """Parameters and their defaults; ``context_samples``, ``multiarray`` and ``noise_class`` are for the preparation of the rows."""

    context_samples: int = 240000
    wpe: bool = True
    wpe_taps: int = 10
    wpe_delay: int = 2
    wpe_iterations: int = 3
    wpe_psd_context: int = 0
    noise_class: bool | int | None = True
    stft_size: int = 1024
    stft_shift: int = 256
    stft_fading: bool = True
    em_iterations: int = 20
    em_iterations_post: int = 1
    drop_context: bool = True
    beamformer: str = "mvdrSouden_ban"
    postfilter: str | None = None
    multiarray: bool | str = True


DIARISED = Config(multiarray="outer_array_mics")
SPECTRUM = "utt string, f int, n_samples bigint, d int, t int, spectrum array<double>"


def _one_thread() -> None:
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(name, "1")


def interleave(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.complex128).view(np.float64).reshape(-1)


def complex_of(x: list[float], *shape: int) -> np.ndarray:
    return np.asarray(x, np.float64).view(np.complex128).reshape(shape)


def spectra(channels: DataFrame, config: Config = Config()) -> DataFrame:
    """One row a (utt, frequency) with the (d, t) spectrum; channels are cut to the shortest."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("channel")
        n = min(len(x) for x in group["samples"])
        y = signal.stft(np.stack([np.asarray(x[:n], float) for x in group["samples"]]), config.stft_size, config.stft_shift, config.stft_fading)
        d, t, bins = y.shape
        return pd.DataFrame({"utt": group["utt"].iloc[0], "f": range(bins), "n_samples": n, "d": d, "t": t, "spectrum": [interleave(y[..., f]) for f in range(bins)]})

    return channels.select(F.col("utt").cast("string").alias("utt"), "channel", "samples").groupBy("utt").applyInPandas(one, SPECTRUM)


def dereverberate(spectrum: DataFrame, config: Config = Config()) -> DataFrame:
    """The same rows after WPE; no group is needed, as a row holds a frequency."""

    def run(batches):  # noqa: ANN001, ANN202
        _one_thread()
        for b in batches:
            b["spectrum"] = [interleave(signal.wpe(complex_of(s, d, t), config.wpe_taps, config.wpe_delay, config.wpe_iterations, config.wpe_psd_context)) for s, d, t in zip(b["spectrum"], b["d"], b["t"])]
            yield b

    return spectrum.mapInPandas(run, SPECTRUM)


def activity_frames(activity: DataFrame, config: Config = Config()) -> DataFrame:
    """(utt, class_idx, spans): each class's active frames as disjoint ranges; densified only inside the grouped map."""
    from . import frames

    ranges = frames.frame_ranges(activity, ["utt", "class_idx"], config.stft_size, config.stft_shift, config.stft_fading)
    return ranges.groupBy(F.col("utt").cast("string").alias("utt"), "class_idx").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def masks(spectrum: DataFrame, activity: DataFrame, classes: DataFrame, config: Config = Config()) -> DataFrame:
    """(utt, f, k, t, masks): EM masks of every frequency, guided by the classes' activity. ``classes``: (utt, class_idx); one without activity is always off."""
    spans = activity_frames(activity, config)
    per = classes.select(F.col("utt").cast("string").alias("utt"), "class_idx").join(spans, ["utt", "class_idx"], "left")
    per = per.groupBy("utt").agg(F.sort_array(F.collect_list(F.struct("class_idx", "spans"))).alias("classes"))

    def run(batches):  # noqa: ANN001, ANN202
        _one_thread()
        for b in batches:
            rows = []
            for utt, f, d, t, s, found in zip(b["utt"], b["f"], b["d"], b["t"], b["spectrum"], b["classes"]):
                on = np.zeros((len(found), t))
                for k, c in enumerate(found):
                    for span in c["spans"] if c["spans"] is not None else ():
                        on[k, span["start"] : span["end"]] = 1
                m = signal.guided_masks(complex_of(s, d, t), on, config.em_iterations, config.em_iterations_post)
                rows.append((utt, f, len(found), t, m.reshape(-1)))
            yield pd.DataFrame(rows, columns=["utt", "f", "k", "t", "masks"])

    return spectrum.join(per, "utt").select("utt", "f", "d", "t", "spectrum", "classes").mapInPandas(run, "utt string, f int, k int, t int, masks array<double>")


def enhance(channels: DataFrame, activity: DataFrame, classes: DataFrame, targets: DataFrame, config: Config = Config()) -> DataFrame:
    """(utt, samples): the enhanced signal of every utterance.

    ``targets``: (utt, class_idx, context_start, num_samples): the class to keep, and what of the signal is the
    utterance itself (for ``drop_context``). Where the audio ends before the utterance does, the rest is silence.
    """
    y = spectra(channels, config)
    y = dereverberate(y, config) if config.wpe else y
    m = masks(y, activity, classes, config)
    both = y.join(m.drop("t"), ["utt", "f"]).join(targets.select(F.col("utt").cast("string").alias("utt"), "class_idx", "context_start", "num_samples"), "utt")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        _one_thread()
        group = group.sort_values("f")
        r = group.iloc[0]
        d, t, k = int(r["d"]), int(r["t"]), int(r["k"])
        y = np.stack([complex_of(s, d, t) for s in group["spectrum"]], -1)
        m = np.stack([np.asarray(x).reshape(k, t) for x in group["masks"]], -1)
        lo, n = int(r["context_start"]), int(r["num_samples"])
        pad = config.stft_size - config.stft_shift if config.stft_fading else 0
        frame = lambda x: max(0, (x + pad - config.stft_size) // config.stft_shift + 1)
        first, last = (frame(lo), (lo + n + pad - 1) // config.stft_shift + 1) if config.drop_context else (0, None)
        target, noise = signal.pair_masks(m, int(r["class_idx"]), first, last)
        out = signal.istft(signal.beamform(y, target, noise, config.beamformer, config.postfilter), config.stft_size, config.stft_shift, config.stft_fading, int(r["n_samples"]))
        if config.drop_context:
            out = out[lo : lo + n]
            out = np.concatenate([out, np.zeros(n - len(out))])
        return pd.DataFrame({"utt": [r["utt"]], "samples": [np.ascontiguousarray(out)]})

    return both.groupBy("utt").applyInPandas(one, "utt string, samples array<double>")


def enhance_sessions(
    of: catalog.Catalog, sessions: str | Sequence[str], files: DataFrame, arrays: DataFrame, speakers: DataFrame, lengths: DataFrame, config: Config = Config(),
    reference: str | None = None, alignment: DataFrame | None = None, active: DataFrame | None = None,
) -> DataFrame:
    """(utt, samples) of every example of the sessions, from the catalog and wav files (path, content) on.

    Rows are prepared with adjusted times and ``config.context_samples`` of context, channels are those that
    ``config.multiarray`` chooses, and the activity is that on the clock of each row's reference array (or ``reference``)
    with ``config.noise_class``. Dimensions as in ``sessions``. Rows on a single clock aren't adjusted, ``arrays`` and
    ``lengths`` count for nothing with them, and diarised ones (without transcription) need ``active``.
    """
    every = of.get_datasets(sessions)
    multi, told = dict(every.dtypes)["start"].startswith("struct"), "transcription" in every.columns
    rows = ss.session_rows(of, sessions, drop_unknown=told, adjust_times=multi, context_samples=config.context_samples)
    heard = ss.session_audio(rows, files).withColumnRenamed("example_id", "utt")
    if active is None and multi:
        active = ss.activity(every, ss.perspectives("array", every, arrays), lengths, config.noise_class, alignment)
    elif active is None:
        active = ss.single_clock_activity(every, config.noise_class)
    return enhance(*ss.prepared(rows, heard, active, speakers, config.noise_class, config.multiarray, reference), config)


def beamform(spectrum: DataFrame, weights: DataFrame, kind: str = "mvdrSouden_ban", postfilter: str | None = None) -> DataFrame:
    """(utt, f, t, spectrum): spectra (utt, f, d, t, spectrum) beamformed with masks (utt, f, target, noise: array<double> of t items)."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        _one_thread()
        group = group.sort_values("f")
        d, t = int(group["d"].iloc[0]), int(group["t"].iloc[0])
        y = np.stack([complex_of(s, d, t) for s in group["spectrum"]], -1)
        target, noise = (np.stack([np.asarray(m, float) for m in group[c]], -1) for c in ("target", "noise"))
        out = signal.beamform(y, target, noise, kind, postfilter)
        return pd.DataFrame({"utt": group["utt"].iloc[0], "f": group["f"].to_numpy(), "t": t, "spectrum": [interleave(out[:, k]) for k in range(out.shape[1])]})

    return spectrum.join(weights.select("utt", "f", "target", "noise"), ["utt", "f"]).groupBy("utt").applyInPandas(one, "utt string, f int, t int, spectrum array<double>")


def masked_covariance(frames: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, i, j, cov): weighted second moments of real vectors, summed on the JVM with map-side combining."""
    pairs = frames.select(*keys, weight, F.posexplode(value).alias("i", "x"), F.col(value).alias("_v")).select(*keys, weight, "i", "x", F.posexplode("_v").alias("j", "y"))
    return pairs.groupBy(*keys, "i", "j").agg((F.sum(F.col(weight) * F.col("x") * F.col("y")) / F.sum(weight)).alias("cov"))


def target_distortion(masks_: DataFrame, keys: list[str], target: str = "target_idx") -> DataFrame:
    """(keys, target, distortion) of long masks (keys, class_idx, target_idx, mask)."""
    own = F.col("class_idx") == F.col(target)
    return masks_.groupBy(*keys).agg(F.sum(F.when(own, F.col("mask")).otherwise(0.0)).alias("target"), F.sum(F.when(~own, F.col("mask")).otherwise(0.0)).alias("distortion"))
