"""Implausible measurements: spikes, frozen and impossible values, judged by their own source.

Spikes: the readings of a source are laid out as profile matrices (one short stretch of the track per
row, rows centred on their median) and split into a low-rank part, the source's normal behaviour, and
a sparse part by alternating projections with hard thresholding. Readings with a sparse part are
candidates; an exact comparison with the neighbours before and after decides. Constant runs and
ranges are tested separately.

Sources are cut into chunks of ``CHUNK`` readings by position, with a halo of ``HALO`` readings on
either side (enough for the longest test), so no task holds a whole source.

Defined results: readings without frame, x or y are left out, a null confidence is never a case and
takes no part in its own median; of re-delivered readings the smallest row_id counts; sources without
recording have no pixel ranges but all other tests; null handles form a source; empty input gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionlake.functions.chunked import first_delivery, null_safe_join, with_position
from motionlake.operators.regular_grid import SOURCE, usable_readings

CHUNK, HALO = 4096, 24
#: Width and offset of the profile matrices: a spike that one layout takes for normal stands out in another.
PROFILES = ((16, 0), (16, 8), (8, 4))
COORDS = ("x", "y", "conf")


def low_rank_and_sparse(m: np.ndarray, cut: float, rank: int = 2, rounds: int = 4) -> np.ndarray:
    """Sparse part of ``m``: alternate a rank-k fit and hard thresholding while k grows to ``rank``.

    The right singular space comes from the small Gram matrix, so a round is linear in the rows.
    """
    sparse = np.where(np.abs(m) > 4 * cut, m, 0.0)
    low = np.zeros_like(m)
    for k in range(1, rank + 1):
        for _ in range(rounds):
            rest = m - sparse
            _, v = np.linalg.eigh(rest.T @ rest)
            v = v[:, -k:]
            low = rest @ v @ v.T
            sparse = np.where(np.abs(m - low) > cut, m - low, 0.0)
    return m - low


def spike_candidates(v: np.ndarray, limit: float) -> np.ndarray:
    """Readings whose sparse part exceeds a tenth of the spike limit (the exact test comes after)."""
    n = len(v)
    known = np.isfinite(v)
    if n < 3 or not known.any() or not np.isfinite(limit):
        return np.zeros(n, bool)
    if limit == 0:
        return known
    filled = v[np.maximum.accumulate(np.where(known, np.arange(n), int(known.argmax())))]
    out = np.zeros(n, bool)
    for width, shift in PROFILES:
        padded = np.concatenate([np.full(shift, filled[0]), filled, np.full(-(n + shift) % width, filled[-1])])
        m = padded.reshape(-1, width)
        m = m - np.median(m, axis=1, keepdims=True)
        out |= (np.abs(low_rank_and_sparse(m, 0.3 * limit)) > 0.1 * limit).ravel()[shift : shift + n]
    return out & known


def exact_spikes(v: np.ndarray, limit: float, candidate: np.ndarray) -> np.ndarray:
    """1 to 3 successive readings, at least one a candidate, that leave and return by more than ``limit``."""
    out = np.zeros(len(v), bool)
    with np.errstate(invalid="ignore"):
        for g in (1, 2, 3):
            if len(v) < g + 2:
                break
            before, after = v[: -g - 1], v[g + 1 :]
            hit = np.abs(before - after) <= limit
            touched = np.zeros(len(before), bool)
            for k in range(1, g + 1):
                mid = v[k : k + len(before)]
                hit &= (np.abs(mid - before) > limit) & (np.abs(mid - after) > limit)
                touched |= candidate[k : k + len(before)]
            for k in range(1, g + 1):
                out[k : k + len(before)] |= hit & touched
    return out


def in_constant_run(v: np.ndarray, least: int) -> np.ndarray:
    if not len(v):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    return np.repeat(np.diff(np.r_[starts, len(v)]) >= least, np.diff(np.r_[starts, len(v)]))


def _flag_chunk(pdf: pd.DataFrame, factor: float, run: int) -> pd.DataFrame:
    pdf = pdf.sort_values("pos", kind="stable")
    x, y, conf = (pdf[c].to_numpy(float) for c in COORDS)
    w, h = (pdf[c].to_numpy(float) for c in ("width_px", "height_px"))
    with np.errstate(invalid="ignore"):
        outside = (x < 0) | (x > w) | (y < 0) | (y > h) | (conf < 0) | (conf > 1)
    frozen = in_constant_run(x, run) | in_constant_run(y, run)
    spike = np.zeros(len(pdf), bool)
    for c, v in zip(COORDS, (x, y, conf)):
        limit = factor * float(pdf[f"med_{c}"].iloc[0])
        spike |= exact_spikes(v, limit, spike_candidates(v, limit))
    own = ~pdf["halo"].to_numpy(bool) & (outside | frozen | spike)
    out = pdf.loc[own, ["handle", "take", "frame_index", "row_id"]].copy()
    out["outside"], out["frozen"], out["spike"] = outside[own], frozen[own], spike[own]
    return out


def flag_implausible(readings: DataFrame, recordings: DataFrame, factor: float = 20.0, run: int = 20) -> DataFrame:
    """(handle, take, frame_index, row_id, outside, frozen, spike) of the readings concerned.

    The spike limit is ``factor`` times the source's exact median absolute change, changes rounded to 9 decimals.
    """
    if not 1 <= run <= HALO:
        raise ValueError(f"run must lie in 1..{HALO}")
    r = first_delivery(usable_readings(readings), [*SOURCE, "frame_index"], "row_id", list(COORDS))
    r = with_position(r, SOURCE, "frame_index")
    chunk, at = F.floor(F.col("pos") / CHUNK).cast("long"), F.col("pos") % CHUNK
    copies = F.filter(F.array(chunk, F.when(at < HALO, chunk - 1), F.when(at >= CHUNK - HALO, chunk + 1)), lambda c: c >= 0)
    r = r.withColumn("chunk", F.explode(copies)).withColumn("halo", F.col("chunk") != chunk)
    w = Window.partitionBy(*SOURCE, "chunk").orderBy("pos")
    r = r.repartition(*SOURCE, "chunk")
    steps = r.select(*SOURCE, "halo", *[F.round(F.abs(F.col(c) - F.lag(c).over(w)), 9).alias(f"d_{c}") for c in COORDS]).filter(~F.col("halo"))
    # value counts combine before the shuffle; radix selection (functions.quantiles) took three times the CPU here
    limits = steps.groupBy(*SOURCE).agg(*[F.percentile(f"d_{c}", 0.5).alias(f"med_{c}") for c in COORDS])
    rec = recordings.select(*SOURCE, "width_px", "height_px")
    limits = null_safe_join(limits, rec, SOURCE, "left")
    full = null_safe_join(r, limits, SOURCE, "inner")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        return _flag_chunk(pdf, factor, run)

    return full.groupBy(*SOURCE, "chunk").applyInPandas(kernel, "handle string, take int, frame_index long, row_id long, outside boolean, frozen boolean, spike boolean")
