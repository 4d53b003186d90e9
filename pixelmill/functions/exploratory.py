"""Kernels of the exploratory analysis; they follow the conventions of kernels.py and are registered as extractors."""

from __future__ import annotations

import numpy as np

from . import kernels as K

PAIRS = (("rg", 0, 1), ("rb", 0, 2), ("gb", 1, 2))


def quaternion_features(rgb: np.ndarray, levels: int = 3) -> dict:
    """Colour coefficients of each Haar band as pure quaternions: magnitude statistics, coherence and spread of the
    angle of each colour pair, and moments of standardised magnitudes (kurtosis not reduced by 3)."""
    out, at = {}, rgb
    for level in range(1, levels + 1):
        bands = K.haar(at)
        for name in ("LL", "LH", "HL", "HH"):
            out |= quaternion_band(bands[name], f"qwt_{name}{level}")
        at = bands["LL"]
    energy = {k: v for k, v in out.items() if k.endswith("_magnitude_energy")}
    detail = sum(v for k, v in energy.items() if "_LL" not in k)
    return out | {"qwt_detail_magnitude_energy_ratio": detail / (sum(energy.values()) + K.TINY)}


def quaternion_band(band: np.ndarray, head: str) -> dict:
    """The statistics of one band [n, 3, height, width]."""
    q = band.reshape(len(band), 3, -1)
    m = np.sqrt((q**2).sum(axis=1) + K.TINY)
    z = (m - m.mean(axis=1, keepdims=True)) / (m.std(axis=1, ddof=1, keepdims=True) + K.TINY)
    angle = {k: np.arctan2(q[:, b], q[:, a] + K.TINY) for k, a, b in PAIRS}
    out = {f"{head}_magnitude_mean": m.mean(axis=1), f"{head}_magnitude_std": m.std(axis=1, ddof=1), f"{head}_magnitude_energy": (m**2).mean(axis=1), f"{head}_magnitude_entropy": K.histogram_entropy(m)}
    out |= {f"{head}_phase_{k}_circular_coherence": np.sqrt(np.cos(a).mean(axis=1) ** 2 + np.sin(a).mean(axis=1) ** 2 + K.TINY) for k, a in angle.items()}
    out |= {f"{head}_phase_{k}_std": a.std(axis=1, ddof=1) for k, a in angle.items()}
    return out | {f"{head}_quaternion_skewness": (z**3).mean(axis=1), f"{head}_quaternion_kurtosis": (z**4).mean(axis=1)}


def short_dct_features(g: np.ndarray) -> dict:
    d = K.block_dct(g)
    e = d**2
    total = e.sum(axis=(2, 3)) + K.TINY
    u, v = np.indices((8, 8))
    return {
        "dct_dc_ratio_mean": (e[:, :, 0, 0] / total).mean(axis=1),
        "dct_highfreq_ratio_mean": (e[:, :, u + v >= 8].sum(axis=2) / total).mean(axis=1),
        "dct_coeff_abs_mean": np.abs(d).mean(axis=(1, 2, 3)),
        "dct_corner_abs_sum_mean": np.abs(d[:, :, 4:, 4:]).sum(axis=(2, 3)).mean(axis=1),
    }


def unbiased_kurtosis(x: np.ndarray) -> np.ndarray:
    """Excess kurtosis with the small-sample correction; 0 for a row without spread."""
    x = K.flat(x)
    n = x.shape[1]
    c = x - x.mean(axis=1, keepdims=True)
    m2 = (c**2).mean(axis=1)
    g = np.where(m2 > K.TINY**2, (c**4).mean(axis=1) / np.where(m2 > K.TINY**2, m2, 1.0) ** 2 - 3.0, 0.0)
    return np.where(m2 > K.TINY**2, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6), 0.0)


def residual_set(rgb: np.ndarray) -> dict:
    g = K.gray(rgb)
    h, c = K.highpass_residual(g), K.gray(K.cross_difference(rgb))
    p = np.abs(K.spectrum(c - c.mean(axis=(1, 2), keepdims=True))) ** 2
    return {
        "hp_std": K.flat(h).std(axis=1, ddof=1),
        "hp_absmean": np.abs(K.flat(h)).mean(axis=1),
        "hp_kurtosis": unbiased_kurtosis(h),
        "crossdiff_std": K.flat(c).std(axis=1, ddof=1),
        "crossdiff_absmean": np.abs(K.flat(c)).mean(axis=1),
        "crossdiff_fft_highfreq_ratio": (p * (K.radius(*c.shape[1:]) >= 0.5)).sum(axis=(1, 2)) / (p.sum(axis=(1, 2)) + K.TINY),
    }


def pieces(mask: np.ndarray) -> np.ndarray:
    """Number of 8-connected pieces of each mask: labels spread until none changes."""
    n, h, w = mask.shape
    label = np.where(mask, np.arange(1, h * w + 1).reshape(1, h, w), 0)
    while True:
        p = np.pad(label, ((0, 0), (1, 1), (1, 1)))
        best = np.max([p[:, 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in (*K.AROUND, (0, 0))], axis=0)
        best = np.where(mask, best, 0)
        if (best == label).all():
            return np.array([len(np.unique(x[x > 0])) for x in label], float)
        label = best


def edge_features(g: np.ndarray) -> dict:
    """Sobel magnitude (kernels divided by 8), Laplacian, edges, and contours: pieces of the edge mask and its length."""
    gx, gy = K.sobel(g)
    m = K.flat(np.sqrt((gx / 8) ** 2 + (gy / 8) ** 2 + 1e-6))
    lap = np.abs(K.flat(K.laplacian_residual(g))) / 16
    e = K.canny(g, 50, 150)
    return {
        "gradient_mean": m.mean(axis=1),
        "gradient_std": m.std(axis=1, ddof=1),
        "gradient_p95": np.quantile(m, 0.95, axis=1),
        "laplacian_absmean": lap.mean(axis=1),
        "laplacian_std": lap.std(axis=1, ddof=1),
        "edge_density": K.flat(e).mean(axis=1),
        "contour_count": pieces(e),
        "contour_perimeter_per_area": 2 * K.flat(e).mean(axis=1),
    }


def short_lbp_features(g: np.ndarray) -> dict:
    f = K.lbp_features(g)
    return {"lbp_hist_entropy": f["lbp_entropy"], "lbp_dominant_bin": f["lbp_dominant_bin"], "lbp_mean_code": f["lbp_mean_code"], "lbp_std_code": f["lbp_std_code"]}


def wide_glcm_features(g: np.ndarray, levels: int = 32) -> dict:
    """Co-occurrence properties, their mean and spread over all distances and angles."""
    p = K.cooccurrence(g, levels)
    h = K.haralick(p)
    h = {"contrast": h["contrast"], "dissimilarity": h["dissimilarity"], "homogeneity": h["homogeneity"], "ASM": h["energy"] ** 2, "energy": h["energy"], "correlation": h["correlation"], "entropy": h["entropy"]}
    return {f"glcm_{k}_{s}": f(K.flat(v), axis=1) for k, v in h.items() for s, f in (("mean", np.mean), ("std", np.std))}


def uint8_entropy(x: np.ndarray) -> np.ndarray:
    q = np.clip(K.flat(x) * 255, 0, 255).astype(np.int64)
    return K.bits(np.stack([np.bincount(r, minlength=256) for r in q]) / q.shape[1])


def colour_features(rgb: np.ndarray) -> dict:
    """Intensity, channels, their correlations (0 for a flat channel), saturation and value."""
    g = K.flat(K.gray(rgb))
    out = {"intensity_mean": g.mean(axis=1), "intensity_std": g.std(axis=1, ddof=1)}
    out |= {f"intensity_p{q:02d}": np.quantile(g, q / 100, axis=1) for q in (1, 50, 99)} | {"intensity_entropy": uint8_entropy(g)}
    c = rgb.reshape(len(rgb), 3, -1)
    for i, n in enumerate(K.CHANNELS):
        out |= {f"{n}_mean": c[:, i].mean(axis=1), f"{n}_std": c[:, i].std(axis=1, ddof=1), f"{n}_entropy": uint8_entropy(c[:, i])}
    z = c - c.mean(axis=2, keepdims=True)
    for k, a, b in PAIRS:
        s = np.sqrt((z[:, a] ** 2).sum(axis=1) * (z[:, b] ** 2).sum(axis=1))
        out[f"rgb_corr_{k}"] = np.where(s > 0, (z[:, a] * z[:, b]).sum(axis=1) / np.where(s > 0, s, 1.0), 0.0)
    high, low = c.max(axis=1), c.min(axis=1)
    sat = np.where(high > 0, (high - low) / np.where(high > 0, high, 1.0), 0.0)
    return out | {"hsv_saturation_mean": sat.mean(axis=1), "hsv_value_mean": high.mean(axis=1), "hsv_saturation_std": sat.std(axis=1, ddof=1)}


def error_level_features(rgb: np.ndarray, quality: int = 90) -> dict:
    d = K.flat(np.abs(rgb - K.jpeg_round_trip(rgb, quality)).mean(axis=1))
    return {"ela_mean": d.mean(axis=1), "ela_std": d.std(axis=1, ddof=1), "ela_p95": np.quantile(d, 0.95, axis=1), "ela_max": d.max(axis=1)}


def ring_profile(g: np.ndarray) -> np.ndarray:
    """Mean log magnitude by whole radius from the centre of the spectrum [n, radii]."""
    m = np.log(np.abs(np.fft.fftshift(np.fft.fft2(g), axes=(-2, -1))) + 1e-8)
    h, w = g.shape[1:]
    y, x = np.indices((h, w))
    r = np.sqrt((x - w // 2) ** 2 + (y - h // 2) ** 2).astype(int).ravel()
    n = np.bincount(r)
    return np.stack([np.bincount(r, v.ravel()) / np.maximum(n, 1) for v in m])


def _shrink(g: np.ndarray) -> np.ndarray:
    k = np.array([1, 4, 6, 4, 1]) / 16
    h, w = g.shape[1:]
    p = np.pad(g, ((0, 0), (2, 2), (2, 2)), mode="reflect")
    rows = sum(k[i] * p[:, i : i + h, :] for i in range(5))
    return sum(k[i] * rows[:, :, i : i + w] for i in range(5))[:, ::2, ::2]


def _grow(g: np.ndarray, h: int, w: int) -> np.ndarray:
    k = np.array([1, 4, 6, 4, 1]) / 8
    x = np.zeros((len(g), h, w))
    x[:, ::2, ::2] = g
    p = np.pad(x, ((0, 0), (2, 2), (2, 2)), mode="reflect")
    rows = sum(k[i] * p[:, i : i + h, :] for i in range(5))
    return sum(k[i] * rows[:, :, i : i + w] for i in range(5))


def gabor(theta: float, size: int = 15, sigma: float = 4.0, length: float = 8.0, gamma: float = 0.7) -> np.ndarray:
    y, x = np.mgrid[size // 2 : -(size // 2) - 1 : -1, size // 2 : -(size // 2) - 1 : -1].astype(float)
    u, v = x * np.cos(theta) + y * np.sin(theta), -x * np.sin(theta) + y * np.cos(theta)
    return np.exp(-(u**2 + (gamma * v) ** 2) / (2 * sigma**2)) * np.cos(2 * np.pi * u / length)


def directional_features(g: np.ndarray, levels: int = 2) -> dict:
    """Mean magnitude of four Gabor responses on each band of a Laplacian pyramid; borders are reflected."""
    out, at = {}, g
    for level in range(levels):
        small = _shrink(at)
        band = at - _grow(small, *at.shape[1:])
        h, w = band.shape[1:]
        p = np.pad(band, ((0, 0), (7, 7), (7, 7)), mode="reflect" if min(h, w) > 7 else "edge")
        view = np.lib.stride_tricks.sliding_window_view(p, (15, 15), axis=(1, 2))
        for a in range(4):
            out[f"contourlet_level{level}_{45 * a}"] = np.abs(np.einsum("nhwij,ij->nhw", view, gabor(a * np.pi / 4), optimize=True)).mean(axis=(1, 2))
        at = small
    return out


def noise_features(g: np.ndarray) -> dict:
    """Deviation of what a 3 x 3 Gaussian removes, and co-occurrence of 8-bit levels at one step to the right."""
    k = np.exp(-np.array([1.0, 0.0, 1.0]) / (2 * 0.8**2))
    k /= k.sum()
    h, w = g.shape[1:]
    p = np.pad(g, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    rows = sum(k[i] * p[:, i : i + h, :] for i in range(3))
    blur = sum(k[i] * rows[:, :, i : i + w] for i in range(3))
    out = {"noise_std": K.flat(g - blur).std(axis=1)}
    h2 = K.haralick(K.cooccurrence(g, 256, (1,), 1)[:, 0, 0])
    return out | {f"glcm256_{n}": h2[n] for n in ("contrast", "homogeneity", "energy", "correlation")}


EXTRACTORS = {
    "X_QUATERNION": lambda s: quaternion_features(s["rgb"]),
    "X_DCT": lambda s: short_dct_features(s["gray"]),
    "X_RESIDUAL": lambda s: residual_set(s["rgb"]),
    "X_EDGE": lambda s: edge_features(s["gray"]),
    "X_LBP": lambda s: short_lbp_features(s["gray"]),
    "X_GLCM": lambda s: wide_glcm_features(s["gray"]),
    "X_COLOUR": lambda s: colour_features(s["rgb"]),
    "X_ELA": lambda s: error_level_features(s["rgb"]),
    "Y_DIRECTIONS": lambda s: directional_features(s["gray"]),
    "Y_NOISE": lambda s: noise_features(s["gray"]),
}
