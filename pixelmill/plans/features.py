"""The feature registry and the plan that turns requested branches into one fused pass over images."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exploratory
from ..functions import kernels as K


@dataclass(frozen=True)
class Feature:
    index: int
    name: str
    branch: str
    sub_branch: str
    domain: str
    data_type: str
    description: str
    sensitivity: str


def _stats(prefix: str, names: str) -> list[str]:
    return [f"{prefix}_{n}" for n in names.split()]


def _names() -> list[tuple[str, str, str, list[str]]]:
    """(branch, sub-branch, domain, feature names) in table order."""
    synth = [f"synth_{c}_{x}" for c in "rgb" for x in [f"p{p}_{d}_mean" for p in (2, 4, 8) for d in "xyd"] + ["fft_highfreq_ratio"]]
    haar = ["LL3_energy", "LL3_entropy"] + [f"{b}{n}_{s}" for n in (3, 2, 1) for b in ("LH", "HL", "HH") for s in ("energy", "absmean", "entropy")] + ["detail_energy_ratio"]
    lbp = [f"lbp_bin_{i}" for i in range(9)] + _stats("lbp", "bin_nonuniform entropy uniformity dominant_bin mean_code std_code nonuniform_ratio")
    return [
        ("A", "A1_FFT", "frequency", _stats("fft", "low_freq_ratio mid_freq_ratio high_freq_ratio spectral_centroid")),
        ("A", "A2_SYNTH", "frequency_periodicity", synth),
        ("B", "B_HAAR", "wavelet", haar),
        ("C_LBP", "C_LBP", "texture", lbp),
        ("D_MFR", "D_MFR", "residual", _stats("mfr", "absmean std energy kurtosis entropy")),
        ("E", "E1_DCT", "compression_transform", _stats("dct", "ac_mean_abs ac_energy ac_kurtosis sparsity_ratio low_freq_ratio mid_freq_ratio high_freq_ratio anisotropy benford_ssd block_var_mean")),
        ("E", "E2_RESP", "compression_response", _stats("ela", "q95_mean q90_mean q75_mean q60_mean q90_energy slope_q90_q75 ratio_q90_q75 q90_gini")),
        ("E", "E3_PHASE", "compression_phase", _stats("phase", "corr_q90 corr_q75 diff_energy_q90 hf_stability_q90")),
        ("E", "E4_GRID", "compression_grid", _stats("grid", "h_ratio v_ratio strength anisotropy")),
    ]


#: What each sub-branch responds to.
SENSITIVITY = {"A1_FFT": "frequency_energy", "A2_SYNTH": "periodicity_peaks", "B_HAAR": "wavelet_multiscale", "C_LBP": "local_texture", "D_MFR": "nonlinear_residual", "E1_DCT": "transform_dct", "E2_RESP": "compression_response", "E3_PHASE": "phase_stability", "E4_GRID": "grid_discontinuity"}
GENERATORS = {0: "Real", 1: "SD2.1", 2: "SDXL", 3: "SD3", 4: "DALL-E3", 5: "Midjourney"}
SLUGS = {0: "real", 1: "sd21", 2: "sdxl", 3: "sd3", 4: "dalle3", 5: "midjourney_v6"}


def _registry() -> tuple[Feature, ...]:
    out = []
    for branch, sub, domain, names in _names():
        for n in names:
            s = "periodicity_highfreq" if n.endswith("highfreq_ratio") else SENSITIVITY[sub]
            out.append(Feature(len(out), n, branch, sub, domain, "float32", f"{sub} {domain}: {n}", s))
    if len({f.name for f in out}) != len(out) or len(out) != 111:
        raise AssertionError("the registry must hold 111 different names")
    return tuple(out)


REGISTRY = _registry()
NAMES = tuple(f.name for f in REGISTRY)
_BY_NAME = {f.name: f for f in REGISTRY}

#: Extractors: name -> function of a shared state. What they share (gray, recompressed images) is made once a batch.
EXTRACTORS = {
    "A1_FFT": lambda s: K.fft_features(s["gray"]),
    "A2_SYNTH": lambda s: K.periodicity_features(s["rgb"]),
    "B_HAAR": lambda s: K.haar_features(s["gray"]),
    "C_LBP": lambda s: K.lbp_features(s["gray"]),
    "C_GLCM": lambda s: K.glcm_features(s["gray"]),
    "C_LBP_EDGE": lambda s: K.lbp_features(s["gray"], K.canny(s["gray"]), "lbp_edge"),
    "D_HIGHPASS": lambda s: K.residual_features(s["gray"], "hp"),
    "D_LAPLACIAN": lambda s: K.residual_features(s["gray"], "lap"),
    "D_MFR": lambda s: K.residual_features(s["gray"], "mfr"),
    "E1_DCT": lambda s: K.dct_features(s["gray"]),
    "E2_RESP": lambda s: K.response_features(s["rgb"], s["jpeg"]),
    "E3_PHASE": lambda s: K.phase_features(s["gray"], s["jpeg"]),
    "E4_GRID": lambda s: K.grid_features(s["gray"]),
    **exploratory.EXTRACTORS,
}
#: Branch names and the extractors that they stand for.
BRANCHES = {"A": ("A1_FFT", "A2_SYNTH"), "B": ("B_HAAR",), "D": ("D_HIGHPASS", "D_LAPLACIAN", "D_MFR"), "E": ("E1_DCT", "E2_RESP", "E3_PHASE", "E4_GRID")}
CANONICAL = ("A", "B", "C_LBP", "D_MFR", "E")


def register_extractor(name: str, function) -> None:
    """Add an extractor: a function from the shared state to {feature: array}."""
    EXTRACTORS[name.upper()] = function


def resolve(branches=("A", "B")) -> tuple[str, ...]:
    """Extractors of the named branches, any case, each once; at most one texture variant."""
    out: list[str] = []
    for b in branches:
        b = b.upper()
        if b == "C":
            raise ValueError("name one of C_LBP, C_GLCM, C_LBP_EDGE")
        for e in BRANCHES.get(b, (b,)):
            if e not in EXTRACTORS:
                raise ValueError(f"unknown branch {b}")
            if e not in out:
                out.append(e)
    if not out:
        raise ValueError("no branch is named")
    if sum(e.startswith("C_") for e in out) > 1:
        raise ValueError("at most one texture variant can be used")
    return tuple(out)


def compute(rgb: np.ndarray, extractors: tuple[str, ...]) -> dict[str, np.ndarray]:
    """All features of a batch of images, with shared parts made once."""
    state = {"rgb": rgb, "gray": K.gray(rgb)}
    if {"E2_RESP", "E3_PHASE"} & set(extractors):
        state["jpeg"] = K.recompression(rgb)
    out: dict[str, np.ndarray] = {}
    for e in extractors:
        out |= EXTRACTORS[e](state)
    return out


def feature_names(extractors: tuple[str, ...], side: int = 16) -> list[str]:
    known = {f.sub_branch: [x.name for x in REGISTRY if x.sub_branch == f.sub_branch] for f in REGISTRY}
    if all(e in known for e in extractors):
        return [n for e in extractors for n in known[e]]
    return list(compute(np.zeros((1, 3, side, side)), extractors))


def image_batches(spark: SparkSession, rows: int = 64) -> None:
    """Hold the session's Arrow batches to ``rows`` rows: an image of 256 x 256 has 196 kB, and a Python worker has a
    whole batch in memory. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def extract(images: DataFrame, side: int, branches=CANONICAL, keep: list[str] = (), image_col: str = "image_rgb", qualities: tuple[int, ...] = (), batch: int = 32) -> DataFrame:
    """(keep..., [quality,] features float) of each image in one Arrow pass; metadata ride along, so nothing is joined.

    With ``qualities`` each image also gives a row for each JPEG quality (100: clean). Images are row-major 8-bit colour.
    A feature that is not finite fails the job.
    """
    image_batches(images.sparkSession)
    extractors = resolve(branches)
    names = feature_names(extractors, side)
    fields = [images.schema[k] for k in keep]
    fields += [T.StructField("quality", T.IntegerType())] if qualities else []
    meta = {f.name: {"branch": f.branch, "sub_branch": f.sub_branch, "domain": f.domain, "description": f.description, "sensitivity": f.sensitivity} for f in REGISTRY}
    fields += [T.StructField(n, T.FloatType(), metadata=meta.get(n, {})) for n in names]

    def run(pdfs):
        for pdf in pdfs:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                rgb = K.from_bytes(part[image_col].tolist(), side)
                for q in qualities or (100,):
                    got = compute(K.jpeg_round_trip(rgb, q), extractors)
                    table = np.stack([got[n] for n in names], axis=1)
                    if not np.isfinite(table).all():
                        raise ValueError("a feature is not finite")
                    out = pd.DataFrame(table.astype(np.float32), columns=names)
                    head = part[list(keep)].reset_index(drop=True)
                    yield pd.concat([head, pd.DataFrame({"quality": [q] * len(head)}), out] if qualities else [head, out], axis=1)

    schema = T.StructType(fields)
    out = images.select(*keep, image_col).mapInPandas(run, schema)
    return out.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in fields])


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(vars(f).values()) for f in REGISTRY], "index int, name string, branch string, sub_branch string, domain string, data_type string, description string, sensitivity string")


def lookup(name: str | None = None, index: int | None = None) -> Feature:
    if name is not None:
        return _BY_NAME[name]
    return REGISTRY[index]


def subset(budget: list[str] | None = None, names: list[str] | None = None, sub_branches: list[str] | None = None, branches: list[str] | None = None) -> list[str]:
    """Feature names by the first of budget list, names, sub-branches, branches, or all; unknown names and empty
    results are errors."""
    if budget is not None:
        got = list(budget)
    elif names is not None:
        got = list(names)
    elif sub_branches is not None:
        got = [f.name for f in REGISTRY if f.sub_branch in sub_branches]
    elif branches is not None:
        got = [f.name for f in REGISTRY if f.branch in branches]
    else:
        got = list(NAMES)
    for n in got:
        if n not in _BY_NAME:
            raise KeyError(n)
    if not got:
        raise ValueError("no feature is left")
    return got
