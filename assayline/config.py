"""Study configuration: recipes, search grids and the settings of a calibration study."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields

import numpy as np

#: The steps of each pretreatment, in order.
RECIPES: dict[str, tuple[str, ...]] = {
    "RAW": (), "CENTER": ("CENTER",), "STANDARDIZE": ("STANDARDIZE",), "MINMAX": ("MINMAX",), "ROBUST": ("ROBUST",),
    "VECTOR_NORM": ("VECTOR_NORM",), "AREA_NORM": ("AREA_NORM",), "SG": ("SG",), "SG1": ("SG1",), "SG2": ("SG2",),
    "MSC": ("MSC",), "SNV": ("SNV",), "DETREND": ("DETREND",), "BASELINE_POLY2": ("BASELINE_POLY2",), "BASELINE_POLY3": ("BASELINE_POLY3",),
    "SNV-SG": ("SNV", "SG"), "MSC-SG": ("MSC", "SG"), "SG-SNV": ("SG", "SNV"), "SG-MSC": ("SG", "MSC"), "DE1": ("DE1",), "DE2": ("DE2",),
    "DE1-SNV": ("DE1", "SNV"), "DE1-MSC": ("DE1", "MSC"), "DE2-SNV": ("DE2", "SNV"), "DE2-MSC": ("DE2", "MSC"),
    "BASELINE_POLY2-SNV": ("BASELINE_POLY2", "SNV"), "BASELINE_POLY2-MSC": ("BASELINE_POLY2", "MSC"), "BASELINE_POLY2-SG": ("BASELINE_POLY2", "SG"),
}
#: Response transforms.
TRANSFORMS = ("raw", "log1p", "sqrt", "standard")
#: The regression algorithms of a full study.
ALGORITHMS = (
    "PLS", "Ridge", "LASSO", "ElasticNet", "BayesianRidge", "Huber", "PCR", "SVR-RBF", "SVR-Linear", "KRR-RBF", "RBF-LS-SVM",
    "RandomForest", "ExtraTrees", "GradientBoosting", "HistGBR", "AdaBoost", "KNN", "ANN-MLP", "ELM", "GPR-SE", "GPR-Matern32", "PLS-LSSVM",
    "WeightedStacking", "SuperStacking", "XGBoost", "LightGBM", "CatBoost", "TorchMLP", "Torch1DCNN", "TorchCNNGRU",
)
#: An ensemble outside the full study.
MORE_ALGORITHMS = ("STACKING",)
#: Hyper-parameter grids by search level.
GRIDS = {
    "fast": {
        "krr_alpha": [1e-2, 1e-1, 1, 10], "krr_gamma": [1e-3, 1e-2, 1e-1], "svr_c": [0.3, 3, 30], "svr_eps": [0.03, 0.10],
        "svr_gamma": ["scale", 1e-2], "lssvm_gamma": np.logspace(-1, 3, 4).tolist(), "lssvm_sigma2": np.logspace(-1, 3, 4).tolist(),
    },
    "balanced": {
        "krr_alpha": [1e-3, 1e-2, 1e-1, 1, 10, 100], "krr_gamma": [1e-4, 1e-3, 1e-2, 1e-1, 1], "svr_c": [0.3, 1, 3, 10, 30], "svr_eps": [0.02, 0.05, 0.10, 0.20],
        "svr_gamma": ["scale", 1e-3, 1e-2, 1e-1], "lssvm_gamma": np.logspace(-2, 4, 5).tolist(), "lssvm_sigma2": np.logspace(-2, 4, 5).tolist(),
    },
    "wide": {
        "krr_alpha": np.logspace(-4, 3, 8).tolist(), "krr_gamma": np.logspace(-4, 0, 7).tolist(), "svr_c": [0.1, 0.3, 1, 3, 10, 30, 100], "svr_eps": [0.01, 0.03, 0.05, 0.10, 0.20],
        "svr_gamma": ["scale", 1e-3, 1e-2, 1e-1], "lssvm_gamma": np.logspace(-3, 4, 7).tolist(), "lssvm_sigma2": np.logspace(-3, 4, 7).tolist(),
    },
}


@dataclass(frozen=True)
class Config:
    """Settings of a study; every field enters its signature, Spark's parallelism does not."""

    random_state: int = 2026
    recipes: tuple[str, ...] = tuple(RECIPES)
    transforms: tuple[str, ...] = TRANSFORMS
    ratios: tuple[float, ...] = (0.75, 0.80, 0.85)
    repeats: int = 10
    algorithms: tuple[str, ...] = ALGORITHMS
    feature_count: int = 158
    feature_candidates: tuple[int, ...] = ()  # more than one: their number is tuned within the calibration rows
    feature_min: int = 12
    ranking_components: int = 8
    max_pls_components: int = 12
    max_pcr_components: int = 12
    inner_folds: int = 5
    inner_repeats: int = 2
    one_standard_error: bool = True
    level: str = "balanced"
    mccv_iterations: int = 100
    mccv_calibration: float = 0.78
    max_outlier_ratio: float = 0.18
    screen_calibration: bool = False
    require_full_factorial: bool = True
    top_n: int = 50
    rp2_min: float = 0.75
    max_r2_gap: float = 0.20
    severe_rp2: float = -10.0
    crs_weights: tuple[float, ...] = (0.25, 0.20, 0.20, 0.15, 0.15, 0.05)
    crs_alpha: tuple[float, ...] = (20, 16, 16, 12, 12, 4)
    crs_draws: int = 5000
    crs_seed: int = 20260726
    require_reason_for_missing: bool = False  # a missing reference value without a declared reason is an error
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        """Algorithms listed twice count once, where they stand first."""
        object.__setattr__(self, "algorithms", tuple(dict.fromkeys(self.algorithms)))

    @property
    def grid(self) -> dict:
        return GRIDS[self.level]

    @classmethod
    def from_json(cls, text: str) -> Config:
        """From a JSON object; unknown keys are an error, lists become tuples."""
        given = json.loads(text)
        known = {f.name for f in fields(cls)}
        if extra := set(given) - known:
            raise ValueError(f"unknown settings: {sorted(extra)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def signature(self, **provenance) -> str:
        """SHA-256 of the canonical JSON of all settings and the provenance given."""
        return hashlib.sha256(json.dumps({"config": asdict(self), "provenance": provenance}, sort_keys=True, default=str).encode()).hexdigest()

    def validate(self) -> None:
        """Every recipe, transform and algorithm is known, nothing is listed twice and, where required, the factorial is whole."""
        for name, got, known in (("recipes", self.recipes, RECIPES), ("transforms", self.transforms, TRANSFORMS), ("algorithms", self.algorithms, ALGORITHMS + MORE_ALGORITHMS)):
            if len(set(got)) != len(got) or not set(got) <= set(known):
                raise ValueError(f"{name}: unknown or repeated names in {got}")
        if self.require_full_factorial and (len(self.recipes), len(self.transforms), len(self.ratios), self.repeats, len(self.algorithms), self.feature_count) != (28, 4, 3, 10, 30, 158):
            raise ValueError("the full factorial is 28 recipes, 4 transforms, 3 ratios, 10 repeats, 30 algorithms and 158 variables")

    @property
    def evaluations(self) -> int:
        """Evaluations for each analyte."""
        return len(self.recipes) * len(self.transforms) * len(self.ratios) * self.repeats * len(self.algorithms)


def stable_seed(base: int, *parts: object) -> int:
    """An unsigned 32-bit seed from the first four bytes of a SHA-256, little-endian."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, (base, *parts))).encode()).digest()[:4], "little")
