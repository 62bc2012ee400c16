"""Job parameters. Nothing in the library reads a clock or a global: ``as_of`` and ``seed`` come from here."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from datetime import datetime
from pathlib import Path
from typing import Any

# The preference names in order of their rank.
PREFERENCES = ("like", "dislike", "neutral", "unknown")

# Rank of each reaction; anything else ranks 3.
REACTION_RANK = {"THUMBS_UP": 0, "HEART": 0, "THUMBS_DOWN": 1, "EYES": 2}
OTHER_REACTION_RANK = 3

# Places in a settings file and the settings they hold.
FILE_KEYS = {
    "fit_predict.categories": "categories",
    "fit_predict.embedding_columns": "embedding_columns",
    "fit_predict.background_start_year": "background_start_year",
    "fit_predict.preference_start_year": "preference_start_year",
    "fit_predict.seed": "seed",
    "fit_predict.neg_sample_ratio": "neg_sample_ratio",
    "fit_predict.confidence_weighted_sampling.enable": "confidence_weighting",
    "fit_predict.confidence_weighted_sampling.high_conf_threshold": "confidence_threshold",
    "fit_predict.confidence_weighted_sampling.high_conf_weight": "confidence_weight",
    "fit_predict.adaptive_difficulty_sampling.enable": "difficulty_sampling",
    "fit_predict.adaptive_difficulty_sampling.n_neighbors": "difficulty_neighbors",
    "fit_predict.adaptive_difficulty_sampling.pos_sampling_ratio": "pos_sampling_ratio",
    "fit_predict.adaptive_difficulty_sampling.synthetic_ratio": "synthetic_ratio",
    "fit_predict.adaptive_difficulty_sampling.k_smote": "smote_neighbors",
    "fit_predict.logic_regression.C": "regularisation_c",
    "fit_predict.logic_regression.max_iter": "max_iter",
    "fit_predict.predict.last_n_days": "last_n_days",
    "fit_predict.predict.start_date": "start_date",
    "fit_predict.predict.end_date": "end_date",
    "fit_predict.predict.high_threshold": "high_threshold",
    "fit_predict.predict.boundary_threshold": "boundary_threshold",
    "fit_predict.predict.sample_rate": "sample_rate",
    "summary.temperature": "temperature",
    "summary.top_p": "top_p",
}
# Places that name paths and outside services, which are arguments of readers and writers here.
FOREIGN_KEYS = (
    "content_repo", "download_pdf", "fit_predict.embedding_dataset", "fit_predict.preference_dir", "fit_predict.raw_data_dir",
    "summary.api_key", "summary.base_url", "summary.max_concurrent", "summary.model", "summary.num_workers",
    "summary.reasoning_effort", "summary.use_batch_api",
)


@dataclass(frozen=True)
class Settings:
    """Defaults are the values in effect for the nightly run."""

    as_of: datetime = datetime(2024, 12, 31)
    seed: int = 42

    # Candidate papers.
    categories: tuple[str, ...] = ("cs.CL", "cs.CV", "cs.AI", "cs.LG", "stat.ML", "cs.IR", "cs.CY")
    embedding_columns: tuple[str, ...] = ("jasper_v1", "conan_v1")
    first_year: int = 2017
    background_start_year: int = 2024
    preference_start_year: int = 2023

    # Training.
    neg_sample_ratio: float = 5.0
    confidence_weighting: bool = True
    difficulty_sampling: bool = True
    confidence_threshold: float = 0.9
    confidence_weight: float = 2.0
    difficulty_neighbors: int = 5
    pos_sampling_ratio: float = 2.0
    synthetic_ratio: float = 0.5
    smote_neighbors: int = 16
    regularisation_c: float = 1.0
    max_iter: int = 1000

    # Selection.
    last_n_days: int = 7
    start_date: str = ""
    end_date: str = ""
    high_threshold: float = 0.85
    boundary_threshold: float = 0.6
    sample_rate: float = 0.004

    # Summaries.
    token_budget: int = 50000
    token_reserve: int = 2000
    head_share: float = 0.4
    tail_share: float = 0.3
    keyword_limit: int = 6
    temperature: float = 0.1
    top_p: float = 0.8

    # Listing.
    page_size: int = 5
    index_size: int = 3
    schedule_margin_seconds: int = 15 * 60
    zone: str = "Asia/Shanghai"

    @property
    def as_of_text(self) -> str:
        return self.as_of.strftime("%Y-%m-%d %H:%M:%S")

    @classmethod
    def from_file(cls, path: str | Path, **given: Any) -> Settings:
        """The settings of a TOML file, then those ``given``; what neither names keeps its default.

        A settings table may also lie under ``settings``, by the names of this class. A place that is no
        setting, or a value of another type, is an error: a misspelt threshold would go unnoticed.
        """
        with open(path, "rb") as file:
            content = tomllib.load(file)
        kinds = {f.name: type(getattr(cls, f.name)) for f in fields(cls)}
        values: dict[str, Any] = {}
        for place, value in _leaves(content):
            if any(place == known or place.startswith(known + ".") for known in FOREIGN_KEYS):
                continue
            name = FILE_KEYS.get(place) or place.removeprefix("settings.") * place.startswith("settings.")
            if name not in kinds:
                raise ValueError(f"{path}: no setting {place}")
            values[name] = _typed(place, value, kinds[name])
        return cls(**{**values, **given})


def _leaves(content: dict[str, Any], above: str = "") -> list[tuple[str, Any]]:
    out = []
    for key, value in content.items():
        out += _leaves(value, f"{above}{key}.") if isinstance(value, dict) else [(f"{above}{key}", value)]
    return out


def _typed(place: str, value: Any, kind: type) -> Any:
    if kind is tuple and isinstance(value, list) and all(isinstance(v, str) for v in value):
        return tuple(value)
    if kind is float and type(value) is int:
        return float(value)
    if type(value) is not kind:
        raise ValueError(f"{place}: {value!r} is no {kind.__name__}")
    return value
