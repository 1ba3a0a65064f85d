"""Settings that accept several spellings of a few names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any


class Choice:
    """A named setting: its values, how each may be spelled, and the value that stands for nothing given."""

    def __init__(self, setting: str, spellings: Mapping[str, Sequence[str]], default: str):
        self.setting, self.default, self.values = setting, default, tuple(spellings)
        self._value_of = {text.lower(): value for value, texts in spellings.items() for text in (value, *texts)}

    def __call__(self, given: Any) -> str:
        if given is None:
            return self.default
        try:
            return self._value_of[str(given).strip().lower()]
        except KeyError:
            raise ValueError(f"{self.setting} is {given!r}, which is none of {', '.join(self.values)}") from None


# Accepted spellings. Booleans arrive as their texts.
normalization_method = Choice(
    "normalization",
    {
        "none": ["false"],
        "zscore": ["true", "standard", "standardize", "standard_scaler"],
        "minmax": ["min-max", "min_max"],
        "robust": ["robust_scaler"],
        "maxabs": ["max-abs", "max_abs"],
    },
    default="zscore",
)
search_name = Choice(
    "search",
    {"none": ["", "off", "disabled", "false"], "random_search": ["random", "randomsearch"], "grid_search": ["grid", "gridsearch"]},
    default="none",
)
search_metric = Choice("search metric", {"RMSE": [""], "R2": []}, default="RMSE")
