"""Options of a fingerprint run."""

from __future__ import annotations

from dataclasses import dataclass

from quillprint.functions.fixed_values import EXTRACTION_METHOD_PREFIX

REDUCTIONS = ("random_projection", "pca", "svd", "umap")
MERGES = ("concat", "max", "sum", "mean")


@dataclass(frozen=True)
class RunConfig:
    """What one run computes. Models and encoders run elsewhere; these are the data-side options."""

    dataset: str = "rand"
    max_samples: int = 100
    dim: int = 128
    reduction: str = "random_projection"
    merge: str = "concat"
    seed: int = 42
    max_length: int = 1024
    encoder: str = "hashed_words"
    encoder_width: int = 64
    continue_on_error: bool = False
    use_response_cache: bool = True

    def __post_init__(self) -> None:
        if self.reduction not in REDUCTIONS:
            raise ValueError(f"Unsupported reduction method: {self.reduction}")
        if self.merge not in MERGES:
            raise ValueError(f"Unsupported merge method: {self.merge}")
        if self.max_samples < 2:
            raise ValueError("max_samples >= 2 is required")

    @property
    def extraction_method(self) -> str:
        return f"{EXTRACTION_METHOD_PREFIX}{self.reduction}_{self.merge}"
