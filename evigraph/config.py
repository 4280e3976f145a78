"""Thresholds of the rules, as frozen values that are passed to the transforms."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Weights:
    phash: float = 0.15
    embedding: float = 0.45
    sift: float = 0.05
    ransac: float = 0.35

    def __post_init__(self):
        if abs(self.phash + self.embedding + self.sift + self.ransac - 1) > 1e-6:
            raise ValueError("weights must sum to 1")


@dataclass(frozen=True)
class Rules:
    # fixed values: decision bands, geometry, reuse and recapture limits
    very_high: float = 0.90
    high: float = 0.80
    possible: float = 0.65
    low: float = 0.35
    report_min_score: float = 0.0
    min_good_matches: int = 12
    min_inliers: int = 8
    min_inlier_ratio: float = 0.30
    max_hamming: int = 10
    min_cosine: float = 0.50
    top_k: int = 15
    partial_inliers: int = 30
    partial_ratio: float = 0.20
    background_coverage: float = 0.02
    background_cosine: float = 0.45
    source_inliers: int = 30
    source_ratio: float = 0.55
    source_coverage: float = 0.08
    repeated_inliers: int = 8
    repeated_ratio: float = 0.50
    repeated_coverage: float = 0.02
    repeated_identity: int = 6
    repeated_reuse: int = 4
    same_image_phash: int = 4
    same_image_ratio: float = 0.50
    recapture_inliers: int = 40
    recapture_ratio: float = 0.30
    recapture_coverage: float = 0.18
    recapture_cosine: float = 0.60
    blur_variance: float = 160.0
    blurred_inliers: int = 12
    blurred_ratio: float = 0.25
    blurred_cosine: float = 0.55
    blurred_phash: int = 22
    whole_inliers: int = 18
    whole_ratio: float = 0.45
    whole_coverage: float = 0.08
    whole_strong_ratio: float = 0.75
    heatmap_foreground: float = 0.35
    heatmap_background: float = 0.45
    heatmap_gap: float = 0.20
    min_reuse_classes: int = 2
    min_reuse_inliers: int = 18
    min_major_inliers: int = 10
    identity_inliers: int = 50
    single_part_inliers: int = 18
    identity_parts: tuple[str, ...] = ("head", "neck")
    major_parts: tuple[str, ...] = ("torso", "uarm", "larm", "uleg", "lleg")
    reuse_parts: tuple[str, ...] = ("torso", "uarm", "larm", "uleg", "lleg", "hand", "foot")
    weights: Weights = field(default_factory=Weights)

    def __post_init__(self):
        if not self.very_high > self.high > self.possible > self.low:
            raise ValueError("decision thresholds must descend")


def from_environment(rules: Rules | None = None, prefix: str = "RULES__") -> Rules:
    """``rules`` with values from variables such as RULES__TOP_K, read as the type of the value they replace."""
    rules = rules or Rules()
    changed = {f.name: type(getattr(rules, f.name))(os.environ[prefix + f.name.upper()]) for f in fields(rules) if prefix + f.name.upper() in os.environ and isinstance(getattr(rules, f.name), int | float)}
    return dataclasses.replace(rules, **changed)
