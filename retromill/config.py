"""Thresholds of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """What makes two elements one family, and how consensi are built (fixed values)."""

    min_identity: float = 0.80
    min_coverage: float = 0.80
    max_edit_frac: float = 0.25
    k: int = 12
    min_seed_shared: int = 3
    max_bucket_ltr: int = 50
    max_bucket_internal: int = 25
    min_ltr_len: int = 80
    min_internal_len: int = 300
    min_flank_len: int = 50
    min_cluster_size: int = 3
    consensus: float = 0.40
    ambiguity: float = 0.0
    saturation: float = 0.60
    merge_edit_frac: float = 0.20
    merge_identity: float = 0.80
    cut: float = 0.20
    scan_flank: int = 32_768
