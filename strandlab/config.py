"""Parameters of the engine, with their shipped defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # reads and files
    input_suffix: str = "refined"
    dummy_phred: int = 22
    # quality filter
    max_removal_fraction: float = 0.1
    mad_threshold: float = 3.0
    min_avg_qual: float = 16.0
    # alignment columns
    min_len: int = 5
    homopolymer_threshold: float = 0.33
    gap_fraction_cutoff: float = 0.5
    di_rep: int = 6
    tri_rep: int = 6
    use_di_tri: bool = False
    # variants
    window: int = 60
    max_gap_frac: float = 0.90
    min_frac: float = 0.01
    min_reads: int = 5
    fdr: float = 0.1
    # ambiguity
    ambig_thr: float = 0.25
    min_depth: int = 10
    ambig_min_count: int = 5
    # distance mix
    floor_kmer: float = 0.2
    lambda_min: float = 0.5
    lambda_max: float = 0.8
    # sweep and flags
    grid: tuple[int, ...] | Callable[[], tuple[int, ...]] = (9, 12, 15, 18, 21, 24, 30, 35, 40, 50, 60)
    extra_min_pts: tuple[int, ...] = (7, 5, 4, 3)
    weights: tuple[float, ...] = (0.1, 0.05, 0.05, 0.55, 0.25)
    selection_epsilon: float = 0.05
    outlier_threshold: float = 0.90
    # consensus
    min_cluster_size: int = 6
    iupac_min_count: int = 3
    iupac_min_prop: float = 0.25
    phred_threshold: int = 15
    hp_len_consensus: int = 6
    hp_threshold_consensus: float = 0.5
    hp_gap_consensus: float = 0.2
    max_pairs_reads: int = 200
    # merge
    max_pairwise_distance: int = 0
    iupac_guard: bool = True
    iupac_delta_abs: int | None = None
    iupac_delta_rel: float = 0.0
    hp_mask_in_merge: bool = False
    drop_rejected: bool = False


DEFAULT = Config()
