"""Schemas and settings of filtered vector search."""

from __future__ import annotations

from dataclasses import dataclass

VECTORS = "id long, v array<double>"
LABELS = "id long, label long"
QUERIES = "qid long, qv array<double>, qlabels array<long>"
RESULTS = "qid long, rank long, id long, dist double"


@dataclass(frozen=True)
class SearchConfig:
    """k: neighbours returned; big_cutoff: labels with more members are big; precomp_cutoff: largest cached pair;
    cluster_size: average IVF list; nprobe: clusters probed; beam: search queue; build_candidates: neighbours
    considered per edge list; degrees: (largest label, degree) steps; shared_degree, min_shared, alpha: graph shape;
    graph_rows: the largest label whose graph is searched; suffix_cutoff: case names."""

    k: int = 10
    big_cutoff: int = 50
    precomp_cutoff: int = 80
    cluster_size: int = 100
    nprobe: int = 3
    beam: int = 40
    build_candidates: int = 40
    degrees: tuple[tuple[int, int], ...] = ((100, 8), (400, 10), (1 << 62, 12))
    shared_degree: int = 8
    min_shared: int = 2
    alpha: float = 1.2
    suffix_cutoff: int = 60_000
    graph_rows: int = 2_000_000
    kmeans_iterations: int = 500
