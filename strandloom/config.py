"""Parameters of the analysis, with the defaults that define its semantics."""

from __future__ import annotations

from dataclasses import dataclass

#: The contigs of the analysis, in canonical order.
CONTIGS = [f"chr{i}" for i in [*range(1, 23), "X", "Y"]]


@dataclass(frozen=True)
class Config:
    # extraction
    min_length: int = 50
    min_mapq: int = 5
    coverage_bin: int = 10
    scan_chunk: int = 10_000_000
    cigar_gap: int = 30
    reliable_mapq: int = 5
    split_insert_span: int = 50
    tandem_overlap: int = 30
    nearby: int = 150
    platform: str = "HIFI"
    # clustering and calling
    start_extension: int = 200
    insert_extension: int = 250
    end_extension: int = 50
    split_ends: bool = False
    #: Take end clusters apart by the similarity of their reads' alignments (refinement.refine).
    refine: bool = False
    refine_similarity: float = 0.7
    insert_fraction: float = 0.75
    min_support: int = 3
    min_reads: int = 2
    #: Positions in a chunk of a contig: the unit of parallel work of ordered operators.
    chunk: int = 1_000_000
    # filters
    strict_mean_af: float = 0.25
    min_confidence: float = 0.7
    pon_tolerance: int = 500
    pon_min_af: float = 0.01
    default_coverage: float = 30.0
    # germline evidence
    large_event: int = 50_000
    coverage_factor: float = 0.8
    k: int = 31
    k_insert: int = 21
    flank: int = 2000
    bin: int = 10
    read_margin: int = 200
    insert_window: int = 500
    translocation_window: int = 5000
    min_read_mapq: int = 20

    def sample_length(self, sample: str) -> int:
        """Least event length of a sample: the normal sample is searched more sensitively."""
        return max(self.min_length - int(self.min_length / 2.5), 0) if sample == "normal" else self.min_length

    def sample_mapq(self, sample: str) -> int:
        return min(self.min_mapq - -(-self.min_mapq // 2), 0) if sample == "normal" else self.min_mapq


DEFAULT = Config()
