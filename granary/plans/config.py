"""Strategies and widths of a retrieval run; all of it is decided on the driver, before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import functions as F

STRATEGIES = ("vector", "bm25", "hybrid", "hybrid-rrf", "hybrid-rerank", "hybrid-rerank-mmr")
STAGES = ("vector", "bm25", "rrf", "rerank", "mmr")
_RUNS = {
    "vector": {"vector"}, "bm25": {"bm25"}, "hybrid": {"vector", "bm25"}, "hybrid-rrf": {"vector", "bm25", "rrf"},
    "hybrid-rerank": {"vector", "bm25", "rrf", "rerank"}, "hybrid-rerank-mmr": {"vector", "bm25", "rrf", "rerank", "mmr"},
}


@dataclass(frozen=True)
class VectorConfig:
    top_k: int = 10
    similarity: str = "cosine"
    similarity_threshold: float = 0.0


@dataclass(frozen=True)
class Bm25Config:
    top_k: int = 10
    language: str = "english"
    tokenizer: str = "standard"


@dataclass(frozen=True)
class RrfConfig:
    k: int = 60
    vector_weight: float = 1.0
    bm25_weight: float = 1.0
    top_n: int = 10


@dataclass(frozen=True)
class RerankConfig:
    enabled: bool = False
    candidate_count: int = 20
    top_n: int = 10


@dataclass(frozen=True)
class MmrConfig:
    enabled: bool = False
    lambda_: float = 0.7
    candidate_count: int = 15
    final_count: int = 8


@dataclass(frozen=True)
class RetrievalConfig:
    strategy: str = "hybrid-rrf"
    vector: VectorConfig = field(default_factory=VectorConfig)
    bm25: Bm25Config = field(default_factory=Bm25Config)
    rrf: RrfConfig = field(default_factory=RrfConfig)
    reranker: RerankConfig = field(default_factory=RerankConfig)
    mmr: MmrConfig = field(default_factory=MmrConfig)

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}; known: {', '.join(STRATEGIES)}")

    def runs(self, stage: str) -> bool:
        """Whether a stage is part of the strategy; reranking and MMR also have to be enabled."""
        on = stage in _RUNS[self.strategy]
        return on and (stage != "rerank" or self.reranker.enabled) and (stage != "mmr" or self.mmr.enabled)

    def overridden(self, **blocks) -> RetrievalConfig:
        """With whole blocks replaced; what a new block doesn't say has its class default."""
        return replace(self, **blocks)


def default_config(strategy: str, top_k: int = 5) -> RetrievalConfig:
    """Widths by strategy: fused strategies fetch more than they return."""
    fused = "rrf" in _RUNS[strategy]
    width = max(4 * top_k, 15) if fused else top_k
    with_mmr = strategy == "hybrid-rerank-mmr"
    rerank_n = max(3 * top_k, 10) if with_mmr else top_k
    return RetrievalConfig(
        strategy, VectorConfig(top_k=width), Bm25Config(top_k=width), RrfConfig(top_n=top_k),
        RerankConfig(enabled="rerank" in _RUNS[strategy], candidate_count=width, top_n=rerank_n), MmrConfig(enabled=with_mmr, candidate_count=rerank_n, final_count=top_k),
    )


def clamped(top_k, most: int = 100):
    """How many results a search gives at most: 1 to `most`. Takes a number or a Column."""
    return max(1, min(top_k, most)) if isinstance(top_k, int) else F.greatest(F.lit(1), F.least(top_k, F.lit(most)))
