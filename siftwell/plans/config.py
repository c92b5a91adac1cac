"""Pipeline configurations and presets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

AUTO, FORCE_S1, FORCE_S2 = "auto", "force_s1", "force_s2"
MULTI_HOP = frozenset({"musique", "2wikimultihopqa"})


@dataclass(frozen=True)
class IngestConfig:
    chunk_size: int = 512
    chunk_overlap: int = 64
    embed_model: str = "hash-embedding"


@dataclass(frozen=True)
class QueryConfig:
    bm25: bool = True
    dense: bool = False
    graph: bool = False
    rerank: bool = False
    contextual: bool = False
    graph_recognition: bool = False
    route_mode: str = FORCE_S1
    top_k_fuse: int = 50
    top_k_final: int = 5


@dataclass(frozen=True)
class PipelineConfig:
    name: str
    ingest: IngestConfig = field(default_factory=IngestConfig)
    query: QueryConfig = field(default_factory=QueryConfig)

    def with_query(self, **changes) -> PipelineConfig:
        return replace(self, query=replace(self.query, **changes))

    def as_dict(self) -> dict:
        return asdict(self)


def _preset(name: str, **flags) -> PipelineConfig:
    return PipelineConfig(name, query=QueryConfig(**flags))


#: In the order of the ladder.
PRESETS = {
    p.name: p
    for p in (
        _preset("bm25-only"),
        _preset("dense-rrf", dense=True),
        _preset("contextual", dense=True, contextual=True),
        _preset("rerank", dense=True, contextual=True, rerank=True),
        _preset("graph", bm25=False, graph=True, contextual=True),
        _preset("graph-rrf", dense=True, graph=True, contextual=True),
        _preset("router-on", dense=True, contextual=True, rerank=True, route_mode=AUTO),
    )
}


def preset(name: str) -> PipelineConfig:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
    return PRESETS[name]
