"""Grids of configurations to compare, built by rule and run by protocol.run_specs."""

from __future__ import annotations

from dataclasses import replace

from passagery.config import CorpusConfig, FieldConfig, RetrievalConfig
from passagery.operators.protocol import unique_specs


def default_grid(base: RetrievalConfig | None = None) -> dict[str, RetrievalConfig]:
    """One change at a time from the base: weights in tenths, ways of fusion, depths, routing, overlap boost, diversity."""
    base = base or RetrievalConfig(top_k=5)
    out = [("base", base), ("dense-only", replace(base, dense_weight=1.0, sparse_weight=0.0)), ("sparse-only", replace(base, dense_weight=0.0, sparse_weight=1.0))]
    out += [(f"linear-{w / 10:.1f}", replace(base, dense_weight=w / 10, sparse_weight=round(1 - w / 10, 1))) for w in range(1, 10)]
    out += [(f"fusion-{f}", replace(base, fusion=f)) for f in ("rrf", "weighted_rrf")]
    out += [(f"depth-{d}", replace(base, candidate_depth=d)) for d in (10, 20, 30, 50)]
    out += [("adaptive", replace(base, adaptive_routing=True)), ("overlap", replace(base, overlap_weight=0.2))]
    out += [(f"diverse-{b}", replace(base, diversity=True, diversity_balance=b)) for b in (0.5, 0.7, 0.9)]
    return unique_specs(out)


def wording_grid(base: RetrievalConfig | None = None) -> dict[str, RetrievalConfig]:
    """Rewriting and expansion, always or for the queries that qualify, fused linearly or by ranks, and by confidence."""
    base = base or RetrievalConfig(top_k=5)
    out = [(f"rewrite-{p}-{f}", replace(base, rewrite_policy=p, fusion=f)) for p in ("always", "selective") for f in ("weighted_linear", "rrf")]
    out += [("expansion-selective-rrf", replace(base, expansion_policy="selective", fusion="rrf"))]
    out += [("both-selective-rrf", replace(base, rewrite_policy="selective", expansion_policy="selective", fusion="rrf"))]
    out += [("both-always-rrf", replace(base, rewrite_policy="always", expansion_policy="always", fusion="rrf"))]
    out += [("rewrite-selective-rrf-confident", replace(base, rewrite_policy="selective", fusion="rrf", confidence_threshold=0.5))]
    return unique_specs(out)


def field_grid() -> dict[str, FieldConfig]:
    """Four stages of the field profile, each adding to the one before."""
    # fixed values: the stream weights of each stage
    stages = {
        "static": FieldConfig(weights={"qwen": 0.25, "bge": 0.25, "e5": 0.2, "bm25": 0.3}, fusion="rrf", router=False, hierarchy=False),
        "router": FieldConfig(weights={"qwen": 0.3, "bge": 0.25, "e5": 0.2, "bm25": 0.25}, fusion="weighted_rrf", hierarchy=False),
        "instruction": FieldConfig(weights={"qwen": 0.25, "bge": 0.2, "e5": 0.15, "bm25": 0.4}, fusion="weighted_rrf", k1=1.4, b=0.65, hierarchy=False),
        "feedback-cascade": FieldConfig(weights={"qwen": 0.3, "bge": 0.2, "e5": 0.2, "bm25": 0.3}, fusion="weighted_rrf", cascade=True, feedback=True),
    }
    return stages


def corpus_grid() -> dict[str, tuple[CorpusConfig, int]]:
    """Configurations of the whole-corpus profile with their complexity, one change at a time from the base."""
    out: dict[str, tuple[CorpusConfig, int]] = {"base": (CorpusConfig(), 0)}
    for size, overlap in ((400, 80), (600, 100), (800, 150), (1200, 200)):
        out[f"character-{size}-{overlap}"] = (CorpusConfig(chunk_size=size, chunk_overlap=overlap), 1)
    for strategy, size, cost in (("paragraph", 800, 1), ("heading", 800, 1), ("section", 1000, 1), ("heading_context", 800, 2)):
        out[strategy] = (CorpusConfig(chunking=strategy, chunk_size=size, chunk_overlap=0), cost)
    for k1, b, technical in ((0.9, 0.5, False), (1.5, 0.75, False), (1.8, 0.6, False), (1.2, 0.75, True), (1.5, 0.6, True)):
        out[f"bm25-{k1}-{b}" + ("-technical" if technical else "")] = (CorpusConfig(k1=k1, b=b, technical_tokens=technical), 2 if technical and k1 != 1.2 else 1)
    for w in (0.9, 0.8, 0.6, 0.5):
        out[f"linear-{w}"] = (CorpusConfig(dense_weight=w, sparse_weight=round(1 - w, 1)), 1)
    out["weighted-rrf"] = (CorpusConfig(fusion="weighted_rrf"), 2)
    return out
