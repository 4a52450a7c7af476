"""Typed settings; every default lives here once. Defaults and the keys of ``from_dict`` are fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Source:
    """A page source; a source that does not say so is not enabled."""

    name: str
    url: str = ""
    purpose: str = "unknown"
    enabled: bool = False


@dataclass(frozen=True)
class TransformConfig:
    min_text_length: int = 500
    strip_tags: tuple[str, ...] = ("script", "style", "noscript", "header", "footer", "nav")


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 400
    overlap: int = 80
    minimum: int = 50
    drift_threshold_pct: float = 20.0


@dataclass(frozen=True)
class EmbedConfig:
    dimension: int = 384
    batch_size: int = 32


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 5
    threshold: float = 0.5


@dataclass(frozen=True)
class GenerateConfig:
    model: str = "mistral"
    max_tokens: int = 512
    temperature: float = 0.2
    system_prompt: str = "Answer from the given context only. If the context does not hold the answer, say so. Be brief."


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...] = ()
    transform: TransformConfig = field(default_factory=TransformConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    embed: EmbedConfig = field(default_factory=EmbedConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    generate: GenerateConfig = field(default_factory=GenerateConfig)

    @classmethod
    def from_dict(cls, raw: dict) -> Config:
        """From a parsed YAML or JSON mapping; unknown keys are ignored, missing ones take the defaults."""
        t, c, e = raw.get("transform", {}), raw.get("chunking", {}), raw.get("embedding", {})
        q, g, m = raw.get("query", {}), raw.get("llm", {}), raw.get("monitoring", {})
        pick = lambda kind, values: kind(**{k: v for k, v in values.items() if v is not None})
        return cls(
            tuple(pick(Source, {k: s.get(k) for k in ("name", "url", "purpose", "enabled")}) for s in raw.get("sources", [])),
            pick(TransformConfig, {"min_text_length": t.get("min_text_length"), "strip_tags": tuple(t["strip_tags"]) if "strip_tags" in t else None}),
            pick(ChunkConfig, {"size": c.get("chunk_size"), "overlap": c.get("chunk_overlap"), "minimum": c.get("min_chunk_size"), "drift_threshold_pct": m.get("chunk_drift_threshold_pct")}),
            pick(EmbedConfig, {"dimension": e.get("dimension"), "batch_size": e.get("batch_size")}),
            pick(SearchConfig, {"top_k": q.get("max_context_chunks"), "threshold": q.get("confidence_threshold")}),
            pick(GenerateConfig, {"model": g.get("model"), "max_tokens": g.get("max_tokens"), "temperature": g.get("temperature")}),
        )

    @classmethod
    def load(cls, path: str) -> Config:
        """From a YAML file (where a YAML reader is installed) or a JSON file."""
        import json
        from pathlib import Path

        text = Path(path).read_text(encoding="utf-8")
        try:
            import yaml
        except ImportError:
            return cls.from_dict(json.loads(text))
        return cls.from_dict(yaml.safe_load(text) or {})
