"""Parameters of the plans with the bounds they are checked against."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: Least and greatest value of each parameter.
BOUNDS = {
    "chunk_size": (64, 2048), "chunk_overlap": (0, 512), "top_k": (1, 100), "rerank_top_k": (1, 50), "score_threshold": (0, 1),
    "num_queries": (1, 8), "mmr_lambda": (0, 1), "min_relevance": (0, 1),
}


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 512
    chunk_overlap: int = 64
    top_k: int = 20
    rerank_top_k: int = 2
    score_threshold: float = 0.0
    num_queries: int = 3
    use_hybrid: bool = True
    use_hyde: bool = True
    use_mmr: bool = False
    mmr_lambda: float = 0.7
    min_relevance: float = 0.3
    require_ok: bool = False

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] = os.environ, prefix: str = "") -> Settings:
        """Settings from variables named as the fields in upper case, after a prefix; a missing or blank one leaves the default.

        Switches are true for 1, true, yes and on, in any case. What is no number,
        or out of its bounds, raises ValueError.
        """
        read = {}
        for field in fields(cls):
            text = environment.get(f"{prefix}{field.name.upper()}", "").strip()
            if text:
                kind = type(field.default)
                read[field.name] = text.lower() in ("1", "true", "yes", "on") if kind is bool else kind(text)
        return cls(**read)

    def __post_init__(self) -> None:
        for name, (least, most) in BOUNDS.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} must lie in {least}..{most}, not {getattr(self, name)}")


def overfetch(top_k: int, n_variants: int) -> int:
    """How deep each list is fetched before fusion."""
    return top_k if n_variants <= 1 else max(top_k, int(top_k * 1.5))
