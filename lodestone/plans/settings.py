"""Settings: process environment, then defaults; the empty text is unset."""

from __future__ import annotations

from dataclasses import dataclass, fields

from ..functions.text import TRUE_WORDS


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.90
    margin: float = 0.05
    web_enabled: bool = False
    web_scope: str = "in_domain_unresolved"
    candidates: int = 20
    pages: int = 3
    rank_floor: float = 0.1
    rrf_k: int = 60


def load(env: dict[str, str], prefix: str = "LODESTONE_") -> Settings:
    """Settings from ``env``; a value that cannot be read gives the default."""
    found = {}
    for f in fields(Settings):
        raw = (env.get(prefix + f.name.upper()) or "").strip()
        if not raw:
            continue
        kind = type(f.default)
        try:
            found[f.name] = raw.lower() in TRUE_WORDS if kind is bool else kind(raw)
        except ValueError:
            continue
    return Settings(**found)
