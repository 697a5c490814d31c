"""Semantic constants of the profile engine; each is a parameter of the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    level: int = 6
    min_nodes: int = 5
    min_df: int = 1
    top_k: int = 300
    df_weight: str = "sqrt"
    min_effective_units: float = 30.0
    min_units: int | None = None
    max_hhi: float = 0.25
    institution_cap: int = 8
    profile_unit_cap: int = 60
    min_similarity: float = 0.40
    project_top_k: int = 5
    min_best: float = 0.45
    core_rate: float = 0.4
    broad_share: float = 0.25


#: The same rules at the scale of the driver's tables.
TABLES = Settings(min_nodes=3, min_effective_units=70.0, max_hhi=0.12)
SMALL_TABLES = Settings(level=4, min_nodes=3, top_k=50)
