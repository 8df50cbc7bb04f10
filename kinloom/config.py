"""Thresholds and lists, in one typed place."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Thresholds:
    """They decide results and must stay as they are for equal output."""

    min_confidence: float = 0.5
    evidence_floor: float = 0.05
    evidence_ceiling: float = 0.95
    fused_cap: float = 0.98
    relation_cap: float = 0.95
    relation_floor: float = 0.2
    no_article_penalty: float = 0.15
    alias_cap: float = 0.7
    doubtful_cap: float = 0.35
    inferred: float = 0.5
    inferred_mutual_in_law: float = 0.6
    inferred_married_name: float = 0.55
    sibling_parent: float = 0.7
    rule_cap: float = 0.3
    cycle_cap: float = 0.2
    parent_gap: int = 12
    grandparent_gap: int = 25
    posthumous: int = 1
    sibling_gap: int = 45
    generation: int = 25
    slot_year_window: int = 40
    name_year_window: int = 30
    rare_surname: int = 15
    name_ratio: float = 0.85
    given_ratio: float = 0.7
    document_frequency: int = 8
    strict_lexicon: int = 1000
    family_size: int = 4
    tree_nodes: int = 45
    tree_width: int = 64
    branch_size: int = 6
    cover_ratio: float = 0.5
    cover_least: int = 3
    component_overlap: float = 0.5
    roots_per_spec: int = 8
    descendant_depth: int = 6
    cycle_rounds: int = 50
    category_depth: int = 8
    refetch_overlap_hours: int = 2
    fetch_batch: int = 50


SYMMETRIC = ("spouse", "sibling", "sibling_in_law")
STRUCTURAL = ("parent", "spouse")


@dataclass(frozen=True)
class Config:
    thresholds: Thresholds = field(default_factory=Thresholds)
    root_categories: tuple[str, ...] = ()
    excluded_categories: tuple[str, ...] = ()
    infobox_fields: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def with_thresholds(self, **changes: float) -> Config:
        return replace(self, thresholds=replace(self.thresholds, **changes))
