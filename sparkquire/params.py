"""Defaults of every operator's parameters, overridden for a collection by ``overlay``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Params:
    # fixed values: the defaults that results depend on
    split_max_chars: int = 5000
    split_target_chars: int = 3000
    split_blank_lines: int = 2
    fragment_chars: int = 300
    dedup_shingle: int = 5
    dedup_jaccard: float = 0.5
    dedup_containment: float = 0.8
    dedup_min_shingles: int = 100
    dedup_common_df: int = 200
    card_summary_chars: int = 200
    quote_min_chars: int = 4
    fact_value_chars: int = 15
    name_contexts: int = 2
    name_context_radius: int = 20
    names_per_batch: int = 600
    anchor_names: int = 150
    hint_limit: int = 300
    crowded: int = 3
    order_window: int = 60
    placed_share: float = 0.8
    line_volume_scenes: int = 150
    contradiction_batch_chars: int = 30000
    contradiction_batch_groups: int = 80
    contradiction_groups: int = 2000
    window_overlap: int = 10
    chapter_chars: int = 10000
    volume_chapters: int = 10
    death_later: int = 5
    death_near: int = 2
    ref_candidates: int = 8
    common_bigram_share: float = 0.3
    index_line_chars: int = 100
    axis_break_share: float = 0.05
    axis_break_width: float = 0.03
    axis_min_width: float = 0.01
    gap_cluster_distance: float = 1.5
    segment_min_width: float = 0.6

    def overlay(self, settings: dict[str, Any] | None) -> Params:
        """These defaults with known settings of one collection put over them."""
        known = {f.name for f in fields(self)}
        out = replace(self, **{k: v for k, v in (settings or {}).items() if k in known and v is not None})
        if not 0 < out.split_target_chars < out.split_max_chars or out.split_blank_lines < 1:
            raise ValueError("the target of a split must lie between 0 and the maximum, and blank lines be 1 at least")
        return out


DEFAULTS = Params()
