"""Limits that gate how much of a table an operator may read or list."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Policy:
    """Limits for one discovery run. ``None`` means "no limit", the default on a cluster."""

    sample_rows: int = 100
    profile_row_limit: int | None = None
    low_cardinality_limit: int = 50
    sample_tables: bool = True
    sample_views: bool = True
    sample_large_tables: bool = True
    mask: bool = True

    def with_limits(self, **changes) -> "Policy":
        changed = replace(self, **changes)
        if changed.sample_rows < 1:
            raise ValueError("sample_rows must be positive")
        return changed
