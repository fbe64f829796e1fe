"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from reelframe.operators import attachments, benchmarks, catalog, chapters, frames, packets, seeks, sessions, sizes  # noqa: F401  each module registers its queries
from reelframe.plans.registry import ORACLES, QUERIES
from reelframe.sources import files  # noqa: F401
from reelframe.streaming import sessions as streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
