"""What the training-data operators take from the core."""

from __future__ import annotations

from ..functions.text import WHITE, strip
from ..session import cut_lineage
from ..sources.readers import table

__all__ = ["WHITE", "cut_lineage", "strip", "table"]
