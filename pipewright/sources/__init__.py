"""Where tables come from, and pipelines inside SQL text."""

from .catalog import Catalog
from .embedded import Segment, scan

__all__ = ["Catalog", "Segment", "scan"]
