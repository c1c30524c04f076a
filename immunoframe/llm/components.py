"""Connected components (see the core's module)."""

from ..operators.graph import connected_components

__all__ = ["connected_components"]
