"""Connected components of links between documents: those of the library's graphs."""

from ..operators.graph import components

__all__ = ["components"]
