"""Connected components of a link table: the library's own, under the name that the training-data operators use."""

from ..operators.components import connected_components

__all__ = ["connected_components"]
