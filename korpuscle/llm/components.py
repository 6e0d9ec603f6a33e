"""Connected components, as the vector operators take them."""

from ..operators.components import connected_components

__all__ = ["connected_components"]
