"""Connected components of a table of links, as the operators of this package use them."""

from __future__ import annotations

from loomfuse.operators.graph import components

__all__ = ["components"]
