"""Names for added columns."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that none of the taken ones equals, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
