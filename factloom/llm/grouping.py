"""Spanning forests of the links found inside one tile."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def spanning(size: int, linked: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) positions that connect what ``linked`` connects.

    Each array of ``linked`` holds positions that belong together. There is one edge per
    member at most, and the root of a group is its first position.
    """
    root = np.arange(size)
    for positions in linked:
        found = np.unique(root[positions])
        if len(found) > 1:
            root[np.isin(root, found)] = found[0]
    member = np.flatnonzero(root != np.arange(size))
    return member, root[member]
