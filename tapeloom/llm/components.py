"""Connected components: of link tables, from the operators, and of arrays within a task."""

from __future__ import annotations

import numpy as np

from tapeloom.operators.links import connected_components

__all__ = ["connected_components", "local_roots"]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` items reaches over the links ``(i, j)``."""
    root = np.arange(n)
    while len(i):
        m = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], m)
        np.minimum.at(root, root[j], m)
        root = root[root]
        root = root[root]
        if np.array_equal(root, before):
            live = root[i] != root[j]
            if not live.any():
                break
            i, j = i[live], j[live]
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root
