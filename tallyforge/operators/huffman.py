"""Huffman codes of a bounded dictionary."""

from __future__ import annotations

import heapq


def codes(counts: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """(word, code) with the rarest words deepest; ties are broken by order of arrival."""
    heap: list = [(c, i, w) for i, (w, c) in enumerate(counts)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], n, (a[2], b[2])))
        n += 1
    out: list[tuple[str, str]] = []
    todo = [(heap[0][2], "")] if heap else []
    while todo:
        node, code = todo.pop()
        if isinstance(node, tuple):
            todo += [(node[0], code + "0"), (node[1], code + "1")]
        else:
            out.append((node, code or "0"))
    return sorted(out)
