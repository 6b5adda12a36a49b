"""Pair merges of one long sequence in n log n: a heap of the pairs at hand over a linked list of symbols.

Matrices in which words of equal length advance together are quick for short words, but their work grows with the square of the length.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

LONG = 512  # from this length on a word is merged alone


def merge_long(n: int, rank: Callable[[int, int, int], object | None], merged: Callable[[int, int], None] = lambda i, j: None) -> list[int]:
    """Starts of the symbols that are left of ``n`` single ones, and ``n``.

    ``rank(i, j, k)``: the order of merging the symbols at [i, j) and [j, k), least first, ties from the left; None if they don't merge.
    ``merged(i, j)`` is called as the symbol at j joins the one at i.
    """
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = []

    def push(i: int, j: int) -> None:
        if j < n and (r := rank(i, j, after[j])) is not None:
            heapq.heappush(heap, (r, i, j, after[j]))

    for i in range(n - 1):
        push(i, i + 1)
    gone = bytearray(n + 1)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if gone[i] or gone[j] or after[i] != j or after[j] != k:
            continue  # one of the two has changed since
        merged(i, j)
        gone[j], after[i], before[k] = 1, k, i
        if before[i] >= 0:
            push(before[i], i)
        push(i, k)
    out, i = [], 0
    while i < n:
        out.append(i)
        i = after[i]
    return [*out, n]
