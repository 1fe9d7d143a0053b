"""Dyadic intervals over a series: a function of its length and the depth alone, so they are made when a plan is built."""

from __future__ import annotations

import statistics


def make_intervals(length: int, depth: int) -> list[tuple[int, int]]:
    """Half-open [start, end) intervals, level by level: 2**level pieces, then the same pieces but the last moved right by
    half a piece (rounded up) where the lower median piece is longer than one value."""
    if length < 1 or depth < 1:
        raise ValueError(f"length and depth must be at least 1, not {length} and {depth}")
    found: list[tuple[int, int]] = []
    for level in range(min(depth, length.bit_length())):
        n = 1 << level
        cuts = [i * length // n for i in range(n + 1)]
        pieces = list(zip(cuts, cuts[1:], strict=False))
        found += pieces
        if n > 1 and statistics.median_low(b - a for a, b in pieces) > 1:
            shift = -(-length // (2 * n))
            found += [(a + shift, b + shift) for a, b in pieces[:-1]]
    return found


def quantile_count(size: int, div: int) -> int:
    """Features that an interval of this size gives."""
    return 1 if size == 1 else 1 + (size - 1) // div


def feature_count(length: int, depth: int, div: int) -> int:
    return sum(quantile_count(b - a, div) for a, b in make_intervals(length, depth))


def representation_lengths(length: int) -> dict[str, int]:
    """Length of each representation of a series, in their order."""
    if length < 3:
        raise ValueError(f"a series needs at least 3 values, not {length}")
    return {"identity": length, "smoothed_diff": length - 1, "second_diff": length - 2, "spectrum": length // 2 + 1}
