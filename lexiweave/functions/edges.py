"""Alignments as lists of (input index, output index or None) pairs, in plain Python: for kernels and small inputs.

lexiweave.operators.alignments has the same operations over rows.
"""

from __future__ import annotations

Edge = tuple[int, "int | None"]


def compose(first: list[Edge], second: list[Edge]) -> list[Edge]:
    """Edges over two steps, each once, in the order of the first and then the second."""
    onward: dict = {}
    for a, b in second:
        onward.setdefault(a, []).append(b)
    return list(dict.fromkeys((a, c) for a, b in first for c in onward.get(b, ())))


def repair(edges: list[Edge]) -> list[Edge]:
    """Sorted by input, each once, and deletions attached to the output before them, or else the one after.

    An input with a deletion keeps no other edge. Where no input has an output, deletions stay.
    """
    gone = {a for a, b in edges if b is None}
    rows = sorted((e for e in edges if e[1] is None or e[0] not in gone), key=lambda e: e[0])
    before, following, nxt = None, [None] * len(rows), None
    for k in range(len(rows) - 1, -1, -1):
        if rows[k][1] is not None:
            nxt = rows[k][1]
        following[k] = nxt
    out = []
    for (a, b), later in zip(rows, following):
        if b is None:
            b = before if before is not None else later
        else:
            before = b
        out.append((a, b))
    return list(dict.fromkeys(out))


def segments(source: str, target: str, edges: list[Edge]) -> list[tuple[str, str]]:
    """The smallest pieces of both strings that align without crossing: cut where all earlier outputs lie before all later ones."""
    spans: dict[int, tuple[int, int]] = {}
    for a, b in edges:
        if b is not None:
            low, high = spans.get(a, (b, b))
            spans[a] = min(low, b), max(high, b)
    if not spans:
        return [(source, target)] if source or target else []
    starts = sorted(spans)
    least_after = {}
    least = len(target)
    for a in reversed(starts):
        least = min(least, spans[a][0])
        least_after[a] = least
    cuts, most = [(0, 0)], -1
    for a in starts:
        if most >= 0 and most < least_after[a]:
            cuts.append((a, least_after[a]))
        most = max(most, spans[a][1])
    cuts.append((len(source), len(target)))
    return [(source[a:c], target[b:d]) for (a, b), (c, d) in zip(cuts, cuts[1:])]


def pretty(source: str, target: str, edges: list[Edge]) -> list[tuple[str, str | None]]:
    return [(source[a], None if b is None else target[b]) for a, b in edges]
