"""Column names for helpers over frames of unknown columns."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``taken`` doesn't have, in any case of letters."""
    there = {c.lower() for c in taken}
    out = []
    for name in wanted:
        k, found = 0, f"_{name}"
        while found.lower() in there:
            k += 1
            found = f"_{name}_{k}"
        there.add(found.lower())
        out.append(found)
    return out
