"""Small parsers of command-line texts."""

from __future__ import annotations


def index_list(text: str) -> list[tuple[int, int]]:
    """Half-open ranges of "x[-y](,x[-y])*": 5 is 5 to 6; an empty or backward range is an error."""
    out = []
    for part in text.split(","):
        a, dash, b = part.partition("-")
        if not a.isdigit() or dash and not b.isdigit():
            raise ValueError(f"not an index: {part!r}")
        lo, hi = int(a), int(b) if dash else int(a) + 1
        if hi <= lo:
            raise ValueError(f"empty range {part!r}")
        out.append((lo, hi))
    return out
