"""Reading very long texts in bounded pieces that give the same as the whole."""

from __future__ import annotations

import re
from collections.abc import Iterator

SIZE = 1_000_000


def pieces(text: str, edge: re.Pattern[str], size: int = SIZE) -> Iterator[tuple[int, int]]:
    """Start and end of pieces of ``size`` characters and more, cut only before a character that ``edge`` matches.

    Where no token crosses such a character, the tokens of all pieces are those of the text.
    """
    at = 0
    while len(text) - at > size and (m := edge.search(text, at + size)):
        yield at, m.start()
        at = m.start()
    yield at, len(text)
