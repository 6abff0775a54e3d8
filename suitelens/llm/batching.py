"""Texts that are looked at together: enough to be worth it, never more characters than fit easily."""

from __future__ import annotations

from collections.abc import Iterator


def by_size(texts: list[str | None], rows: int = 1000, characters: int = 4_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of consecutive parts; a text longer than ``characters`` is a part of its own."""
    begin = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > begin and (i - begin >= rows or size + n > characters):
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, texts[begin:]
