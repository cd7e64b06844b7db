"""Fixed values of the verdict rules and the small readers that split them."""

from __future__ import annotations


def words(text: str) -> list[str]:
    """Comma separated values of a text block, in order."""
    return [w.strip() for w in text.replace("\n", " ").split(",") if w.strip()]


def rows(text: str, fields: int) -> list[tuple[str, ...]]:
    """Lines of a text block split in ``fields`` fields by " ; "."""
    return [
        tuple(part.strip() for part in line.split(" ; ", fields - 1))
        for line in text.splitlines()
        if line.strip()
    ]


def lines(text: str) -> list[str]:
    """Non-empty lines of a text block, in order."""
    return [line.strip() for line in text.splitlines() if line.strip()]
