"""Readers by file suffix. A reader takes a name and bytes and gives tables of rows of cells."""

from __future__ import annotations

from collections.abc import Callable

Table = tuple[str, list[list[str | None]]]
Reader = Callable[[str, bytes], list[Table]]

_READERS: dict[str, Reader] = {}


def register(*suffixes: str) -> Callable[[Reader], Reader]:
    """Register a reader for suffixes; the last one counts, blank ones are ignored."""

    def keep(reader: Reader) -> Reader:
        _READERS.update({s.strip().lower(): reader for s in suffixes if s.strip()})
        return reader

    return keep


def suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def readers() -> dict[str, Reader]:
    """All readers by suffix, to be carried to the workers."""
    return dict(_READERS)


def reader(path: str) -> Reader | None:
    return _READERS.get(suffix(path))
