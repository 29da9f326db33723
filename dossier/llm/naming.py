"""Column names that no caller's column has."""

from __future__ import annotations


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it in any case."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found
