"""What can be chosen by name: ways to cut documents, to rank, to rank anew, and to answer."""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    """Functions by name; a name that isn't known says which are."""

    def __init__(self, kind: str, of: dict[str, Callable] | None = None):
        super().__init__(of or {})
        self.kind = kind

    def register(self, name: str, made: Callable | None = None):
        """``made`` under ``name``, or a decorator that does it; a name is taken once."""
        if made is None:
            return lambda f: self.register(name, f)
        if name in self:
            raise ValueError(f"{self.kind} {name} is registered already")
        self[name] = made
        return made

    def __missing__(self, name: str):
        raise ValueError(f"no {self.kind} {name}; there are {', '.join(sorted(self)) or 'none'}")
