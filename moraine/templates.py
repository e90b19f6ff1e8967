"""Named SQL statements with parameters."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable

from .errors import check


class Templates:
    """Statements by dotted name. ``:name`` is a bound parameter; ``[[ ... ]]`` is left out where one of its parameters isn't given."""

    OPTIONAL = re.compile(r"\[\[(.*?)\]\]", re.S)
    NAME = re.compile(r"(?<!:):([A-Za-z_]\w*)")

    def __init__(self):
        self.known: dict[str, str] = {}

    def add(self, name: str, text: str) -> None:
        self.known[name] = text

    def load(self, text: str) -> None:
        """Statements from one text: each after a line ``-- name: <name>``."""
        parts = re.split(r"(?m)^--\s*name:\s*(\S+)\s*$", text)
        for name, body in zip(parts[1::2], parts[2::2]):
            self.add(name, body.strip())

    def text(self, name: str, parameters: dict | None = None) -> str:
        check(name in self.known, "Statement %s does not exist", name)
        given = {k for k, v in (parameters or {}).items() if v is not None}
        return self.OPTIONAL.sub(lambda m: m[1] if set(self.NAME.findall(m[1])) <= given else "", self.known[name])

    def args(self, name: str, parameters: dict | None = None) -> dict | None:
        used = set(self.NAME.findall(self.text(name, parameters)))
        missing = used - set(parameters or {})
        check(not missing, "Parameters are missing: %s", ", ".join(sorted(missing)))
        return {k: parameters[k] for k in used} or None


def mapped(rows: Iterable, kind: type) -> list:
    """Rows as objects of a dataclass, by column names."""
    names = {f.name for f in dataclasses.fields(kind)}
    return [kind(**{k: v for k, v in r.asDict(recursive=True).items() if k in names}) for r in rows]
