"""Table names, and the write guard: only sandboxes and the audit table may be written."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Naming convention shared by every part of the engine.
SANDBOX_PREFIX = "sbx_"
AUDIT_TABLE = "qg_quality_results"
DEFAULT_SCHEMA = "analytics"

LETTERS = frozenset(string.ascii_letters + "_")
QUOTES = "`\"'"


class ProductionWriteBlocked(Exception):
    """A write was aimed at something that is neither a sandbox nor the audit table."""


@dataclass(frozen=True)
class TableName:
    """A table's name in its parts, the table itself last."""

    parts: tuple[str, ...]

    @classmethod
    def plain(cls, text: str, what: str = "identifier") -> TableName:
        """A name that needs no quotes: ASCII letters, digits and underscores between dots.

        Blanks around it are dropped. Anything else is an error that calls it ``what``.
        """
        name = cls(tuple(text.strip().split(".")))
        odd = set("".join(name.parts)) - LETTERS - set(string.digits)
        if name.parts == ("",):
            raise ValueError(f"{what} must not be empty")
        if odd or name.parts[0][:1] not in LETTERS:
            raise ValueError(f"{what} {str(name)!r} is not a plain name")
        return name

    @classmethod
    def quoted(cls, text: str) -> TableName:
        """A name as SQL writes it, with or without quotes."""
        return cls(tuple(part.strip().strip(QUOTES) for part in text.split(".")))

    def __str__(self) -> str:
        return ".".join(self.parts)

    @property
    def table(self) -> str:
        return self.parts[-1]

    def is_sandbox(self, prefix: str = SANDBOX_PREFIX) -> bool:
        return self.table.casefold().startswith(prefix.casefold())

    def may_be_written(self, prefix: str = SANDBOX_PREFIX, audit: str = AUDIT_TABLE) -> bool:
        return self.is_sandbox(prefix) or self.table.casefold() == audit.casefold()


def guard_target(name: str, prefix: str = SANDBOX_PREFIX, audit: str = AUDIT_TABLE) -> str:
    """Called by every sink before any job starts."""
    if not TableName.quoted(name).may_be_written(prefix, audit):
        raise ProductionWriteBlocked(
            f"write to {name!r} refused: create a sandbox ({prefix}*) and change that instead"
        )
    return name


def writable(name: Column, prefix: str = SANDBOX_PREFIX, audit: str = AUDIT_TABLE) -> Column:
    """Column form of :meth:`TableName.may_be_written`."""
    last = F.element_at(F.split(name, r"\."), -1)
    bare = F.lower(F.translate(last, QUOTES, ""))
    return bare.startswith(prefix.lower()) | (bare == audit.lower())
