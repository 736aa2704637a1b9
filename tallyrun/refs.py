"""What can be said about a version, a run, a file or a piece of SQL without reading it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from .names import StoreError


def _text(what: str, value: object) -> None:
    if not isinstance(value, str) or not value:
        raise StoreError(f"{what} needs a string that is not empty, not {value!r}")


@dataclass(frozen=True)
class Hash:
    value: str

    def __post_init__(self):
        _text("Hash", self.value)


@dataclass(frozen=True)
class Run:
    value: str

    def __post_init__(self):
        _text("Run", self.value)


@dataclass(frozen=True)
class Variant:
    value: str

    def __post_init__(self):
        _text("Variant", self.value)


@dataclass(frozen=True)
class Label:
    value: str

    def __post_init__(self):
        _text("Label", self.value)


@dataclass(frozen=True)
class AsOf:
    value: datetime | str

    def __post_init__(self):
        moment(self.value)


@dataclass(frozen=True)
class Sql:
    """A SQL body, with or without a header of ``-- @inputs:`` and ``-- @output:``."""

    value: str

    def __post_init__(self):
        _text("Sql", self.value)


@dataclass(frozen=True)
class File:
    path: str

    def __post_init__(self):
        _text("File", self.path)


REFS = (Hash, Run, Variant, AsOf)


def moment(value: datetime | str) -> datetime:
    """A point in time without zone, in UTC."""
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            raise StoreError(f"not a point in time: {value!r}") from None
    if not isinstance(value, datetime):
        raise StoreError(f"not a point in time: {value!r}")
    return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value


class Code(str):
    """The text of a step, shown as it is written."""

    def __repr__(self) -> str:
        return f"<{len(self)} characters of code>\n{self}"

    def _repr_html_(self) -> str:
        import html

        return f"<pre><code>{html.escape(self)}</code></pre>"
