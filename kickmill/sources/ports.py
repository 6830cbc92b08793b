"""What the importer asks of a store: batches instead of point reads, one unit of work per file."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Tables(Protocol):
    """A store of the tables in ``store.SCHEMAS``: leagues, teams, aliases, matches, sources, odds, imports and notes."""

    def tables(self) -> dict[str, DataFrame]: ...

    def commit(self, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None) -> int: ...


@runtime_checkable
class UnitOfWork(Protocol):
    """One file's reads and writes; what isn't committed is never seen."""

    tables: dict[str, DataFrame]

    def get(self, name: str, keys: DataFrame) -> DataFrame: ...

    def add(self, name: str, rows: DataFrame, order: list[str] | None = None) -> DataFrame: ...

    def update(self, name: str, changes: DataFrame) -> None: ...

    def commit(self) -> int: ...

    def rollback(self) -> None: ...
