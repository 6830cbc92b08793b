"""The store's twin in memory."""

from pyspark.sql import DataFrame


class MemoryTables:
    """Tables that commits replace or lengthen."""

    def __init__(self, tables: dict[str, DataFrame]):
        self._tables, self._number = dict(tables), 0

    def tables(self) -> dict[str, DataFrame]:
        return dict(self._tables)

    def commit(self, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None) -> int:
        new = {n: self._tables[n].unionByName(df) for n, df in added.items()} | (replaced or {})
        self._tables |= new
        self._number += 1
        return self._number
