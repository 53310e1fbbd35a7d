"""A likes database (SQLite) as a batch data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.sets import missing_columns

#: Columns that a database must have (fixed values).
REQUIRED = {"posts": {"post_id", "post_url", "imported_at", "fetch_status"}, "accounts": {"author_id", "fetched_at"}, "media": {"post_id", "media_index", "media_type", "source_url"}}


class SqliteSource(DataSource):
    """options: path (on a file system that every executor mounts), table, splits."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
        with self._open() as c:
            return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in c.execute(f"PRAGMA table_info(\"{self.options['table']}\")"))

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self, schema)


class _Range(InputPartition):
    def __init__(self, low, high):
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, source: SqliteSource, schema):
        self.source, self.columns = source, [f.name for f in schema.fields]

    def partitions(self):
        with self.source._open() as c:
            low, high = c.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM \"{self.source.options['table']}\"").fetchone()
        n = max(1, min(int(self.source.options.get("splits", "8")), high - low + 1))
        return [_Range(low + (high - low + 1) * i // n, low + (high - low + 1) * (i + 1) // n) for i in range(n)]

    def read(self, part):
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self.source._open() as c:
            yield from c.execute(f"SELECT {names} FROM \"{self.source.options['table']}\" WHERE rowid >= ? AND rowid < ?", (part.low, part.high))


def read_legacy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """accounts, posts and media of a likes database; a missing column fails before anything is read."""
    spark.dataSource.register(SqliteSource)
    out = {}
    for name, required in REQUIRED.items():
        out[name] = spark.read.format("sqlite_table").option("path", path).option("table", name).load()
        if lost := missing_columns(out[name], required):
            raise ValueError(f"{name} lacks {', '.join(lost)}")
    return out
