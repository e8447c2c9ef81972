"""Tables of SQLite store files.

``df.write.format("sqlitestore")`` creates the tables of a namespace and writes rows of
one, a file for each partition, which appear when all are written.
``spark.read.format("sqlitestore")`` reads one table of one or more files with the
standard library's driver. Options: ``path`` (a file, a folder or a glob), ``table``
(objects, file_recipe_cache, merkle_leaves, merkle_nodes or merkle_meta), ``namespace``,
``columns`` (names, separated by commas; only these are read, so that payloads stay where
they are) and ``partitions`` (ranges of row ids for each file, default 1). The driver
opens local files only, so stores lie in a folder that all executors mount.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cairnlake import schema
from cairnlake.errors import InvalidConfig
from cairnlake.sources.paths import list_files

TABLES = {"objects": schema.OBJECTS, "file_recipe_cache": schema.CACHE, "merkle_leaves": schema.LEAVES, "merkle_nodes": schema.NODES, "merkle_meta": schema.META}


def _columns(options: dict) -> T.StructType:
    """The columns asked for, of the table asked for."""
    name = options.get("table", "objects")
    if name not in TABLES:
        raise InvalidConfig("unknown table " + name)
    known = {f.name: f for f in TABLES[name].fields}
    wanted = [c.strip() for c in options.get("columns", ",".join(known)).split(",")]
    if not set(wanted) <= known.keys():
        raise InvalidConfig("unknown columns in " + ", ".join(wanted))
    return T.StructType([known[c] for c in wanted])


class _Rows(InputPartition):
    """Row ids from ``first`` to before ``stop``; null where a table has no rows to tell them."""

    def __init__(self, path: str, first: int, stop: int):
        self.path, self.first, self.stop = path, first, stop


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.columns = [f.name for f in _columns(options).fields]
        self.name = schema.namespace(options.get("namespace")) + options.get("table", "objects")

    @staticmethod
    def _connect(path: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        found = list_files(self.options["path"])
        if not found:
            raise InvalidConfig("no file at " + self.options["path"])
        parts, out = max(1, int(self.options.get("partitions", "1"))), []
        for path, _ in found:
            with self._connect(path) as c:  # both ends of the table's tree
                least, most = c.execute(f'SELECT (SELECT min(rowid) FROM "{self.name}"), (SELECT max(rowid) FROM "{self.name}")').fetchone()
            if least is None:
                continue
            step = max(1, -(-(most - least + 1) // parts))
            out += [_Rows(path, first, first + step) for first in range(least, most + 1, step)]
        return out or [_Rows(found[0][0], 0, 0)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        with self._connect(part.path) as c:
            query = f'SELECT {", ".join(self.columns)} FROM "{self.name}" WHERE rowid >= ? AND rowid < ?'
            for row in c.execute(query, (part.first, part.stop)):
                yield tuple(bytes(v) if isinstance(v, memoryview) else v for v in row)


_TYPES = {T.BinaryType: "BLOB", T.StringType: "TEXT", T.IntegerType: "INTEGER", T.LongType: "INTEGER"}
_KEYS = {"objects": "hash", "file_recipe_cache": "file_hash", "merkle_leaves": "hash", "merkle_nodes": "level, pos", "merkle_meta": "key"}


def create_tables(connection: sqlite3.Connection, namespace: str | None = None) -> None:
    """The tables of a namespace, where they are not there yet."""
    prefix = schema.namespace(namespace)
    for name, columns in TABLES.items():
        typed = ", ".join(f"{f.name} {_TYPES[type(f.dataType)]}" for f in columns.fields)
        connection.execute(f'CREATE TABLE IF NOT EXISTS "{prefix}{name}" ({typed}, PRIMARY KEY ({_KEYS[name]}))')


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    path: str


class SqliteWriter(DataSourceWriter):
    """Rows into files of their own; the first row of a key stays."""

    def __init__(self, options: dict, columns: T.StructType):
        self.options, self.columns = options, [f.name for f in columns.fields]
        known = _columns({"table": options.get("table", "objects")}).fieldNames()
        if not set(self.columns) <= set(known):
            raise InvalidConfig("unknown columns in " + ", ".join(self.columns))
        schema.namespace(options.get("namespace"))

    def write(self, rows: Iterator[T.Row]) -> WriterCommitMessage:
        folder = self.options["path"].removeprefix("file://")
        os.makedirs(folder, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}.db"
        temporary, path = os.path.join(folder, "." + name), os.path.join(folder, name)
        with closing(sqlite3.connect(temporary)) as c:
            create_tables(c, self.options.get("namespace"))
            table = schema.namespace(self.options.get("namespace")) + self.options.get("table", "objects")
            marks = ", ".join("?" * len(self.columns))
            values = (tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows)
            c.executemany(f'INSERT OR IGNORE INTO "{table}" ({", ".join(self.columns)}) VALUES ({marks})', values)
            c.commit()
        return _Written(temporary, path)

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.temporary, m.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.remove(m.temporary)


class SqliteStore(DataSource):
    """The ``sqlitestore`` format; register with ``spark.dataSource.register(SqliteStore)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlitestore"

    def schema(self):
        return _columns(dict(self.options))

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SqliteWriter(dict(self.options), schema)
