"""Data source ``sqlite_store``: one table of the SQLite stores under a path, a store file or a folder of ``*.db`` files.

A task reads a range of row ids of one file, the chosen columns and the rows that pass ``where``: both are part of the
statement that SQLite runs, so an index there serves them. Files must not be written to meanwhile; :func:`snapshot` makes a
copy of a store that is in use. A local or mounted file is opened in place, any other is read into the task's memory.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import CALL, DECISION, ITEM_BODY, PROVENANCE, QUESTION, TABLES
from .course_files import located

ROWS = 50_000
BATCH = 4096
#: Comparisons that may be asked for.
OPERATORS = ("=", "<>", "<", "<=", ">", ">=", "IN", "IS NULL", "IS NOT NULL")


def spark_type(declared: str) -> T.DataType:
    """By SQLite's rules of affinity."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if "CHAR" in d or "CLOB" in d or "TEXT" in d:
        return T.StringType()
    if not d or "BLOB" in d:
        return T.BinaryType()
    return T.DoubleType()


def statement(table: str, columns: list[str], where: list, lo: int | None = None, hi: int | None = None) -> tuple[str, list]:
    """The SELECT over a range of row ids, ``lo`` to ``hi``, and its arguments. ``where`` has ``[column, operator, value]``."""
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    tests, values = [], []
    for column, operator, *value in where:
        if operator not in OPERATORS:
            raise ValueError(f"{operator!r} is none of {', '.join(OPERATORS)}")
        if operator.endswith("NULL"):
            tests.append(f"{quoted(column)} {operator}")
        elif operator == "IN":
            tests.append(f"{quoted(column)} IN ({', '.join('?' * len(value[0]))})")
            values += value[0]
        else:
            tests.append(f"{quoted(column)} {operator} ?")
            values += value
    if lo is not None:
        tests.append("rowid BETWEEN ? AND ?")
        values += [lo, hi]
    what = ", ".join(quoted(c) if c != "rowid" else "rowid" for c in columns)
    return f"SELECT {what} FROM {quoted(table)}" + (" WHERE " + " AND ".join(tests) if tests else ""), values


def connect(path: str) -> sqlite3.Connection:
    """A store for reading only."""
    store, base = located(path)
    if isinstance(store, fs.LocalFileSystem):
        return sqlite3.connect(f"file:{base}?mode=ro&immutable=1", uri=True)
    with store.open_input_file(base) as f:
        found = sqlite3.connect(":memory:")
        found.deserialize(f.read())
        return found


def snapshot(path: str, to: str) -> None:
    """A consistent copy of a store in use, log included."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as a, closing(sqlite3.connect(to)) as b:
        a.backup(b)


@dataclass
class Range(InputPartition):
    path: str
    lo: int
    hi: int


class SqliteStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_store"

    def _files(self) -> list[str]:
        store, base = located(self.options["path"])
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        if info.type == fs.FileType.File:
            return [self.options["path"]]
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        names = sorted(f.path[len(base) :] for f in found if f.type == fs.FileType.File and f.path.endswith(".db"))
        return [self.options["path"].rstrip("/") + n for n in names]

    def schema(self) -> T.StructType:
        files = self._files()
        if not files:
            raise FileNotFoundError(f"no *.db file under {self.options['path']}")
        with closing(connect(files[0])) as c:
            quoted = '"' + self.options["table"].replace('"', '""') + '"'
            declared = [(r[1], r[2]) for r in c.execute(f"PRAGMA table_info({quoted})")]
        if not declared:
            raise ValueError(f"{files[0]} has no table {self.options['table']}")
        kinds = {"rowid": T.LongType()} | {n: spark_type(d) for n, d in declared}
        chosen = json.loads(self.options["columns"]) if "columns" in self.options else ["rowid", *(n for n, _ in declared)]
        if missing := [c for c in chosen if c not in kinds]:
            raise ValueError(f"{self.options['table']} has no column {', '.join(missing)}")
        return T.StructType([T.StructField(c, kinds[c]) for c in chosen])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        where = json.loads(self.options.get("where", "[]"))
        return SqliteReader(self._files(), self.options["table"], schema, where, int(self.options.get("rows", ROWS)))


class SqliteReader(DataSourceReader):
    def __init__(self, files: list[str], table: str, schema: T.StructType, where: list, rows: int):
        self.files, self.table, self.fields, self.where, self.rows = files, table, [(f.name, f.dataType) for f in schema], where, rows

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.files:
            with closing(connect(path)) as c:
                quoted = '"' + self.table.replace('"', '""') + '"'
                lo, hi, n = c.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {quoted}").fetchone()
            parts = -(-n // self.rows)
            width = -(-(hi - lo + 1) // parts) if n else 1
            out += [Range(path, lo + i * width, min(hi, lo + (i + 1) * width - 1)) for i in range(parts)]
        return out or [Range("", 0, -1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kinds = {T.LongType(): (int, pa.int64()), T.StringType(): (str, pa.string()), T.BinaryType(): (bytes, pa.binary()), T.DoubleType(): ((float, int), pa.float64())}
        names = [n for n, _ in self.fields]
        sql, values = statement(self.table, names, self.where, partition.lo, partition.hi)
        with closing(connect(partition.path)) as c:
            cursor = c.execute(sql, values)
            while rows := cursor.fetchmany(BATCH):
                columns = []
                for (name, kind), column in zip(self.fields, zip(*rows)):
                    of, arrow = kinds[kind]
                    if odd := next((v for v in column if v is not None and not isinstance(v, of)), None):
                        raise ValueError(f"{partition.path}: {self.table}.{name} holds {odd!r}, which is no {kind.simpleString()}")
                    columns.append(pa.array(column, arrow))
                yield pa.RecordBatch.from_arrays(columns, names)


def scan(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, where: list | tuple = (), rows: int = ROWS) -> DataFrame:
    """A table of the stores under ``path``: ``columns`` (all, and ``rowid``, unless given) of the rows that pass ``where``, a
    list of ``[column, operator, value]``; about ``rows`` rows a task."""
    spark.dataSource.register(SqliteStore)
    options = {"table": table, "rows": rows, "where": json.dumps(list(where))} | ({"columns": json.dumps(columns)} if columns else {})
    return spark.read.format("sqlite_store").options(**options).load(path)


def _camel(kind: T.DataType) -> T.DataType:
    """A type with its fields named as in the store's JSON."""
    if isinstance(kind, T.StructType):
        name = lambda n: n.split("_")[0] + "".join(p.title() for p in n.split("_")[1:])
        return T.StructType([T.StructField(name(f.name), _camel(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_camel(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _camel(kind.valueType))
    return kind


_JSON = {
    "item": {"item": ITEM_BODY, "provenance": PROVENANCE, "decision": DECISION, "calls": T.ArrayType(CALL)},
    "verdict": {"decision": DECISION, "calls": T.ArrayType(CALL)},
    "quiz": {"questions": T.ArrayType(QUESTION), "rejected": T.ArrayType(QUESTION), "calls": T.ArrayType(CALL)},
}
_NAMED = {"item_id": ("rowid", "item_rowid"), "questions": ("quiz_json",)}


def read_table(spark: SparkSession, path: str, table: str, where: list | tuple = (), rows: int = ROWS) -> DataFrame:
    """A table of a store in the types of :data:`lectern.schemas.TABLES`: JSON columns as structs, times as timestamps, 0 and 1
    as booleans, row ids as ``item_id``. Columns that an older store lacks are null. Item ids are those of one store file."""
    raw = scan(spark, path, table, where=where, rows=rows)
    out = []
    for f in TABLES[table]:
        name, kind = f.name, f.dataType
        column = next((c for c in (*_NAMED.get(name, ()), name, f"{name}_json") if c in raw.columns and (c != "rowid" or table == "item")), None)
        if column is None:
            made = F.lit(None)
        elif name in _JSON.get(table, {}):
            made = F.from_json(column, _camel(kind))
        else:
            made = F.col(column)
        out.append(made.cast(kind).alias(name))
    return raw.select(*out)
