"""Three-level names over versioned tables: catalog, database, table; identity survives renames.

Databases and tables are small files under the warehouse (`_catalog/<database>/<table>`), created if absent, so a catalogue
outlives its driver and another driver that opens the warehouse sees the same tables.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from quarry import sources
from quarry.operators.mutate import Table
from quarry.plans import types
from quarry.plans.errors import QuarryError

#: Formats that a catalogue's tables may have: its own, and those that are read and written where they lie.
FORMATS = ("versioned", *sources.FILES)


def segments(name: str, catalog: str | None = None, database: str | None = None) -> tuple[str, str, str]:
    """catalog, database and table of a name with one, two or three parts."""
    parts = name.split(".")
    if not 1 <= len(parts) <= 3 or not all(parts):
        raise QuarryError("BAD_NAME", name=name)
    full = [catalog, database][: 3 - len(parts)] + parts
    if None in full:
        raise QuarryError("NO_DEFAULT", name=name)
    return tuple(full)


@dataclass(frozen=True)
class Entry:
    table_id: str
    name: tuple[str, str, str]
    location: str
    options: dict[str, str] = field(default_factory=dict)
    format: str = "versioned"


class Catalog:
    def __init__(self, spark: SparkSession, warehouse: str, name: str = "main"):
        self.spark, self.warehouse, self.name = spark, warehouse.rstrip("/"), name
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # records

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.warehouse, "_catalog", *parts]))

    def _list(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _save(self, entry: Entry, overwrite: bool) -> None:
        try:
            out = self._fs.create(self._path(*entry.name[1:]), overwrite)
        except Py4JJavaError as e:
            raise QuarryError("TABLE_EXISTS", name=".".join(entry.name)) from e
        out.write(bytearray(json.dumps(asdict(entry)).encode()))
        out.close()

    # databases

    def create_database(self, name: str, if_not_exists: bool = False) -> None:
        if name in self.list_databases():
            if not if_not_exists:
                raise QuarryError("DATABASE_EXISTS", name=name)
        else:
            self._fs.mkdirs(self._path(name))

    def drop_database(self, name: str, cascade: bool = False, if_exists: bool = False) -> None:
        if name not in self.list_databases():
            if if_exists:
                return
            raise QuarryError("DATABASE_NOT_FOUND", name=name)
        inside = self.list_tables(name)
        if inside and not cascade:
            raise QuarryError("DATABASE_NOT_EMPTY", name=name)
        for t in inside:
            self.drop_table(f"{name}.{t}")
        self._fs.delete(self._path(name), True)

    def list_databases(self) -> list[str]:
        return self._list()

    # tables

    def _key(self, name: str) -> tuple[str, str, str]:
        key = segments(name, self.name)
        if key[0] != self.name:
            raise QuarryError("CATALOG_NOT_FOUND", name=key[0])
        if key[1] not in self.list_databases():
            raise QuarryError("DATABASE_NOT_FOUND", name=key[1])
        return key

    def has(self, name: str) -> bool:
        try:
            return self._fs.exists(self._path(*self._key(name)[1:]))
        except QuarryError:
            return False

    def entry(self, name: str) -> Entry:
        key = self._key(name)
        if not self._fs.exists(self._path(*key[1:])):
            raise QuarryError("TABLE_NOT_FOUND", name=name)
        stream = self._fs.open(self._path(*key[1:]))
        try:
            found = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Entry(**{**found, "name": tuple(found["name"])})

    def create_table(self, name: str, columns: list[tuple[str, str, bool]] | DataFrame, options: dict | None = None, if_not_exists: bool = False, location: str | None = None, kind: str = "versioned") -> Entry:
        """A table of columns (name, SQL type, nullable), or of a query's rows."""
        key = self._key(name)
        if kind not in FORMATS:
            raise QuarryError("UNSUPPORTED_FORMAT", name=kind)
        if self.has(name):
            if if_not_exists:
                return self.entry(name)
            raise QuarryError("TABLE_EXISTS", name=name)
        i = uuid.uuid4().hex
        entry = Entry(i, key, location or f"{self.warehouse}/{key[1]}/{i}", dict(options or {}), kind)
        first = columns if isinstance(columns, DataFrame) else self.spark.createDataFrame([], types.schema(columns))
        if kind == "versioned":
            Table(self.spark, entry.location).publish(first)
        elif isinstance(columns, DataFrame) or location is None:
            sources.write(first, kind, entry.location)
        self._save(entry, overwrite=False)  # last, so that a lost driver leaves no entry without a table
        return entry

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        """Forgets the table, and deletes its files if they lie in the warehouse."""
        if not self.has(name):
            if if_exists:
                return
            raise QuarryError("TABLE_NOT_FOUND", name=name)
        entry = self.entry(name)
        self._fs.delete(self._path(*entry.name[1:]), False)
        if entry.location.startswith(f"{self.warehouse}/"):
            self._fs.delete(self._hadoop.Path(entry.location), True)

    def rename_table(self, name: str, to: str) -> Entry:
        old, key = self.entry(name), self._key(to)
        new = replace(old, name=key)
        self._save(new, overwrite=False)
        self._fs.delete(self._path(*old.name[1:]), False)
        return new

    def set_options(self, name: str, options: dict[str, str], remove: tuple[str, ...] = ()) -> Entry:
        e = self.entry(name)
        new = replace(e, options={k: v for k, v in (e.options | options).items() if k not in remove})
        self._save(new, overwrite=True)
        return new

    def list_tables(self, database: str) -> list[str]:
        return self._list(database)

    def table(self, name: str) -> Table:
        e = self.entry(name)
        if e.format != "versioned":
            raise QuarryError("NOT_VERSIONED", name=name, format=e.format)
        return Table(self.spark, e.location)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        e = self.entry(name)
        if e.format == "versioned":
            return Table(self.spark, e.location).read(version)
        return sources.read(self.spark, e.format, e.location, **e.options)
