"""Versioned Parquet tables: immutable files, a manifest a version, and one atomic step that publishes it.

A table is a folder with
- `stage-<id>/`: Parquet files, written once and never changed;
- `version-<n>`: the manifest of version n: the files it consists of, its columns and what made it.

A statement writes its new files into a stage of its own, then creates the next manifest, which fails if that version
exists already. So readers see all of a statement or nothing, a refused or lost writer changes nothing (its stage is
deleted, or left for `cleanup`), and every version that a manifest names can still be read. Appends add files only;
delete, update and merge rewrite the files that hold a hit and keep the others; columns are added, dropped and renamed in the
manifest alone. All file work goes through Hadoop's file systems. Creating a file if it is absent is atomic on HDFS; on an
object store it takes a store (or a lock service) that offers conditional writes.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.errors import QuarryError

_FILE, _ROW, _FOUND = "__file", "__row", "__found"
#: Times that an append is tried again on top of the version that came between.
RETRIES = 20
Condition = Column | str


@dataclass(frozen=True)
class Clause:
    """One WHEN of a merge. kind: update, delete (of matched rows) or insert (of the others); values: expressions by column of
    the target, None for the source's columns of the same name."""

    kind: str
    condition: Condition | None = None
    values: dict[str, Condition] | None = None


def _column(x: Condition | None, default: bool = True) -> Column:
    return F.lit(default) if x is None else F.expr(x) if isinstance(x, str) else x


def _holds(x: Condition | None) -> Column:
    """Unknown isn't true."""
    return F.lit(True) if x is None else F.coalesce(_column(x), F.lit(False))


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    def _names(self) -> list[tuple[str, int]]:
        if not self._fs.exists(self._path()):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._path())]

    def versions(self) -> list[int]:
        return sorted(int(n[8:]) for n, _ in self._names() if n.startswith("version-"))

    def version(self) -> int:
        """Number of the current version; -1 before the first."""
        return max(self.versions(), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0 or not self._fs.exists(self._path(f"version-{version}")):
            raise QuarryError("TABLE_NOT_FOUND" if version < 0 else "VERSION_NOT_FOUND", path=self.path, version=version)
        stream = self._fs.open(self._path(f"version-{version}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if not text.endswith("}"):  # its writer was lost on the way
            raise QuarryError("COMMIT_IN_DOUBT", path=self.path, version=version)
        return json.loads(text)

    def _commit(self, after: int, columns: list[dict], files: list[dict], made_by: str) -> int:
        text = json.dumps({"version": after + 1, "made_by": made_by, "at": time.time(), "columns": columns, "files": files})
        try:
            out = self._fs.create(self._path(f"version-{after + 1}"), False)
        except Py4JJavaError as e:
            raise QuarryError("CONFLICT", path=self.path, version=after) from e
        out.write(bytearray(text.encode()))
        out.close()
        return after + 1

    def recover(self) -> bool:
        """Takes back a last version whose writer was lost while it published; says whether there was one."""
        try:
            self.manifest()
        except QuarryError as e:
            if e.code != "COMMIT_IN_DOUBT":
                raise
            return bool(self._fs.delete(self._path(f"version-{self.version()}"), False))
        return False

    # files

    def _stage(self, df: DataFrame, columns: list[dict]) -> list[dict]:
        """The files of `df`, written under the columns' physical names."""
        stage = f"stage-{uuid.uuid4().hex}"
        df.select(*(F.col(f"`{c['name']}`").cast(c["type"]).alias(c["physical"]) for c in columns)).write.parquet(f"{self.path}/{stage}")
        found = [s for s in self._fs.listStatus(self._path(stage)) if s.getPath().getName().endswith(".parquet")]
        return [{"path": f"{stage}/{s.getPath().getName()}", "bytes": s.getLen()} for s in found]

    def _unstage(self, files: list[dict]) -> None:
        for stage in {f["path"].split("/")[0] for f in files}:
            self._fs.delete(self._path(stage), True)

    def _rows(self, columns: list[dict], files: list[dict]) -> DataFrame:
        """The files' rows by name, with the file and the place of each."""
        kind = T.StructType([T.StructField(c["physical"], _type(c["type"])) for c in columns])
        named = [F.col(f"`{c['physical']}`").alias(c["name"]) for c in columns]
        if not files:
            return self.spark.createDataFrame([], kind).select(*named, F.lit(None).cast("string").alias(_FILE), F.lit(None).cast("long").alias(_ROW))
        raw = self.spark.read.schema(kind).parquet(*(f"{self.path}/{f['path']}" for f in files))
        return raw.select(*named, F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_ROW))

    def _hit(self, rows: DataFrame, files: list[dict]) -> list[dict]:
        """The files that the rows stand in: names only, of which the manifest has as many."""
        names = {r[0].rsplit("/", 1)[1] for r in rows.select(_FILE).distinct().collect()}
        return [f for f in files if f["path"].rsplit("/", 1)[1] in names]

    def _change(self, made_by: str, files: list[dict], gone: list[dict], rows: DataFrame | None, columns: list[dict], after: int) -> int:
        """Publishes the files without those `gone`, and with the rows."""
        new = self._stage(rows, columns) if rows is not None else []
        kept = [f for f in files if f not in gone]
        try:
            return self._commit(after, columns, kept + new, made_by)
        except QuarryError:
            self._unstage(new)
            raise

    # reading

    def columns(self, version: int | None = None) -> list[str]:
        return [c["name"] for c in self.manifest(version)["columns"]]

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or a former one that `cleanup` has left."""
        m = self.manifest(version)
        return self._rows(m["columns"], m["files"]).drop(_FILE, _ROW)

    def size(self) -> tuple[int, int]:
        """Files and bytes of the current version."""
        files = self.manifest()["files"]
        return len(files), sum(f["bytes"] for f in files)

    # writing

    def publish(self, df: DataFrame, after: int | None = None) -> int:
        """Write `df` as the next version, whatever its columns. `after`: the version it was made from."""
        after = self.version() if after is None else after
        columns = [{"name": f.name, "physical": f.name, "type": f.dataType.simpleString()} for f in df.schema]
        return self._change("publish", [], [], df, columns, after)

    def insert(self, rows: DataFrame, overwrite: bool = False) -> int:
        """Appends rows (columns by name; those that are missing are null). Files of other writers stay beside them."""
        columns = self.manifest()["columns"]
        given = {c.lower(): c for c in rows.columns}
        rows = rows.select(*((F.col(f"`{given[c['name'].lower()]}`") if c["name"].lower() in given else F.lit(None)).alias(c["name"]) for c in columns))
        new = self._stage(rows, columns)
        for _ in range(RETRIES):
            m = self.manifest()
            if m["columns"] != columns:
                break
            try:
                return self._commit(m["version"], columns, ([] if overwrite else m["files"]) + new, "insert")
            except QuarryError:  # another writer came first: append to what it has published
                continue
        self._unstage(new)
        raise QuarryError("CONFLICT", path=self.path)

    def delete(self, condition: Condition | None = None, name: str = "target") -> int:
        """Rows for which the condition is unknown stay."""
        m = self.manifest()
        gone = m["files"] if condition is None else self._hit(self._rows(m["columns"], m["files"]).alias(name).filter(_column(condition)), m["files"])
        if condition is None or not gone:
            return self._change("delete", m["files"], gone, None, m["columns"], m["version"])
        stay = self._rows(m["columns"], gone).alias(name).withColumn(_FOUND, _holds(condition)).filter(~F.col(_FOUND))
        return self._change("delete", m["files"], gone, stay, m["columns"], m["version"])

    def update(self, condition: Condition | None, values: dict[str, Condition], name: str = "target") -> int:
        m = self.manifest()
        by = {c.lower(): v for c, v in values.items()}
        if unknown := set(by) - {c["name"].lower() for c in m["columns"]}:
            raise QuarryError("COLUMN_NOT_FOUND", names=sorted(unknown))
        hit = self._hit(self._rows(m["columns"], m["files"]).alias(name).filter(_column(condition)), m["files"])
        if not hit:
            return m["version"]
        rows = self._rows(m["columns"], hit).alias(name).withColumn(_FOUND, _holds(condition))
        changed = [F.when(F.col(_FOUND), _column(by[c["name"].lower()]).cast(c["type"])).otherwise(F.col(f"`{c['name']}`")).alias(c["name"]) if c["name"].lower() in by else F.col(f"`{c['name']}`") for c in m["columns"]]
        return self._change("update", m["files"], hit, rows.select(*changed), m["columns"], m["version"])

    def merge(self, source: DataFrame, on: list[str] | Condition, clauses: list[Clause] | None = None, name: str = "target", source_name: str = "source") -> int:
        """Rows of the source against the table's: of the clauses of each kind, the first whose condition holds acts.

        on: key columns, or a condition on both names. Without clauses: matched rows take the source's values, others are
        added. The source is worked out once. A row that several source rows match, and a clause acts on, is an error.
        """
        m = self.manifest()
        columns, files = m["columns"], m["files"]
        clauses = [Clause("update"), Clause("insert")] if clauses is None else clauses
        # a stage of the table's own, so that a source that isn't deterministic is the same in each pass
        held = f"{self.path}/stage-{uuid.uuid4().hex}"
        source.write.parquet(held)
        try:
            s = self.spark.read.schema(source.schema).parquet(held).withColumn(_FOUND, F.lit(True)).alias(source_name)
            if isinstance(on, list):
                on = " and ".join(f"{name}.`{k}` = {source_name}.`{k}`" for k in on)
            on = _column(on)
            acting = [c for c in clauses if c.kind != "insert"]
            hit, rewritten = [], None
            if acting:
                matched = self._rows(columns, files).alias(name).join(s, on)
                some = F.lit(False)
                for c in acting:
                    some = some | _holds(c.condition)
                matched = matched.filter(some).select(_FILE, _ROW)
                if not matched.groupBy(_FILE, _ROW).count().filter("count > 1").isEmpty():
                    raise QuarryError("MERGE_CARDINALITY", path=self.path)
                hit = self._hit(matched, files)
            if hit:
                # of the acting matches a row has one at most
                both = self._rows(columns, hit).alias(name).join(s, on & some, "left")
                which = F.lit(-1)
                for i, c in reversed(list(enumerate(acting))):
                    which = F.when(F.coalesce(F.col(_FOUND), F.lit(False)) & _holds(c.condition), F.lit(i)).otherwise(which)
                deleted = [i for i, c in enumerate(acting) if c.kind == "delete"]
                both = both.withColumn("__which", which).filter(~F.col("__which").isin(deleted)) if deleted else both.withColumn("__which", which)
                rewritten = both.select(*(self._merged(acting, c, name, source_name).alias(c["name"]) for c in columns))
            adding = [c for c in clauses if c.kind == "insert"]
            added = None
            if adding:
                t = self._rows(columns, files).alias(name)
                fresh = s.join(t, on, "left_anti")
                which = F.lit(-1)
                for i, c in reversed(list(enumerate(adding))):
                    which = F.when(_holds(c.condition), F.lit(i)).otherwise(which)
                fresh = fresh.withColumn("__which", which).filter("__which >= 0")
                added = fresh.select(*(self._added(adding, c, source, source_name).alias(c["name"]) for c in columns))
            parts = [x for x in (rewritten, added) if x is not None]
            if not parts:
                return m["version"]
            return self._change("merge", files, hit, parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], columns, m["version"])
        finally:
            self._fs.delete(self._hadoop.Path(held), True)

    @staticmethod
    def _merged(clauses: list[Clause], column: dict, name: str, source_name: str) -> Column:
        own = F.col(f"{name}.`{column['name']}`")
        out = own
        for i, c in enumerate(clauses):
            if c.kind == "update":
                by = None if c.values is None else {k.lower(): v for k, v in c.values.items()}
                if by is None or column["name"].lower() in by:
                    value = F.col(f"{source_name}.`{column['name']}`") if by is None else _column(by[column["name"].lower()])
                    out = F.when(F.col("__which") == i, value.cast(column["type"])).otherwise(out)
        return out

    @staticmethod
    def _added(clauses: list[Clause], column: dict, source: DataFrame, source_name: str) -> Column:
        out = F.lit(None).cast(column["type"])
        for i, c in enumerate(clauses):
            by = None if c.values is None else {k.lower(): v for k, v in c.values.items()}
            if by is None and column["name"].lower() in [x.lower() for x in source.columns]:
                value = F.col(f"{source_name}.`{column['name']}`")
            elif by is not None and column["name"].lower() in by:
                value = _column(by[column["name"].lower()])
            else:
                continue
            out = F.when(F.col("__which") == i, value.cast(column["type"])).otherwise(out)
        return out

    # schema

    def alter(self, add: dict[str, str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, cast: dict[str, str] | None = None) -> int:
        """Schema evolution. Columns are added, dropped and renamed in the manifest; only a new type rewrites files."""
        m = self.manifest()
        columns, known = [dict(c) for c in m["columns"]], {c["name"].lower() for c in m["columns"]}
        for c in [*(drop or []), *(rename or {}), *(cast or {})]:
            if c.lower() not in known:
                raise QuarryError("COLUMN_NOT_FOUND", name=c)
        for c, t in (cast or {}).items():
            columns = [{**x, "type": _type(t).simpleString(), "physical": x["physical"] + "_" + uuid.uuid4().hex[:8]} if x["name"].lower() == c.lower() else x for x in columns]
        rows = self._rows(m["columns"], m["files"]) if cast else None
        if cast:
            files = self._stage(rows, columns)
        else:
            files = m["files"]
        dropped, renamed = {c.lower() for c in drop or []}, {a.lower(): b for a, b in (rename or {}).items()}
        columns = [{**c, "name": renamed.get(c["name"].lower(), c["name"])} for c in columns if c["name"].lower() not in dropped]
        for c, t in (add or {}).items():
            columns.append({"name": c, "physical": f"{c}_{uuid.uuid4().hex[:8]}", "type": _type(t).simpleString()})
        names = [c["name"].lower() for c in columns]
        if len(set(names)) < len(names) or not names:
            if cast:
                self._unstage(files)
            raise QuarryError("DUPLICATE_COLUMN" if names else "NO_COLUMNS", names=names)
        try:
            return self._commit(m["version"], columns, files, "alter")
        except QuarryError:
            if cast:
                self._unstage(files)
            raise

    # maintenance

    def compact(self, target_bytes: int = 128 << 20) -> int:
        """Rewrite the files of less than half of `target_bytes` into files of about that size; the others stay."""
        m = self.manifest()
        small = [f for f in m["files"] if f["bytes"] < target_bytes // 2]
        if len(small) < 2:
            return m["version"]
        rows = self._rows(m["columns"], small).drop(_FILE, _ROW)
        return self._change("compact", m["files"], small, rows.repartition(max(1, -(-sum(f["bytes"] for f in small) // target_bytes))), m["columns"], m["version"])

    def cleanup(self, keep: int = 1, older_than: float = 0.0) -> int:
        """Delete versions before the last `keep`, the files that no kept version names, and stages that no version ever named
        and that are older than `older_than` seconds (give the longest time that a writer may take). Number of versions deleted."""
        versions = self.versions()
        gone = versions[: max(0, len(versions) - keep)]
        used = {f["path"] for v in versions[len(gone) :] for f in self.manifest(v)["files"]}
        once = {f["path"] for v in gone for f in self.manifest(v)["files"]} - used
        for v in gone:
            self._fs.delete(self._path(f"version-{v}"), False)
        for path in once:
            self._fs.delete(self._path(path), False)
        stages = {p.split("/")[0] for p in used}
        for name, at in self._names():
            if name.startswith("stage-") and name not in stages and at / 1000 <= time.time() - older_than:
                self._fs.delete(self._path(name), True)
        return len(gone)

    def destroy(self) -> None:
        self._fs.delete(self._path(), True)


def _type(name: str) -> T.DataType:
    return T.StructType.fromDDL(f"c {name}")[0].dataType


def analyze(df: DataFrame) -> DataFrame:
    """One row a column: rows, nulls, approximate distinct values, least and greatest value as text; one pass."""
    stats = [F.count("*").alias("rows")]
    for c in df.columns:
        stats += [F.count(c).alias(f"n_{c}"), F.approx_count_distinct(c).alias(f"d_{c}"), F.min(c).cast("string").alias(f"l_{c}"), F.max(c).cast("string").alias(f"g_{c}")]
    one = df.agg(*stats)
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("rows"), (F.col("rows") - F.col(f"n_{c}")).alias("nulls"), F.col(f"d_{c}").alias("distinct_values"), F.col(f"l_{c}").alias("least"), F.col(f"g_{c}").alias("greatest")) for c in df.columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")
