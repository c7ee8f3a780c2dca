"""The SQL front: statements on the catalogue, its tables and the settings; all else is Spark's.

`Session.sql` takes one statement. Queries, and the queries and expressions inside other statements, go to Spark as they
are, once the catalogue's tables are views of the session; what Spark has no plain-Parquet form of (row-level mutation,
schema changes, databases) is taken apart here by its keywords and handed to Catalog and Table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.dialect import apart, clauses, infix, spelled
from quarry.functions.registry import Functions
from quarry.log import timed
from quarry.operators.mutate import Clause, analyze
from quarry.plans import types
from quarry.plans.catalog import Catalog
from quarry.plans.errors import QuarryError
from quarry.plans.settings import Setting, Settings

FAMILIES = {
    "query": r"SELECT|WITH|VALUES|TABLE|\(|FROM", "insert": "INSERT", "delete": "DELETE", "update": "UPDATE", "merge": "MERGE", "create": "CREATE", "drop": "DROP",
    "alter": "ALTER", "set": "SET", "reset": "RESET", "use": "USE", "transaction": "BEGIN|START|COMMIT|ROLLBACK", "explain": "EXPLAIN", "analyze": "ANALYZE", "show": "SHOW",
    "describe": "DESCRIBE|DESC", "prepare": "PREPARE", "execute": "EXECUTE", "deallocate": "DEALLOCATE", "optimize": "OPTIMIZE", "vacuum": "VACUUM",
}
_SKIP = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", re.S)
_TOKEN = re.compile(r"(?P<space>\s+|--[^\n]*|/\*(?!\+).*?\*/)|(?P<text>'(?:[^'\\]|''|\\.)*')|(?P<name>`(?:[^`]|``)*`|\"(?:[^\"]|\"\")*\"|[A-Za-z_][A-Za-z_0-9$]*)|(?P<number>\d+(?:\.\d+)?)|(?P<sign>/\*\+.*?\*/|.)", re.S)
#: Words that may follow a table's name in a query and aren't its alias.
_CLAUSES = set("WHERE JOIN INNER LEFT RIGHT FULL CROSS NATURAL SEMI ANTI ON USING GROUP ORDER HAVING LIMIT UNION EXCEPT INTERSECT WINDOW QUALIFY LATERAL PIVOT UNPIVOT TABLESAMPLE SORT CLUSTER DISTRIBUTE OFFSET FETCH SET WHEN SELECT VALUES MINUS".split())
#: Settings of a session, and Spark's names for them.
SETTINGS = (Setting("timezone", str, "UTC"), Setting("shuffle.partitions", int, 200), Setting("broadcast.bytes", int, 10 << 20), Setting("ansi", bool, True))
_CONF = {"timezone": "spark.sql.session.timeZone", "shuffle.partitions": "spark.sql.shuffle.partitions", "broadcast.bytes": "spark.sql.autoBroadcastJoinThreshold", "ansi": "spark.sql.ansi.enabled"}


def split(text: str) -> list[str]:
    """Statements of a text; semicolons in literals and comments don't count."""
    masked = _SKIP.sub(lambda m: "x" * len(m[0]) if m[0][0] in "'\"" else " " * len(m[0]), text)
    out, first = [], 0
    for m in re.finditer(r";|\Z", masked):
        if masked[first : m.start()].strip():
            out.append(text[first : m.start()].strip())
        first = m.end()
    return out


def family(text: str) -> str:
    masked = _SKIP.sub(lambda m: " " * len(m[0]) if m[0][0] in "-/" else m[0], text).lstrip()
    for name, pattern in FAMILIES.items():
        if re.match(rf"(?:{pattern})(?![A-Za-z_])" if name != "query" else rf"(?:{pattern})", masked, re.I):
            return name
    raise QuarryError("UNSUPPORTED_STATEMENT", text=text[:60])


def run(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    """Exactly one query on Spark's own views. Spark has no transactions over statements, so those are refused rather than ignored."""
    found = split(text)
    if len(found) != 1:
        raise QuarryError("ONE_STATEMENT_EXPECTED", found=len(found))
    if family(found[0]) == "transaction":
        raise QuarryError("TRANSACTIONS_UNSUPPORTED", text=found[0])
    return spark.sql(found[0], args=args) if args else spark.sql(found[0])


def explain(df: DataFrame, kind: str = "physical") -> str:
    """Plan text: logical (optimized), physical or distributed (physical with its exchanges only)."""
    q = df._jdf.queryExecution()
    if kind == "logical":
        return q.optimizedPlan().toString()
    text = q.executedPlan().toString()
    return text if kind == "physical" else "\n".join(x for x in text.splitlines() if "Exchange" in x or "Scan" in x)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    depth: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" and self.text[0] not in '`"' else self.text if self.kind == "sign" else ""

    @property
    def value(self) -> str:
        return self.text[1:-1] if self.text[0] in "`\"'" else self.text


def tokens(text: str) -> list[Token]:
    out, depth = [], 0
    for m in _TOKEN.finditer(text):
        if m.lastgroup != "space":
            depth -= m[0] == ")"
            out.append(Token(m.lastgroup, m[0], *m.span(), depth))
            depth += m[0] == "("
    return out


class Cursor:
    """Reads a statement from the left: keywords and names here, everything else as text."""

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens(text), 0

    def word(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].word if self.at + ahead < len(self.tokens) else ""

    def accept(self, *words: str) -> bool:
        found = all(self.word(k) == w for k, w in enumerate(words))
        self.at += len(words) * found
        return found

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise QuarryError("BAD_STATEMENT", expected=" ".join(words), found=self.rest()[:30])

    def name(self) -> str:
        """A name with one part or several."""
        parts = []
        while True:
            if self.at >= len(self.tokens) or self.tokens[self.at].kind != "name":
                raise QuarryError("BAD_STATEMENT", expected="a name", found=self.rest()[:30])
            parts.append(self.tokens[self.at].value)
            self.at += 1
            if not self.accept("."):
                return ".".join(parts)

    def alias(self, *after: str) -> str | None:
        """The name that follows, AS or not, unless it is one of the words."""
        if self.accept("AS") or (self.at < len(self.tokens) and self.tokens[self.at].kind == "name" and self.word() not in after):
            return self.name()
        return None

    def until(self, *phrases: tuple[str, ...]) -> str:
        """The text up to the first of the phrases outside of parentheses, or to the end."""
        first = self.at
        depth = self.tokens[first].depth if first < len(self.tokens) else 0
        while self.at < len(self.tokens) and not (self.tokens[self.at].depth == depth and any(all(self.word(k) == w for k, w in enumerate(p)) for p in phrases)):
            self.at += 1
        return self.text[self.tokens[first].start : self.tokens[self.at - 1].end] if self.at > first else ""

    def group(self) -> str:
        """The text in the parentheses that begin here."""
        self.expect("(")
        depth, first = self.tokens[self.at - 1].depth, self.at
        while self.at < len(self.tokens) and not (self.word() == ")" and self.tokens[self.at].depth == depth):
            self.at += 1
        self.expect(")")
        return self.text[self.tokens[first].start : self.tokens[self.at - 2].end] if self.at - 1 > first else ""

    def rest(self) -> str:
        return self.text[self.tokens[self.at].start :].strip() if self.at < len(self.tokens) else ""

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise QuarryError("BAD_STATEMENT", unexpected=self.rest()[:30])


def listed(text: str) -> list[str]:
    """Items of a list, cut at commas outside of parentheses."""
    c, out = Cursor(text), []
    while c.at < len(c.tokens):
        out.append(c.until((",",)))
        c.accept(",")
    return out


def assigned(text: str) -> dict[str, str]:
    """`column = expression, ...`, the column with or without its table's name."""
    out = {}
    for item in listed(text):
        c = Cursor(item)
        name = c.name().rsplit(".", 1)[-1]
        c.expect("=")
        if name.lower() in (k.lower() for k in out):
            raise QuarryError("DUPLICATE_COLUMN", name=name)
        out[name] = c.rest()
    return out


def properties(text: str) -> dict[str, str]:
    out = {}
    for item in listed(text):
        c = Cursor(item)
        t = c.tokens[0]
        key = t.value if t.kind == "text" else None
        c.at += t.kind == "text"
        key = key or c.name()
        c.expect("=")
        out[key] = c.tokens[c.at].value
    return out


class Session:
    """A user's session: current database, settings, prepared statements and the catalogue's tables by name."""

    def __init__(self, spark: SparkSession, warehouse: str, catalog: str = "main", database: str | None = None):
        self.spark = spark.newSession()  # its views and settings are its own
        self.catalog, self.database = Catalog(self.spark, warehouse, catalog), database
        self.settings = Settings()
        self.settings.register(*SETTINGS)
        self.prepared: dict[str, str] = {}
        self.functions = Functions(self.spark)

    # names

    def full(self, name: str) -> str:
        return ".".join([self.database] * (name.count(".") == 0 and self.database is not None) + [name])

    def _view(self, parts: list[str], version: int | None, known: dict[str, set[str]]) -> tuple[str, int] | None:
        """The view that stands for the longest beginning of a dotted name that is a table, and how many parts that has. known: tables
        by database, listed once a query."""
        for n in (3, 2, 1):
            if len(parts) >= n and (n > 1 or self.database) and (n < 3 or parts[0] == self.catalog.name):
                key = self.full(".".join(parts[:n]))
                database, table = key.split(".")[-2:]
                if database in known and not known[database]:
                    known[database] = set(self.catalog.list_tables(database))
                if table in known.get(database, ()):
                    view = key.split(".")[-2:]
                    view = view[1] if n == 1 and version is None else "__".join(["q", *view, *([str(version)] if version is not None else [])])
                    self.catalog.read(key, version).createOrReplaceTempView(f"`{view}`")
                    return view, n
        return None

    def resolved(self, text: str) -> str:
        """The text with the catalogue's tables as views: names of several parts, and of versions, are put in its place."""
        c, out, at = Cursor(text), [], 0
        known: dict[str, set[str]] = {d: set() for d in self.catalog.list_databases()}
        while c.at < len(c.tokens):
            t = c.tokens[c.at]
            if t.kind != "name" or (c.at and c.tokens[c.at - 1].text == "."):
                c.at += 1
                continue
            parts = c.name().split(".")
            end = c.tokens[c.at - 1].end
            version = None
            if c.word() == "VERSION" and c.word(1) == "AS" and c.word(2) == "OF":
                version = int(c.tokens[c.at + 3].text)
            if c.word() == "(" or not (found := self._view(parts, version, known)):
                continue
            view, n = found
            if version is not None:
                c.at += 4
                end = c.tokens[c.at - 1].end
            if n == 1 and version is None:
                continue
            put = f"`{parts[n - 1]}`." + ".".join(f"`{p}`" for p in parts[n:]) if len(parts) > n else f"`{view}`"
            follows = c.tokens[c.at] if c.at < len(c.tokens) else None
            if len(parts) == n and not (follows and follows.kind == "name" and follows.word not in _CLAUSES) and not (follows and follows.text == "."):
                put += f" AS `{parts[n - 1]}`"
            out += [text[at : t.start], put]
            at = end
        return "".join(out) + text[at:]

    def query(self, text: str, args: dict | list | None = None) -> DataFrame:
        return run(self.spark, apart(self.resolved(spelled(infix(clauses(text))))), args)

    def _done(self, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))

    # statements

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """Exactly one statement; what changes something says so in one row."""
        found = split(text)
        if len(found) != 1:
            raise QuarryError("ONE_STATEMENT_EXPECTED", found=len(found))
        kind = family(found[0])
        with timed("statement", kind=kind, database=self.database):
            if kind == "query":
                return self.query(found[0], args)
            if kind == "transaction":
                raise QuarryError("TRANSACTIONS_UNSUPPORTED", text=found[0])
            c = Cursor(found[0])
            c.at += 1
            return getattr(self, f"_{kind}")(c)

    def script(self, text: str) -> list[DataFrame]:
        """Several statements, one after the other."""
        return [self.sql(x) for x in split(text)]

    def _insert(self, c: Cursor) -> DataFrame:
        overwrite = c.accept("OVERWRITE")
        if not overwrite:
            c.expect("INTO")
        c.accept("TABLE")
        name = self.full(c.name())
        table = self.catalog.table(name)
        into = [Cursor(x).name() for x in listed(c.group())] if c.word() == "(" and c.word(1) not in ("SELECT", "WITH", "VALUES", "(") else table.columns()
        rows = self.query(c.rest())
        if len(rows.columns) != len(into):
            raise QuarryError("COLUMN_COUNT", expected=len(into), found=len(rows.columns))
        if unknown := {x.lower() for x in into} - {x.lower() for x in table.columns()}:
            raise QuarryError("COLUMN_NOT_FOUND", names=sorted(unknown))
        return self._done(version=table.insert(rows.toDF(*into), overwrite))

    def _where(self, c: Cursor) -> str | None:
        where = c.rest() if c.accept("WHERE") else None
        if where is None:
            c.end()
        return where and self.resolved(where)

    def _delete(self, c: Cursor) -> DataFrame:
        c.expect("FROM")
        name = self.full(c.name())
        alias = c.alias("WHERE") or name.rsplit(".", 1)[-1]
        return self._done(version=self.catalog.table(name).delete(self._where(c), alias))

    def _update(self, c: Cursor) -> DataFrame:
        name = self.full(c.name())
        alias = c.alias("SET") or name.rsplit(".", 1)[-1]
        c.expect("SET")
        values = assigned(c.until(("WHERE",)))
        return self._done(version=self.catalog.table(name).update(self._where(c), {k: self.resolved(v) for k, v in values.items()}, alias))

    def _merge(self, c: Cursor) -> DataFrame:
        c.expect("INTO")
        name = self.full(c.name())
        table = self.catalog.table(name)
        alias = c.alias("USING") or name.rsplit(".", 1)[-1]
        c.expect("USING")
        if c.word() == "(":
            source, source_name = self.query(c.group()), None
        else:
            given = c.name()
            source, source_name = self.query(f"SELECT * FROM {given}"), given.rsplit(".", 1)[-1]
        source_name = c.alias("ON") or source_name
        if source_name is None:
            raise QuarryError("BAD_STATEMENT", expected="an alias of the source")
        c.expect("ON")
        on, clauses = c.until(("WHEN", "MATCHED"), ("WHEN", "NOT", "MATCHED")), []
        while c.accept("WHEN"):
            matched = not c.accept("NOT")
            c.expect("MATCHED")
            if not matched and c.accept("BY"):
                c.expect("TARGET")
            condition = c.until(("THEN",)) if c.accept("AND") else None
            c.expect("THEN")
            if matched and c.accept("DELETE"):
                clauses.append(Clause("delete", condition))
            elif matched:
                c.expect("UPDATE", "SET")
                text = c.until(("WHEN", "MATCHED"), ("WHEN", "NOT", "MATCHED"))
                clauses.append(Clause("update", condition, None if text.strip() == "*" else assigned(text)))
            else:
                c.expect("INSERT")
                if c.accept("*"):
                    clauses.append(Clause("insert", condition))
                else:
                    into = [Cursor(x).name() for x in listed(c.group())] if c.word() == "(" else table.columns()
                    c.expect("VALUES")
                    values = listed(c.group())
                    if len(values) != len(into):
                        raise QuarryError("COLUMN_COUNT", expected=len(into), found=len(values))
                    clauses.append(Clause("insert", condition, dict(zip(into, values))))
        c.end()
        if not clauses:
            raise QuarryError("BAD_STATEMENT", expected="WHEN")
        return self._done(version=table.merge(source, on, clauses, alias, source_name))

    def _create(self, c: Cursor) -> DataFrame:
        if c.accept("DATABASE") or c.accept("SCHEMA"):
            maybe = c.accept("IF", "NOT", "EXISTS")
            name = c.name()
            c.end()
            self.catalog.create_database(name.rsplit(".", 1)[-1], maybe)
            return self._done(created=name)
        if not c.accept("TABLE"):
            raise QuarryError("UNSUPPORTED_STATEMENT", text=c.text[:60])
        maybe = c.accept("IF", "NOT", "EXISTS")
        name, columns = self.full(c.name()), None
        if c.word() == "(":
            columns = [self._defined(x) for x in listed(c.group())]
        kind, options, location = "versioned", {}, None
        while c.at < len(c.tokens) and c.word() != "AS":
            if c.accept("USING"):
                kind = c.name().lower()
            elif c.accept("LOCATION"):
                location = c.tokens[c.at].value
                c.at += 1
            elif c.accept("WITH") or c.accept("OPTIONS") or c.accept("TBLPROPERTIES"):
                options |= properties(c.group())
            else:
                raise QuarryError("BAD_STATEMENT", unexpected=c.rest()[:30])
        rows = self.query(c.rest()) if c.accept("AS") else None
        if (rows is None) == (columns is None):
            raise QuarryError("BAD_STATEMENT", expected="columns or a query")
        entry = self.catalog.create_table(name, columns if rows is None else rows, options, maybe, location, kind)
        return self._done(created=".".join(entry.name))

    @staticmethod
    def _defined(text: str) -> tuple[str, str, bool]:
        c = Cursor(text)
        name = c.name()
        kind = c.until(("NOT", "NULL"), ("NULL",), ("COMMENT",), ("DEFAULT",))
        return name, kind, not c.accept("NOT", "NULL")

    def _drop(self, c: Cursor) -> DataFrame:
        kind = c.word()
        if kind not in ("TABLE", "DATABASE", "SCHEMA"):
            raise QuarryError("UNSUPPORTED_STATEMENT", text=c.text[:60])
        c.at += 1
        maybe = c.accept("IF", "EXISTS")
        name = c.name()
        if kind == "TABLE":
            c.end()
            self.catalog.drop_table(self.full(name), maybe)
        else:
            cascade = c.accept("CASCADE") or (c.accept("RESTRICT") and False)
            c.end()
            self.catalog.drop_database(name.rsplit(".", 1)[-1], cascade, maybe)
        return self._done(dropped=name)

    def _alter(self, c: Cursor) -> DataFrame:
        c.expect("TABLE")
        name = self.full(c.name())
        if c.accept("RENAME", "TO"):
            return self._done(renamed=".".join(self.catalog.rename_table(name, self.full(c.name())).name))
        if c.accept("SET", "TBLPROPERTIES"):
            self.catalog.set_options(name, properties(c.group()))
            return self._done(altered=name)
        if c.accept("UNSET", "TBLPROPERTIES"):
            c.accept("IF", "EXISTS")
            self.catalog.set_options(name, {}, tuple(Cursor(x).tokens[0].value for x in listed(c.group())))
            return self._done(altered=name)
        table, action = self.catalog.table(name), c.word()
        c.at += 1
        many = c.accept("COLUMNS")
        _ = many or c.accept("COLUMN")
        if action == "ADD":
            added = listed(c.group()) if c.word() == "(" else [c.rest()]
            change = {"add": {n: types.parse(t).simpleString() for n, t, _ in map(self._defined, added)}}
        elif action == "DROP":
            change = {"drop": [Cursor(x).name() for x in listed(c.group() if c.word() == "(" else c.rest())]}
        elif action == "RENAME":
            old = c.name()
            c.expect("TO")
            change = {"rename": {old: c.name()}}
        elif action == "ALTER":
            old = c.name()
            c.accept("SET", "DATA")
            c.expect("TYPE")
            change = {"cast": {old: types.parse(c.rest()).simpleString()}}
        else:
            raise QuarryError("UNSUPPORTED_STATEMENT", text=c.text[:60])
        return self._done(version=table.alter(**change))

    def _use(self, c: Cursor) -> DataFrame:
        _ = c.accept("DATABASE") or c.accept("SCHEMA")
        name = c.name()
        c.end()
        parts = name.split(".")
        if len(parts) > 2 or (len(parts) == 2 and parts[0] != self.catalog.name):
            raise QuarryError("CATALOG_NOT_FOUND", name=name)
        if parts[-1] not in self.catalog.list_databases():
            raise QuarryError("DATABASE_NOT_FOUND", name=parts[-1])
        for view in self.spark.catalog.listTables():
            if view.isTemporary:
                self.spark.catalog.dropTempView(view.name)
        self.database = parts[-1]
        return self._done(database=self.database)

    def _put(self, key: str, value: str, scope: str = "session") -> DataFrame:
        if key.startswith("spark."):
            self.spark.conf.set(key, value)
            return self._done(key=key, value=value)
        self.settings.set(scope, key, value)
        if key in _CONF:
            held = self.settings.get(key)
            self.spark.conf.set(_CONF[key], str(held).lower() if isinstance(held, bool) else str(held))
        return self._done(key=key, value=str(self.settings.get(key)))

    def _set(self, c: Cursor) -> DataFrame:
        if c.accept("TIME", "ZONE"):
            return self._put("timezone", c.tokens[c.at].value)
        scope = "system" if c.accept("GLOBAL") else "session"
        _ = c.accept("SESSION") or c.accept("LOCAL")
        key = c.name()
        if not (c.accept("=") or c.accept("TO")):
            c.end()
            return self._done(key=key, value=str(self.spark.conf.get(key, None) if key.startswith("spark.") else self.settings.get(key)))
        value = c.rest()
        return self._put(key, value[1:-1] if value[:1] in ("'", '"') else value, scope)

    def _reset(self, c: Cursor) -> DataFrame:
        key = c.name()
        self.settings.unset("session", key)
        if key in _CONF:
            self.spark.conf.unset(_CONF[key])
        return self._done(key=key, value=str(self.settings.get(key)))

    def _explain(self, c: Cursor) -> DataFrame:
        kind = next((k for k in ("logical", "physical", "distributed") if c.accept(k.upper())), "distributed")
        return self._done(plan=explain(self.query(c.rest()), kind))

    def _show(self, c: Cursor) -> DataFrame:
        if c.accept("DATABASES") or c.accept("SCHEMAS"):
            return self.spark.createDataFrame([(x,) for x in self.catalog.list_databases()], "database string")
        if c.accept("TBLPROPERTIES"):
            return self.spark.createDataFrame(sorted(self.catalog.entry(self.full(c.name())).options.items()), "key string, value string")
        c.expect("TABLES")
        database = c.name() if c.accept("IN") or c.accept("FROM") else self.database
        if database is None:
            raise QuarryError("NO_DEFAULT", name="database")
        return self.spark.createDataFrame([(database, x) for x in self.catalog.list_tables(database)], "database string, table string")

    def _describe(self, c: Cursor) -> DataFrame:
        c.accept("TABLE")
        kinds = self.catalog.read(self.full(c.name())).dtypes
        return self.spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(kinds)], "place int, column_name string, data_type string")

    def _analyze(self, c: Cursor) -> DataFrame:
        c.expect("TABLE")
        return analyze(self.catalog.read(self.full(c.name())))

    def _prepare(self, c: Cursor) -> DataFrame:
        name = c.name()
        c.expect("AS")
        if family(c.rest()) != "query":
            raise QuarryError("UNSUPPORTED_STATEMENT", text=c.rest()[:60])
        self.prepared[name] = c.rest()
        return self._done(prepared=name)

    def _execute(self, c: Cursor) -> DataFrame:
        name = c.name()
        if name not in self.prepared:
            raise QuarryError("NOT_PREPARED", name=name)
        values = c.group() if c.word() == "(" else ""
        return self.query(self.prepared[name], list(self.spark.sql(f"SELECT {values}").first()) if values else None)

    def _deallocate(self, c: Cursor) -> DataFrame:
        name = c.name()
        if self.prepared.pop(name, None) is None:
            raise QuarryError("NOT_PREPARED", name=name)
        return self._done(deallocated=name)

    def _optimize(self, c: Cursor) -> DataFrame:
        return self._done(version=self.catalog.table(self.full(c.name())).compact())

    def _vacuum(self, c: Cursor) -> DataFrame:
        return self._done(deleted=self.catalog.table(self.full(c.name())).cleanup())
