"""Plan shapes, catalogue, mutation, settings, statements, types, streams."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import catalogue, log, sources, streaming
from quarry import functions as X
from quarry.functions.dialect import apart, clauses, infix, spelled
from quarry.functions.registry import Functions
from quarry.operators.mutate import Table
from quarry.operators.relational import as_of
from quarry.plans import exchange, settings, statements, types
from quarry.plans.catalog import Catalog, segments
from quarry.plans.errors import QuarryError
from quarry.plans.statements import Session
from quarry.tables import read

DATA = "/root/testdata/sf0.001"


def code(error):
    return error.value.code


def test_global_aggregate_gathers_partial_results(spark):
    df = read(spark, DATA, "orders").agg(F.count("o_orderkey"))
    assert exchange.exchanges(df) == ["SinglePartition"]
    assert "partial_count" in statements.explain(df)


def test_equi_join_hashes_both_sides_by_the_expression(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = read(spark, DATA, "part"), read(spark, DATA, "part").select(F.lower("p_brand").alias("b"))
        df = a.join(b, F.lower("p_brand") == F.lower("b"))
        assert exchange.exchanges(df).count("hashpartitioning") == 2
        assert "lower(" in statements.explain(df, "distributed")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(spark):
    text = statements.explain(read(spark, DATA, "lineitem").filter("l_quantity > 45").select("l_orderkey"))
    assert "GreaterThan(l_quantity,45.0)" in text and "l_tax" not in text


def test_replicate_checks_the_size(spark):
    assert "BroadcastExchange" in exchange.exchanges(read(spark, DATA, "supplier").join(exchange.replicate(read(spark, DATA, "nation")), F.col("s_nationkey") == F.col("n_nationkey")))
    with pytest.raises(QuarryError) as e:
        exchange.replicate(read(spark, DATA, "lineitem"), 100)
    assert code(e) == "TOO_LARGE_TO_REPLICATE"


def test_catalogue(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    c.create_database("sales")
    for again in (lambda: c.create_database("sales"), lambda: c.entry("sales.none"), lambda: c.create_table("nowhere.t", [])):
        with pytest.raises(QuarryError):
            again()
    e = c.create_table("sales.orders", [("id", "INT", False), ("name", "TEXT", True)], {"bucket": "1"})
    c.table("sales.orders").insert(spark.createDataFrame([(1, "a"), (2, None)], "id int, name string"))
    assert c.rename_table("sales.orders", "sales.orders_v2").table_id == e.table_id
    assert c.set_options("sales.orders_v2", {"bucket": "2"}).options == {"bucket": "2"}
    assert c.list_tables("sales") == ["orders_v2"] and c.read("sales.orders_v2").count() == 2
    with pytest.raises(QuarryError) as err:
        c.drop_database("sales")
    assert code(err) == "DATABASE_NOT_EMPTY"
    c.drop_database("sales", cascade=True)
    assert c.list_databases() == []


def test_names():
    assert segments("t", "c", "d") == ("c", "d", "t") and segments("a.b.c") == ("a", "b", "c")
    for bad in ("", "a..b", "a.b.c.d", "t"):
        with pytest.raises(QuarryError):
            segments(bad)


def test_mutation(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    with pytest.raises(QuarryError):
        t.read()
    t.publish(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"))
    t.delete(F.col("v") == "a")
    assert sorted(r.k for r in t.read().collect()) == [2, 3]  # unknown isn't true
    t.update(F.col("k") == 3, {"v": F.lit("z")})
    t.merge(spark.createDataFrame([(3, "m"), (9, "n")], "k int, v string"), ["k"])
    assert sorted(map(tuple, t.read().collect())) == [(2, None), (3, "m"), (9, "n")]
    with pytest.raises(QuarryError) as e:
        t.merge(spark.createDataFrame([(3, "x"), (3, "y")], "k int, v string"), ["k"])
    assert code(e) == "MERGE_CARDINALITY"
    t.alter(cast={"k": "bigint"}, add={"n": "double"}, rename={"v": "w"})
    assert t.read().dtypes == [("k", "bigint"), ("w", "string"), ("n", "double")]
    with pytest.raises(QuarryError):
        t.alter(add={"W": "int"})
    assert sorted(r.k for r in t.read(0).collect()) == [1, 2, 3]  # former versions stay until they are cleaned up
    t.insert(spark.createDataFrame([(10,)], "k int"))
    t.compact()
    assert t.size()[0] == 1
    assert t.cleanup() == 6 and t.read().count() == 4
    with pytest.raises(QuarryError) as e:
        t.read(0)
    assert code(e) == "VERSION_NOT_FOUND"


def test_a_refused_writer_changes_nothing(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    rows = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k int")
    t.publish(rows(1, 2))
    first, second = Table(spark, t.path), Table(spark, t.path)
    before = first.manifest()
    second.publish(rows(7))
    stages = lambda: sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("stage-"))
    had = stages()
    for write in (lambda: first.publish(rows(8), after=before["version"]), lambda: first.publish(rows(9), after=0)):
        with pytest.raises(QuarryError) as e:
            write()
        assert code(e) == "CONFLICT" and [r.k for r in t.read().collect()] == [7] and stages() == had
    assert sorted(r.k for r in t.read(0).collect()) == [1, 2]


def test_writers_at_once(spark, tmp_path):
    """Appends of several writers all arrive; of changes made from one version one wins."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/t"
    Table(spark, path).publish(spark.range(3).selectExpr("cast(id as int) as k"))

    def append(k):
        return Table(spark, path).insert(spark.createDataFrame([(k,)], "k int"))

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(append, range(100, 104)))
    assert sorted(versions) == [1, 2, 3, 4] and sorted(r.k for r in Table(spark, path).read().collect()) == [0, 1, 2, 100, 101, 102, 103]


def test_appends_and_changes_keep_other_files(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    t.publish(spark.createDataFrame([(1, "a")], "k int, v string").coalesce(1))
    t.insert(spark.createDataFrame([(2, "b")], "k int, v string").coalesce(1))
    t.insert(spark.createDataFrame([(3, "c")], "k int, v string").coalesce(1))
    files = lambda: {f["path"] for f in t.manifest()["files"]}
    before = files()
    t.update("k = 2", {"v": "upper(v)"})
    assert len(before & files()) == 2 and len(files()) == 3
    t.delete("k in (1)")
    assert sorted(map(tuple, t.read().collect())) == [(2, "B"), (3, "c")]
    version = t.version()
    assert t.update("k = 99", {"v": "'x'"}) == version  # no hit, no version
    t.delete("k = 99")


def test_lost_writers_are_taken_back(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    t.publish(spark.range(2))
    (tmp_path / "t" / "version-1").write_text('{"version": 1, "fil')
    (tmp_path / "t" / "stage-lost").mkdir()
    with pytest.raises(QuarryError) as e:
        t.read()
    assert code(e) == "COMMIT_IN_DOUBT" and t.recover() and not t.recover() and t.read().count() == 2
    t.cleanup()
    assert not (tmp_path / "t" / "stage-lost").exists() and t.read().count() == 2


def test_merge_upsert_adds_orders_whose_new_key_is_taken(spark, tmp_path):
    kind = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    spark.createDataFrame([(10, 1, "F", 1.0), (2_000_010, 2, "O", 2.0), (20, 3, "F", 3.0), (20, 4, "P", 4.0), (None, 5, "F", 5.0)], kind).write.parquet(f"{tmp_path}/orders.parquet")
    found = catalogue.queries()["merge_upsert"](spark, f"{tmp_path}").collect()
    view = duckdb.connect()
    view.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, view.sql(catalogue.oracle_sql()["merge_upsert"]).fetchall()))


def test_a_source_of_a_merge_is_worked_out_once(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    t.publish(spark.range(200).select(F.col("id").alias("k"), F.lit(0.0).alias("v")))
    t.merge(spark.range(400).select((F.floor(F.rand() * 1000) * 1000 + F.col("id")).alias("k"), F.lit(1.0).alias("v")), ["k"])
    assert t.read().count() == t.read().select("k").distinct().count()


def test_session(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/w")
    for text in ("select 1; select 2", "commit", "grant x to y", "use nowhere", "create view v as select 1", "merge into a.b using c on 1=1"):
        with pytest.raises(QuarryError):
            s.sql(text)
    s.script("create database a; use a; create table t (k int not null, v text) with ('owner' = 'x;y'); insert into t (v, k) values ('one; two', 1)")
    assert [tuple(r) for r in s.sql("select * from a.t").collect()] == [(1, "one; two")]
    for text, expected in (("insert into t values (1)", "COLUMN_COUNT"), ("insert into t (k, z) values (1, 2)", "COLUMN_NOT_FOUND"), ("update t set z = 1", "COLUMN_NOT_FOUND"), ("create table t (a int)", "TABLE_EXISTS"), ("create table u (a int) using avro", "UNSUPPORTED_FORMAT"), ("drop table none", "TABLE_NOT_FOUND"), ("drop database a", "DATABASE_NOT_EMPTY"), ("alter table t drop column z", "COLUMN_NOT_FOUND"), ("execute p", "NOT_PREPARED"), ("set nothing = 1", "UNKNOWN_SETTING")):
        with pytest.raises(QuarryError) as e:
            s.sql(text)
        assert code(e) == expected, text
    again = Session(spark, f"file://{tmp_path}/w", database="a")  # another driver
    assert again.sql("select v from t where k = :k", {"k": 1}).first().v == "one; two"
    assert again.catalog.entry("a.t").options == {"owner": "x;y"}
    s.sql("set time zone 'Asia/Tokyo'")
    assert (s.spark.conf.get("spark.sql.session.timeZone"), again.spark.conf.get("spark.sql.session.timeZone")) == ("Asia/Tokyo", "UTC")
    s.sql("reset timezone")
    location = tmp_path / "w" / "a"
    assert list(location.iterdir())
    s.sql("drop table t")
    assert not list(location.iterdir()) and s.catalog.list_tables("a") == []


def test_dialect():
    assert spelled("select strpos(a, 'strpos(x, y)'), t.today() from t") == "select instr(a, 'strpos(x, y)'), t.today() from t"
    assert spelled("select approx_median(trunc(x)), log(2, x)") == "select percentile_approx((sign(x) * floor(abs(x))), 0.5D), log(2, x)"
    with pytest.raises(QuarryError):
        spelled("select digest(x, 'none')")


def test_clauses():
    assert clauses("select a from t qualify rank() over (order by b) = 1 limit 3") == "SELECT * EXCEPT (__kept) FROM (select a, (rank() over (order by b) = 1) AS __kept from t) WHERE __kept limit 3"
    assert clauses("select 'qualify' from t") == "select 'qualify' from t"
    with pytest.raises(QuarryError):
        clauses("select distinct a from t qualify rank() over (order by b) = 1")


def test_infix_leaves_other_text_alone():
    for text in ("select a - b, x -> x + 1", "select ~a, '~', b - -1", "select transform(s, x -> x + 1)", "select 'SIMILAR TO' as t"):
        assert infix(text) == text
    assert infix("where t.a !~* 'x' and b similar to 'a.%'") == "where t.a NOT RLIKE '(?i)x' and b RLIKE '^(?:a\\\\..*)$'"


def test_python_data_source(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Squares(DataSource):
        @classmethod
        def name(cls):
            return "squares"

        def schema(self):
            return "n int, square int"

        def reader(self, schema):
            most = int(self.options["path"])

            class Reader(DataSourceReader):
                def partitions(self):
                    return [InputPartition(k) for k in range(2)]

                def read(self, partition):
                    for n in range(partition.value, most, 2):
                        yield n, n * n

            return Reader()

    sources.register_source(spark, Squares)
    assert sorted(map(tuple, sources.read(spark, "squares", "4").collect())) == [(0, 0), (1, 1), (2, 4), (3, 9)]


def test_functions_have_one_name_each(spark):
    def twice(x: pd.Series) -> pd.Series:
        return 2 * x

    f = Functions(spark.newSession())
    f.scalar("twice", "long", twice)
    assert f.spark.sql("select twice(id) as x from range(3)").agg(F.sum("x")).first()[0] == 6
    for name in ("twice", "upper"):
        with pytest.raises(QuarryError):
            f.scalar(name, "long", twice)


def test_memory_source_and_engines(spark):
    df = spark.range(3)
    sources.write(df, "memory", "t-mem")
    with pytest.raises(QuarryError):
        sources.write(df, "memory", "t-mem")
    sources.write(df, "memory", "t-mem", "append")
    assert sources.read(spark, "memory", "t-mem").count() == 6 and "memory" in sources.formats()
    sources.register("numbers", lambda s, path, options: s.range(int(path)))
    assert sources.read(spark, "numbers", "5").count() == 5
    for bad in (lambda: sources.register("numbers", None), lambda: sources.write(df, "numbers", "x"), lambda: sources.read(spark, "memory", "none")):
        with pytest.raises(QuarryError):
            bad()


def test_distinct_counts_stand_apart_from_large_states(spark, tmp_path):
    df = Session(spark, f"file://{tmp_path}").query("select count(distinct k % 3) + 1 as n, median(k) as m from (values (1), (2), (5), (null)) t(k) where k > 1")
    assert tuple(df.first()) == (2, 3.5)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("distinct" in x and "percentile" in x for x in plan.splitlines())
    for same in ("select count(distinct a), median(b) from t", "select a, count(distinct b) as n, median(b) as m from t group by a", "select count(distinct a) as n, median(b) as m from t where rand() < b", "select count(distinct a) as n, sum(b) as m from t"):
        assert apart(same) == same


def test_settings():
    s = settings.Settings()
    s.register(settings.Setting("x.threads", int, 8, ("system", "session")), settings.Setting("x.spill", bool, False))
    s.load_toml("[x]\nthreads = 4\n")
    assert s.get("x.threads") == 4
    s.set("session", "x.threads", "2")
    s.set("statement", "x.spill", "true")
    assert (s.get("x.threads"), s.get("x.spill")) == (2, True)
    for scope, key, value in (("statement", "x.threads", 1), ("session", "y", 1), ("session", "x.threads", "many"), ("session", "x.spill", "maybe")):
        with pytest.raises(QuarryError):
            s.set(scope, key, value)


def test_statements(spark):
    assert statements.split("select ';' ; -- a; b\nselect 2;") == ["select ';'", "-- a; b\nselect 2"]
    assert [statements.family(x) for x in ("/* c */ select 1", "(select 1)", "merge into t using s on 1=1", "begin", "set x = 1")] == ["query", "query", "merge", "transaction", "set"]
    assert statements.run(spark, "select :a + 1 as b", {"a": 2}).first().b == 3
    for text in ("select 1; select 2", "commit", "grant x to y", ""):
        with pytest.raises(QuarryError):
            statements.run(spark, text)


def test_types():
    for name, kind in (("decimal", T.DecimalType(38, 0)), ("numeric(18, 2)", T.DecimalType(18, 2)), ("varchar(9)", T.StringType()), ("timestamp with time zone", T.TimestampType()), ("timestamp", T.TimestampNTZType()), ("datetime(3)", T.TimestampNTZType()), ("double precision", T.DoubleType())):
        assert types.parse(name) == kind and types.parse(types.spell(kind)) == kind
    for bad in ("array<int>", "json", "uuid", "interval"):
        with pytest.raises(QuarryError):
            types.parse(bad)


def test_functions(spark):
    r = spark.createDataFrame([(12, 18, -2.57), (0, 5, 2.57), (2**40, 2**30, 0.0)], "a long, b long, x double").select(X.gcd(F.col("a"), F.col("b")), X.lcm(F.col("a"), F.col("b")), X.trunc(F.col("x"), 1)).collect()
    assert [tuple(x) for x in r] == [(6, 36, -2.5), (5, 0, 2.5), (2**30, 2**40, 0.0)]


def test_as_of_takes_the_latest_at_or_before(spark):
    l = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, t int, id int")
    r = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("c", 1, 1)], "k string, t int, v int")
    assert sorted(tuple(x) for x in as_of(l, r, ["k"], "t", ["v"]).select("id", "asof_v").collect()) == [(1, 50), (2, None), (3, None)]


def test_sources(spark, tmp_path):
    df = read(spark, DATA, "region")
    for kind in ("parquet", "orc", "json", "csv"):
        sources.write(df, kind, f"file://{tmp_path}/{kind}")
        assert sorted(map(tuple, sources.read(spark, kind, f"file://{tmp_path}/{kind}", df.schema).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(QuarryError):
        sources.read(spark, "none", "x")


def test_stream_equals_batch(spark, tmp_path):
    read(spark, DATA, "events").repartition(3).write.parquet(f"{tmp_path}/events")
    stream = streaming.read_files(spark, f"{tmp_path}/events", read(spark, DATA, "events").schema)
    q = lambda df: streaming.tumble(df, "ts", "1 hour", ["event_type"], F.count("*").alias("n"))
    got = streaming.run_to_end(q(stream), "tumbled")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, q(read(spark, DATA, "events")).collect()))


def test_stream_join_equals_batch(spark, tmp_path):
    read(spark, DATA, "events").repartition(3).write.parquet(f"{tmp_path}/events")
    schema = read(spark, DATA, "events").schema

    def q(df):
        bought = df.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("bought"), F.col("ts").alias("at"))
        return streaming.join_within(df.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "at", "0 minutes", "30 minutes", "10000 days").select("event_id", "bought")

    want = sorted(map(tuple, q(read(spark, DATA, "events")).collect()))
    got = streaming.run_to_end(q(streaming.read_files(spark, f"{tmp_path}/events", schema)), "joined", "append")
    assert want and sorted(map(tuple, got.collect())) == want


def test_stream_state_equals_batch(spark, tmp_path):
    read(spark, DATA, "events").repartition(3).write.parquet(f"{tmp_path}/events")
    stream = streaming.read_files(spark, f"{tmp_path}/events", read(spark, DATA, "events").schema)
    got = streaming.run_to_end(streaming.totals(stream, "user_id", "value"), "totals", "update")
    last = {r.user_id: (r.n, round(r.total, 6)) for r in got.orderBy("n").collect()}
    assert last == {r.user_id: (r.n, round(r.total, 6)) for r in streaming.totals(read(spark, DATA, "events"), "user_id", "value").collect()}


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    row = lambda minute: (f"2024-01-01 00:{minute:02d}:00",)
    for k, minutes in enumerate(([1, 2], [50], [45], [3, 59])):  # minute 3 comes when the watermark is at 40
        df = spark.createDataFrame([row(m) for m in minutes], "t string").select(F.to_timestamp("t").alias("ts")).coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/late")
        for f in (tmp_path / "late").glob("*.parquet"):  # files are read in the order of their times
            if not (tmp_path / f"seen-{f.name}").exists():
                (tmp_path / f"seen-{f.name}").touch()
                os.utime(f, (1_700_000_000 + 100 * k,) * 2)
    stream = streaming.read_files(spark, f"{tmp_path}/late", "ts timestamp")
    got = streaming.run_to_end(streaming.tumble(stream, "ts", "10 minutes", [], F.count("*").alias("n")), "late", "append")
    assert sorted((r.window_start.minute, r.n) for r in got.collect())[0] == (0, 2)


def test_first_seen(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:01:00")], "k int, t string").select("k", F.to_timestamp("t").alias("ts")).repartition(2).write.parquet(f"{tmp_path}/seen")
    stream = streaming.read_files(spark, f"{tmp_path}/seen", "k int, ts timestamp")
    assert sorted(r.k for r in streaming.run_to_end(streaming.first_seen(stream, ["k"], "ts"), "seen", "append").collect()) == [1, 2]


def test_events_are_lines_of_json(spark, tmp_path):
    import io
    import json

    out = io.StringIO()
    log.setup("INFO", out)
    log.setup("INFO", out)
    s = Session(spark, f"file://{tmp_path}/w")
    s.sql("select 1")
    with pytest.raises(QuarryError):
        s.sql("use nowhere")
    lines = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [(x["event"], x["kind"], x.get("error")) for x in lines] == [("statement", "query", None), ("statement", "use", "DATABASE_NOT_FOUND")]
