"""Times the headline queries, and DuckDB's SQL of them on the same files: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data
and cores."""

from __future__ import annotations

import json
import os
import time

from quarry import catalogue
from quarry.session import build_session
from quarry.tables import NAMES

HEADLINE = (
    "join_chain4", "filter_project", "agg_group", "agg_decimal", "agg_distinct_multi", "join_inner", "join_left", "join_theta", "join_expr_key", "join_asof",
    "join_interval", "window_rank", "window_frame", "rollup", "topk", "subq_correlated", "fn_string", "merge_upsert", "tumble", "session_gap",
)


def beside(sf: str, cpus: str) -> dict[str, float]:
    """Seconds that DuckDB takes for the same queries, second run; empty without DuckDB."""
    try:
        import duckdb
    except ImportError:
        return {}
    c, out, texts = duckdb.connect(config={"threads": int(cpus)}), {}, catalogue.oracle_sql()
    for name in NAMES:
        c.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name in HEADLINE:
        if name in texts:
            c.execute(texts[name]).fetchall()
            began = time.perf_counter()
            c.execute(texts[name]).fetchall()
            out[name] = round(time.perf_counter() - began, 4)
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalogue.queries(), {}
    run = lambda name: queries[name](spark, sf).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        run(name)  # warm up: class loading, code generation
        began = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "headline queries, second run", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf, "duckdb": beside(sf, cpus)}))


if __name__ == "__main__":
    main()
