import json
from datetime import datetime, timedelta

import pytest
from conftest import SMALL, rows

from pyspark.sql import functions as F

from salesengine.__main__ import main
from salesengine.functions.filters import Filters
from salesengine.operators import filtered, snapshot
from salesengine.plans import job, registry
from salesengine.sources import results, versions
from salesengine.sources.jdbc import Connection, Month, Slices, bounds_query, fact_slices, months_query
from salesengine.sources.scratch import scratch_folder
from salesengine.sources.star import TABLE_NAMES, load_files
from salesengine.sources.testcatalog import catalog_state
from salesengine.sources.testmap import load_star


@pytest.fixture(scope="module")
def t(spark):
    return load_star(spark, SMALL)


@pytest.fixture(scope="module", params=["parquet", "json"])
def published(request, spark, t):
    return job.publish_snapshot(spark, t, scratch_folder(spark), request.param), request.param


def test_every_module_is_there(spark, published):
    folder, file_format = published
    found = rows(results.completeness(spark, folder, file_format))
    assert {r["module"]: r["status"] for r in found} == {name: "ok" for name in results.MODULES}
    listed = rows(results.manifest(spark, folder, file_format))
    assert [r["module"] for r in listed] == list(results.MODULES)
    assert all(r["size"] > 0 and r["path"].endswith(r["module"]) for r in listed)


def test_read_back(spark, t, published):
    folder, file_format = published
    back = results.read_result(spark, folder, "trend", file_format)
    assert {(r["source"], r["result_file"]) for r in rows(back)} == {("spark", "trend")}
    stamp = back.first()["generated_at"]
    assert len(stamp) == 20 and stamp.endswith("Z")
    figures = back.drop("source", "generated_at", "result_file").orderBy("year", "month")
    assert rows(figures) == rows(snapshot.trend(t))
    assert results.read_result(spark, folder, "nothing", file_format) is None


def test_alerts_from_files_equal_alerts_from_tables(spark, t, published):
    folder, file_format = published
    back = results.read_result(spark, folder, "alerts", file_format)
    names = ["rule_order", "type", "description", "metric_value", "metric_reference"]
    assert rows(back.select(names).orderBy("rule_order")) == rows(
        job.snapshot_alerts(t).select(names)
    )


def test_report_context(spark, published):
    folder, file_format = published
    (row,) = rows(results.report_context(spark, folder, file_format))
    context = json.loads(row["context"])
    assert list(context) == list(results.MODULES)
    assert context["kpis"]["order_count"] > 0 and context["kpis"]["source"] == "spark"
    months = [m["year_month"] for m in context["trend"]["items"]]
    assert months == sorted(months) and len(months) == 80
    amounts = [p["sales_amount"] for p in context["top_products"]["items"]]
    assert amounts == sorted(amounts, reverse=True) and len(amounts) == 50


def test_missing_modules(spark, t):
    folder = scratch_folder(spark)
    assert {r["status"] for r in rows(results.completeness(spark, folder))} == {"missing"}
    marker = {"status": "spark_result_missing", "items": []}
    nothing = json.loads(rows(results.report_context(spark, folder))[0]["context"])
    assert nothing == {name: marker for name in results.MODULES}
    results.publish(snapshot.kpis(t), folder, "kpis")
    status = {r["module"]: r["status"] for r in rows(results.completeness(spark, folder))}
    assert status.pop("kpis") == "ok" and set(status.values()) == {"missing"}
    context = json.loads(rows(results.report_context(spark, folder))[0]["context"])
    assert context.pop("kpis")["order_count"] > 0
    assert all(module == marker for module in context.values())


def test_envelope_is_kept(spark, t):
    folder = scratch_folder(spark)
    module = snapshot.kpis(t).selectExpr("*", "'elsewhere' AS source", "'then' AS generated_at")
    results.publish(module, folder, "kpis")
    row = results.read_result(spark, folder, "kpis").first()
    assert (row["source"], row["generated_at"]) == ("elsewhere", "then")


def test_published_only_without_filters(spark, t, published):
    run, file_format = published
    folder = run.rsplit("/", 1)[0]

    def served(module, f=Filters(), **more):
        return rows(
            job.read_or_compute(spark, t, folder, module, f, file_format=file_format, **more)
        )

    assert {r["source"] for r in served("kpis")} == {"spark"}
    (live,) = served("kpis", Filters(channel="Internet"))
    assert live["source"] == "live"
    assert len(served("top_products", limit=37)) == 37
    assert len(served("top_products")) == 10
    with pytest.raises(ValueError):
        served("top_products", limit=51)


@pytest.mark.parametrize("module", results.MODULES)
def test_live_where_nothing_is_published(spark, t, module):
    folder = scratch_folder(spark)
    found = rows(job.read_or_compute(spark, t, folder, module, state=catalog_state(t)))
    assert found and {r["source"] for r in found} == {"live"}


def test_empty_published_module_is_served(spark, t):
    folder = scratch_folder(spark)
    results.publish(snapshot.trend(t).where("false"), f"{folder}/one", "trend")
    versions.add(spark, folder, "one")
    assert rows(job.read_or_compute(spark, t, folder, "trend")) == []


@pytest.mark.parametrize("file_format", ["parquet", "json"])
def test_empty_and_missing_modules(spark, t, file_format):
    folder = scratch_folder(spark)
    results.publish(snapshot.kpis(t), folder, "kpis", file_format)
    results.publish(snapshot.trend(t).where("false"), folder, "trend", file_format)
    status = {r["module"]: (r["status"], r["rows"]) for r in rows(results.completeness(spark, folder, file_format))}
    assert status.pop("kpis") == ("ok", 1) and status.pop("trend") == ("empty", 0)
    assert set(status.values()) == {("missing", None)}
    sizes = {r["module"]: r["size"] for r in rows(results.manifest(spark, folder, file_format))}
    assert sizes["kpis"] > 0 and sizes["trend"] is not None and sizes["alerts"] is None


def test_a_failed_run_is_never_served(spark, t, monkeypatch):
    folder = scratch_folder(spark)
    first = job.publish_snapshot(spark, t, folder, modules=("kpis", "trend"))
    monkeypatch.setitem(job.METRICS, "trend", lambda tables: tables.internet.select("nothing"))
    with pytest.raises(Exception):
        job.publish_snapshot(spark, t, folder, modules=("kpis", "trend"))
    assert results.current_run(spark, folder) == first
    served = rows(job.read_or_compute(spark, t, folder, "trend"))
    assert {r["source"] for r in served} == {"spark"} and len(served) == 80
    monkeypatch.undo()
    second = job.publish_snapshot(spark, t, folder, modules=("kpis", "trend"))
    assert results.current_run(spark, folder) == second != first
    stamps = {results.read_result(spark, second, m).first()["generated_at"] for m in ("kpis", "trend")}
    assert len(stamps) == 1


def test_batch_job_from_files(spark, t, tmp_path, capsys):
    for name, table in TABLE_NAMES.items():
        getattr(t, name).write.parquet(f"{tmp_path}/warehouse/{table}")
    arguments = ["--files", f"{tmp_path}/warehouse", "--output", f"{tmp_path}/out"]
    assert main(arguments, spark) == 0
    assert capsys.readouterr().out.count(": ok, ") == len(results.MODULES)
    loaded = load_files(spark, f"{tmp_path}/warehouse")
    assert rows(snapshot.kpis(loaded)) == rows(snapshot.kpis(t))
    run = results.current_run(spark, f"{tmp_path}/out")
    assert rows(results.read_result(spark, run, "trend").drop("source", "generated_at", "result_file").orderBy("year", "month")) == rows(snapshot.trend(t))


def test_batch_job_reports_what_is_empty(spark, star, tmp_path):
    empty = star()
    for name, table in TABLE_NAMES.items():
        getattr(empty, name).write.parquet(f"{tmp_path}/warehouse/{table}")
    arguments = ["--files", f"{tmp_path}/warehouse", "--output", f"{tmp_path}/out", "--format", "json"]
    assert main(arguments, spark) == 1


def test_dimensions_follow_their_files(spark, tmp_path):
    for name in ("orders", "customer", "lineitem", "part", "nation", "region"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = load_star(spark, str(tmp_path))
    assert load_star(spark, str(tmp_path)) is before
    late = spark.read.parquet(f"{SMALL}/orders.parquet").limit(1)
    late.withColumn("o_orderdate", F.lit("2031-01-01").cast(late.schema["o_orderdate"].dataType)).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert load_star(spark, str(tmp_path)).date.where("CalendarYear = 2031").count() == 1


def test_unknown_module(spark, t):
    with pytest.raises(ValueError, match="unknown module"):
        job.read_or_compute(spark, t, scratch_folder(spark), "profits")


def test_text(spark):
    folder = scratch_folder(spark)
    text = "First line\nsecond line, é\n\nlast"
    results.write_text(spark, folder, "report", text)
    assert [r["value"] for r in rows(results.read_text(spark, folder, "report"))] == [text]
    assert results.read_text(spark, folder, "other") is None


def test_scratch_folder_is_the_shared_one(spark):
    assert scratch_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_folder(spark) != scratch_folder(spark)


def test_invariants(t):
    total = rows(snapshot.kpis(t))[0]["total_sales"]
    for module in (snapshot.trend(t), snapshot.channels(t)):
        assert sum(r["sales_amount"] for r in rows(module)) == pytest.approx(total, abs=0.01)
    assert sum(r["sales_ratio"] for r in rows(snapshot.channels(t))) == pytest.approx(1, abs=1e-3)
    assert rows(filtered.kpis(t))[0]["total_sales"] <= total
    assert rows(snapshot.top_products(t, 50))[:10] == rows(snapshot.top_products(t, 10))


def test_source_row_counts(spark, t):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
    (counts,) = rows(job.source_row_counts(t))
    assert sum(counts.values()) == lines


def test_jdbc_settings(monkeypatch):
    monkeypatch.delenv("SALES_JDBC_URL", raising=False)
    with pytest.raises(ValueError, match="SALES_JDBC_URL"):
        Connection.from_environment()
    for name in ("URL", "USER", "PASSWORD", "DRIVER"):
        monkeypatch.setenv(f"SALES_JDBC_{name}", name.lower())
    connection = Connection.from_environment()
    assert connection.options()["url"] == "url"
    assert "password" not in repr(connection)
    assert Slices("ProductKey", 1, 900, 8).options() == {
        "partitionColumn": "ProductKey",
        "lowerBound": "1",
        "upperBound": "900",
        "numPartitions": "8",
    }
    assert Slices().options() == {}
    with pytest.raises(ValueError):
        Slices("ProductKey", 9, 1, 8).options()


@pytest.mark.parametrize("rows_per_slice", [10_000_000, 40])
def test_fact_slices_hold_every_row_once(spark, t, rows_per_slice):
    key = "OrderDateKey int, ProductKey bigint"
    facts = t.internet.select("OrderDateKey", "ProductKey")
    counted = facts.selectExpr("OrderDateKey div 100 AS month", "ProductKey AS k").groupBy("month")
    months = [
        Month(r["month"], r["n"], r["low"], r["high"])
        for r in counted.agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).collect()
    ]
    slices = fact_slices(months, "OrderDateKey", "ProductKey", rows_per_slice)
    assert len(slices.predicates) == 80 if rows_per_slice > 1000 else len(slices.predicates) > 80
    odd = [(None, None), (None, 5), (0, 1), (19991131, None), (99999999, 10**12), (20000102, -7)]
    keys = facts.unionByName(spark.createDataFrame(odd, key))
    held = [F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in slices.predicates]
    in_slices = keys.select(F.aggregate(F.array(*held), F.lit(0), lambda a, b: a + b).alias("n"))
    assert rows(in_slices.distinct()) == [{"n": 1}]


def test_slices_of_few_rows():
    assert fact_slices([], "d", "k") == Slices()
    assert fact_slices([Month(200001, 9, 1, 5)], "d", "k").predicates == ("1 = 1",)
    assert fact_slices([Month(200001, 9, 1, 9)], "d", "k", 5).predicates == (
        "1 = 1 AND (k < 5 OR k IS NULL)",
        "1 = 1 AND k >= 5",
    )
    two = fact_slices([Month(200002, 1, None, None), Month(200001, 1, 1, 1)], "d", "k", 1)
    assert two.predicates == ("(d < 200002 OR d IS NULL)".replace("200002", "20000200"), "d >= 20000200")


def test_questions_the_warehouse_answers():
    connection = Connection("url", "user", "password", "driver")
    assert bounds_query(connection, "T", "K") == "SELECT MIN(K) AS low, MAX(K) AS high, COUNT(*) AS n FROM dbo.T"
    asked = months_query(connection, "T", "D", "K")
    assert asked.endswith("FROM dbo.T WHERE D IS NOT NULL GROUP BY D / 100")


def test_a_lost_part_file_is_damage(spark, t, tmp_path):
    out = f"{tmp_path}/out"
    run = job.publish_snapshot(spark, t, out)
    record = results.current_record(spark, out)
    assert set(record) == set(results.MODULES)

    def status():
        found = rows(results.completeness(spark, results.current_run(spark, out), record=record))
        return {r["module"]: r["status"] for r in found}

    assert set(status().values()) == {"ok"}
    back = results.read_result(spark, run, "trend").drop("result_file")
    trend, schema = rows(back), back.schema
    results.publish(spark.createDataFrame(trend[1:] + trend[:1], schema), run, "trend")  # another order
    assert status()["trend"] == "ok"
    for changed in (trend[1:], trend[1:] + trend[:1] + trend[:1], [dict(trend[0], sales_amount=0.01)] + trend[1:]):
        results.publish(spark.createDataFrame(changed, schema), run, "trend")
        found = status()
        assert found.pop("trend") == "damaged" and set(found.values()) == {"ok"}
    (lost, *_) = [p for p in (tmp_path / "out" / run.rsplit("/", 1)[1] / "channels").iterdir() if p.name.startswith("part-")]
    lost.unlink()
    assert status()["channels"] == "damaged"


def order_tables(spark, folder, n):
    """Small order tables: ``n`` orders of three lines each, some orders without a match."""
    def put(name, data, schema):
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

    day = datetime(2001, 3, 1)
    put("region", [(0, "EUROPE")], "r_regionkey int, r_name string")
    put("nation", [(0, "FRANCE", 0)], "n_nationkey int, n_name string, n_regionkey int")
    put("customer", [(i, 0, "BUILDING") for i in range(4)], "c_custkey bigint, c_nationkey int, c_mktsegment string")
    put(
        "part",
        [(i, f"red part {i}", "PROMO", 3, 9.5, "Brand") for i in range(5)],
        "p_partkey bigint, p_name string, p_type string, p_size int, p_retailprice double, p_brand string",
    )
    put(
        "orders",
        [(i, i % 5, day + timedelta(days=20 * (i % 9))) for i in [*range(n), 3]],
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp",
    )
    put(
        "lineitem",
        [(None if i == 7 else i, (i + k) % 6, 10.25 * k + i) for i in range(n + 3) for k in range(3)],
        "l_orderkey bigint, l_partkey bigint, l_extendedprice double",
    )


def reads_orders(df):
    return any("orders.parquet" in path or "lineitem.parquet" in path for path in df.inputFiles())


SEVERAL = ("output_completeness", "published_alerts", "alerts_snapshot_stable", "report_modules")
SEVERAL += ("report_context", "result_manifest", "report_text_roundtrip", "output_completeness_gaps")


@pytest.mark.parametrize("name", SEVERAL)
def test_lines_and_orders_are_joined_once_for_several_modules(spark, tmp_path, monkeypatch, name):
    """The modules of a run read stored facts, not the join of lines and orders each anew."""
    order_tables(spark, tmp_path, 40)
    seen = []
    for module in (job.METRICS, vars(snapshot)):
        for figure, f in list(module.items()):
            if figure in ("kpis", "trend", "channels", "top_products", "geo", "geo_sales"):
                note = lambda t, *a, f=f, **k: (seen.append(t), f(t, *a, **k))[1]
                monkeypatch.setitem(module, figure, note)
    registry.registered()[name].run(spark, str(tmp_path)).collect()
    assert seen
    for t in seen:
        assert not reads_orders(t.internet) and not reads_orders(t.reseller)


def test_stored_facts_have_every_line_and_follow_their_files(spark, tmp_path):
    order_tables(spark, tmp_path, 40)
    stored = load_star(spark, str(tmp_path), facts=True)
    assert load_star(spark, str(tmp_path), facts=True) is stored
    views = load_star(spark, str(tmp_path))
    assert reads_orders(views.internet)
    for name in ("internet", "reseller"):
        facts = sorted(map(repr, getattr(stored, name).collect()))
        assert facts == sorted(map(repr, getattr(views, name).collect())) and len(facts) > 20
        assert getattr(stored, name).schema == getattr(views, name).schema
    order_tables(spark, tmp_path, 60)
    anew = load_star(spark, str(tmp_path), facts=True)
    assert anew.internet.count() > stored.internet.count()
