"""Published result modules: writing, reading back, manifest and completeness.

A run is a folder of modules; a run that failed half-way is never the current one.
A module is a folder of files written by Spark, with the columns source and
generated_at on every row.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesengine.sources import versions

# The modules in the order of the report, their row order and schema.
MODULES = ("kpis", "trend", "channels", "top_products", "geo_sales", "alerts")
PUBLISHED = "spark"
LIVE = "live"
MISSING = "spark_result_missing"
SCHEMAS = {
    "kpis": "total_sales double, order_count bigint, customer_count bigint, "
    "hot_product_count bigint, product_count bigint, avg_order_value double",
    "trend": "year int, month int, sales_amount double, order_count bigint, year_month string, "
    "mom_growth_rate double, trend_direction string",
    "channels": "sales_channel string, sales_amount double, order_count bigint, "
    "sales_ratio double, order_ratio double, avg_order_amount double, performance_summary string",
    "top_products": "product_key bigint, product_name string, product_line string, color string, "
    "size string, sales_amount double, order_count bigint, contribution_rate double, "
    "product_health string",
    "geo_sales": "country string, state_province string, city string, sales_amount double, "
    "customer_count bigint, order_count bigint, region_level string",
    "alerts": "rule_order int, level string, type string, title string, description string, "
    "metric string, metric_value double, metric_reference double",
}
ENVELOPE = "source string, generated_at string"


def fields(name: str) -> list[tuple[str, str]]:
    """Names and types of a module's columns."""
    return [tuple(column.split()) for column in SCHEMAS[name].split(", ")]


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def current_run(spark: SparkSession, directory: str) -> str:
    """The folder of the last complete run; one that does not exist where there is none."""
    run = versions.current(spark, directory)
    return f"{directory.rstrip('/')}/{run.name if run else 'no-run'}"


def current_record(spark: SparkSession, directory: str) -> dict[str, dict]:
    """Rows and checksum of every module of the current run, as they were when it was written."""
    run = versions.current(spark, directory)
    return run.details.get("modules", {}) if run else {}


def content(module: DataFrame, name: str) -> DataFrame:
    """One row (rows, checksum) over the columns of a module, whatever the order of its rows.

    Amounts count to six places. The checksum adds up 60 bits of the MD5 of each row, so
    a row that is lost, changed or there twice shows.
    """
    texts = []
    for column, kind in fields(name):
        value = F.col(column).cast("decimal(38,6)") if kind == "double" else F.col(column)
        texts.append(F.coalesce(value.cast("string"), F.lit("NULL")))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("decimal(20,0)")
    return module.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("checksum")
    )


def contents(spark: SparkSession, directory: str, file_format: str = "parquet") -> DataFrame:
    """(module, rows, checksum) of the modules there are in a run's folder, read anew."""
    found = _expected(spark).where(F.lit(False)).select(
        "module", F.lit(0).cast("bigint").alias("rows"), F.lit("").alias("checksum")
    )
    for name in MODULES:
        module = read_result(spark, directory, name, file_format)
        if module is not None:
            found = found.unionByName(content(module, name).withColumn("module", F.lit(name)))
    return found


def forget_runs(spark: SparkSession, directory: str, keep: int) -> list[str]:
    """Remove all published runs but the last ``keep``; returns the folders removed."""
    gone = [f"{directory.rstrip('/')}/{old.name}" for old in versions.forget(spark, directory, keep)]
    for folder in gone:
        versions.remove(spark, folder)
    return gone


def served(module: DataFrame, name: str) -> DataFrame:
    """A module in its own order, whatever that of its files is."""
    return module.orderBy(*_row_order(name))


def publish(
    module: DataFrame,
    directory: str,
    name: str,
    file_format: str = "parquet",
    source: str = PUBLISHED,
    generated_at: str | None = None,
) -> str:
    """Write a module over its former state; an envelope it has already is kept."""
    for column, value in (("source", source), ("generated_at", generated_at or now())):
        if column not in module.columns:
            module = module.withColumn(column, F.lit(value))
    path = f"{directory.rstrip('/')}/{name}"
    module.write.mode("overwrite").format(file_format).save(path)
    return path


def _load(reader, path: str) -> DataFrame | None:
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_result(
    spark: SparkSession, directory: str, name: str, file_format: str = "parquet"
) -> DataFrame | None:
    """A published module, or None where there is none.

    Adds the name of the module's folder; rows without a source get the default.
    """
    reader = spark.read.format(file_format)
    if name in SCHEMAS:
        reader = reader.schema(f"{SCHEMAS[name]}, {ENVELOPE}")
    module = _load(reader, f"{directory.rstrip('/')}/{name}")
    if module is None:
        return None
    if "source" in module.columns:
        module = module.withColumn("source", F.coalesce("source", F.lit(PUBLISHED)))
    else:
        module = module.withColumn("source", F.lit(PUBLISHED))
    return module.withColumn("result_file", F.lit(name))


def write_text(spark: SparkSession, directory: str, name: str, text: str) -> None:
    rows = spark.createDataFrame([(text,)], "value string")
    rows.coalesce(1).write.mode("overwrite").text(f"{directory.rstrip('/')}/{name}")


def read_text(spark: SparkSession, directory: str, name: str) -> DataFrame | None:
    """The text of a report as one row, or None where there is none."""
    reader = spark.read.format("text").option("wholetext", True)
    found = _load(reader, f"{directory.rstrip('/')}/{name}")
    if found is None:
        return None
    return found.select(F.regexp_replace("value", r"\n$", "").alias("value"))


def _expected(spark: SparkSession) -> DataFrame:
    rows = [(position, name) for position, name in enumerate(MODULES)]
    return spark.createDataFrame(rows, "position int, module string")


def manifest(spark: SparkSession, directory: str, file_format: str = "parquet") -> DataFrame:
    """Path, size and time of each expected module; NULLs for a missing one.

    Only file listings are read, never contents. A module that was written without
    any part file, as formats without a footer do for no rows, has size 0.
    """
    there = [
        name for name in MODULES if read_result(spark, directory, name, file_format) is not None
    ]
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "part-*")
    )
    files = _load(reader, directory)
    expected = _expected(spark)
    if files is None:
        nothing = [
            F.lit(None).cast(kind).alias(name)
            for name, kind in (("path", "string"), ("size", "bigint"), ("updated_at", "timestamp"))
        ]
        return expected.select("module", *nothing, "position").orderBy("position").drop("position")
    found = (
        files.select(
            F.regexp_extract("path", r"^(.*/([^/]+))/[^/]+$", 1).alias("path"),
            F.regexp_extract("path", r"^(.*/([^/]+))/[^/]+$", 2).alias("module"),
            "length",
            "modificationTime",
        )
        .groupBy("module")
        .agg(
            F.min("path").alias("path"),
            F.sum("length").alias("size"),
            F.max("modificationTime").alias("updated_at"),
        )
    )
    return (
        expected.join(found, "module", "left")
        .withColumn("size", F.when(F.col("module").isin(there), F.coalesce("size", F.lit(0))))
        .orderBy("position")
        .select("module", "path", "size", "updated_at")
    )


def completeness(
    spark: SparkSession,
    directory: str,
    file_format: str = "parquet",
    record: dict[str, dict] | None = None,
) -> DataFrame:
    """ok, missing, empty or damaged for each expected module, and its rows.

    A module is there if its folder was written, as for those that serve it; it is
    empty if it has no rows, whatever files there are. With the run's record, one whose
    rows or checksum are not those it was written with is damaged.
    """
    recorded = [(n, r["rows"], r["checksum"]) for n, r in (record or {}).items()]
    written = spark.createDataFrame(recorded, "module string, rows_written bigint, checksum_written string")
    same = (F.col("rows") == F.col("rows_written")) & (F.col("checksum") == F.col("checksum_written"))
    return (
        _expected(spark)
        .join(contents(spark, directory, file_format), "module", "left")
        .join(written, "module", "left")
        .orderBy("position")
        .select(
            "module",
            F.when(F.col("rows").isNull(), "missing")
            .when(F.col("rows_written").isNotNull() & ~same, "damaged")
            .when(F.col("rows") == 0, "empty")
            .otherwise("ok")
            .alias("status"),
            "rows",
        )
    )


def _row_order(name: str) -> list[Column]:
    falling = (-F.col("sales_amount")).alias("falling")
    return {
        "kpis": [F.lit(0).alias("first")],
        "trend": [F.col("year"), F.col("month")],
        "channels": [falling, F.col("sales_channel")],
        "top_products": [falling, F.col("product_key")],
        "geo_sales": [falling, F.col("country"), F.col("state_province"), F.col("city")],
        "alerts": [F.col("rule_order")],
    }[name]


def _as_json(module: DataFrame, name: str) -> DataFrame:
    """A whole module as one JSON text; modules are report-sized by definition."""
    figures = [c for c in module.columns if c not in ("source", "generated_at", "result_file")]
    rows = F.collect_list(
        F.struct(F.struct(*_row_order(name)).alias("key"), F.struct(*figures).alias("row"))
    )
    items = F.transform(F.array_sort(rows), lambda r: r.getField("row"))
    envelope = [F.max("source").alias("source"), F.max("generated_at").alias("generated_at")]
    whole = module.agg(items.alias("items"), *envelope)
    if name == "kpis":
        fields = [F.get("items", F.lit(0)).getField(c).alias(c) for c in figures]
    else:
        fields = [F.col("items")]
    return whole.select(F.to_json(F.struct(*fields, "source", "generated_at")).alias("payload"))


def report_modules(spark: SparkSession, directory: str, file_format: str = "parquet") -> DataFrame:
    """One row for each module in report order, a marker for a missing one."""
    marker = F.to_json(
        F.struct(F.lit(MISSING).alias("status"), F.array().cast("array<string>").alias("items"))
    )
    payloads = None
    for name in MODULES:
        module = read_result(spark, directory, name, file_format)
        if module is not None:
            row = _as_json(module, name).select(F.lit(name).alias("module"), "payload")
            payloads = row if payloads is None else payloads.unionByName(row)
    if payloads is None:
        payloads = _expected(spark).where(F.lit(False)).select("module", F.lit("").alias("payload"))
    return (
        _expected(spark)
        .join(payloads, "module", "left")
        .orderBy("position")
        .select("position", "module", F.coalesce("payload", marker).alias("payload"))
    )


def report_context(spark: SparkSession, directory: str, file_format: str = "parquet") -> DataFrame:
    """All modules as one JSON document, in report order."""
    entry = F.concat(F.lit('"'), F.col("module"), F.lit('":'), F.col("payload"))
    entries = F.array_sort(F.collect_list(F.struct("position", entry.alias("entry"))))
    body = F.array_join(F.transform(entries, lambda e: e.getField("entry")), ",")
    return report_modules(spark, directory, file_format).agg(
        F.concat(F.lit("{"), body, F.lit("}")).alias("context")
    )
