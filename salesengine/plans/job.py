"""The batch run that publishes all modules, and the resolver that serves them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesengine.functions.exact import clean_values
from salesengine.functions.filters import MAX_LIMIT, Filters, check_limit
from salesengine.operators import alerts, catalog, filtered, snapshot
from salesengine.operators.unify import unified_sales
from salesengine.sources import results, versions
from salesengine.sources.star import SalesTables

# Modules read the facts independently, each with only the columns it needs:
# caching the joined lines for all of them would not fit at scale.
METRICS: dict[str, Callable[[SalesTables], DataFrame]] = {
    "kpis": snapshot.kpis,
    "trend": snapshot.trend,
    "channels": snapshot.channels,
    # As many products as a ranking may be asked for.
    "top_products": lambda t: snapshot.top_products(t, MAX_LIMIT),
    "geo_sales": snapshot.geo,
}


def publish_snapshot(
    spark: SparkSession,
    t: SalesTables,
    directory: str,
    file_format: str = "parquet",
    modules: Sequence[str] = results.MODULES,
) -> str:
    """Write modules as a new run and make it the current one; returns its folder.

    The metric modules are independent jobs, handed to Spark together so that
    one fills the cores that the last tasks of another leave idle. Alerts are
    computed from the written modules, so no metric is computed twice. All carry
    one time. The run is named as the current one after all its modules are
    written, with the rows and the checksum of each; until then, and if one fails,
    readers get the run before.
    """
    made, version = results.now(), f"run-{uuid.uuid4().hex}"
    folder = f"{directory.rstrip('/')}/{version}"

    def write(name: str) -> None:
        module = clean_values(METRICS[name](t))
        results.publish(module, folder, name, file_format, generated_at=made)

    wanted = [name for name in METRICS if name in modules or "alerts" in modules]
    with ThreadPoolExecutor(max_workers=len(METRICS)) as pool:
        list(pool.map(write, wanted))
    if "alerts" in modules:
        written = {
            name: results.read_result(spark, folder, name, file_format).drop(
                "source", "generated_at", "result_file"
            )
            for name in METRICS
        }
        found = alerts.snapshot_alerts(
            *[
                lambda name=name: written[name]
                for name in ("kpis", "trend", "top_products", "channels", "geo_sales")
            ]
        )
        results.publish(found, folder, "alerts", file_format, generated_at=made)
    record = {
        row["module"]: {"rows": row["rows"], "checksum": row["checksum"]}
        for row in results.contents(spark, folder, file_format).collect()  # one for each module
    }
    versions.add(spark, directory, version, {"modules": record})
    return folder


def snapshot_alerts(
    t: SalesTables, limits: alerts.AlertThresholds = alerts.DEFAULT
) -> DataFrame:
    """The alerts of the snapshot, straight from the tables.

    The rules on products and places read the first row of their modules.
    """
    return alerts.snapshot_alerts(
        lambda: snapshot.kpis(t),
        lambda: snapshot.trend(t),
        lambda: snapshot.top_products(t, 1),
        lambda: snapshot.channels(t),
        lambda: snapshot.geo(t, 1),
        limits,
    )


def live_ranking(
    t: SalesTables, f: Filters, limit: int, state: catalog.CatalogState | None = None
) -> DataFrame:
    """The filtered ranking as users see it, under the catalog if there is one."""
    ranking = filtered.top_products(t, f, limit)
    return ranking if state is None else catalog.overlay(ranking, state)


def live_alerts(
    t: SalesTables, f: Filters = Filters(), state: catalog.CatalogState | None = None
) -> DataFrame:
    return alerts.live_alerts(
        filtered.trend(t, f), live_ranking(t, f, snapshot.DEFAULT_TOP, state)
    )


def _live(
    t: SalesTables, module: str, f: Filters, limit: int, state: catalog.CatalogState | None
) -> DataFrame:
    if module == "kpis":
        return filtered.kpis(t, f)
    if module == "trend":
        return filtered.trend(t, f)
    if module == "channels":
        return filtered.channels(t, f)
    if module == "top_products":
        return live_ranking(t, f, limit, state)
    if module == "geo_sales":
        return filtered.geo(t, f)
    if module == "alerts":
        return live_alerts(t, f, state)
    raise ValueError(f"unknown module {module!r}; known are {', '.join(results.MODULES)}")


def read_or_compute(
    spark: SparkSession,
    t: SalesTables,
    directory: str,
    module: str,
    f: Filters = Filters(),
    limit: int = snapshot.DEFAULT_TOP,
    state: catalog.CatalogState | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """The published module where there is one and no filter is set, else a live one.

    A published module without rows is served as such.
    """
    check_limit(limit)
    if f.is_empty:
        run = results.current_run(spark, directory)
        published = results.read_result(spark, run, module, file_format)
        if published is not None:
            published = results.served(published, module)
            return published.limit(limit) if module == "top_products" else published
    return clean_values(_live(t, module, f, limit, state)).withColumn(
        "source", F.lit(results.LIVE)
    )


def trend_with_extremes(served: DataFrame) -> DataFrame:
    """A served trend of either family, its peak and its valley, told apart by kind."""
    figures = [c for c in served.columns if c not in ("source", "generated_at", "result_file")]
    items = served.select(F.lit("item").alias("kind"), *figures)
    return items.unionByName(filtered.peak_valley(served.select(*figures), reasons=False))


def source_row_counts(t: SalesTables) -> DataFrame:
    """Rows of the two facts in one row, counted in one pass over both."""
    channel = F.col("sales_channel")
    return unified_sales(t).agg(
        F.count_if(channel == "Internet").alias("internet_sales_rows"),
        F.count_if(channel == "Reseller").alias("reseller_sales_rows"),
    )
