"""Every registered query: how to run it on a test folder, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesengine.functions.exact import LINE_EXACT, clean_values
from salesengine.functions.filters import Filters
from salesengine.operators import catalog, derived, filtered, snapshot, unify
from salesengine.operators.alerts import AlertThresholds
from salesengine.operators.snapshot import LabelRules
from salesengine.plans import job, oracle
from salesengine.sources import results
from salesengine.sources.scratch import scratch_folder
from salesengine.sources.star import SalesTables
from salesengine.sources.testcatalog import catalog_state, changes
from salesengine.sources.testmap import load_star

# The filter presets used for the live metrics.
PRESETS = {
    "f0": Filters(),
    "f1": Filters(start_date="1999-01-01", end_date="2000-12-31", product_line="ECONOMY"),
    "f2": Filters(end_date="2000-03-31", country="EUROPE"),
    "f3": Filters(end_date="2030-01-01", channel="Reseller"),
    "f4": Filters(product_line="Unknown", channel="Internet"),
    "f5": Filters(end_date="1990-01-01"),
    "f6": Filters(country="EUROPE", channel="Reseller"),
    "f7": Filters(start_date="2000-07-01", end_date="2000-12-31"),
}
# Thresholds at which rules and labels fire that the usual ones leave out.
DEPENDENT = AlertThresholds(top_product_share=0.00005)
ALL_QUIET = AlertThresholds(
    sales_drop=Decimal("0"),
    top_product_share=2.0,
    channel_share=2.0,
    region_sales=Decimal("1000000000000"),
)
LOWER_LABELS = LabelRules(high_contribution_share=0.0001)
PIVOT_LIMIT = 20
ONE_PRODUCT = 42
LISTED_PRODUCT = 2
RANKING_LIMIT = 50


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def _on_star(
    metric: Callable[[SalesTables], DataFrame], gaps: bool = False, facts: bool = False
) -> Callable[[SparkSession, str], DataFrame]:
    """A metric over the star schema, with decimals and dates cleaned for output."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return clean_values(metric(load_star(spark, sf_dir, gaps, facts)))

    return run


def _snapshot_queries() -> dict[str, Query]:
    return {
        "unified_sales": Query(_on_star(unify.unified_sales), oracle.UNIFIED_SALES),
        "customer_places": Query(_on_star(unify.customer_places), oracle.CUSTOMER_PLACES),
        "sales_wide": Query(_on_star(unify.sales_wide), oracle.SALES_WIDE),
        "kpis_snapshot": Query(_on_star(snapshot.kpis), oracle.snapshot("kpis")),
        "trend_snapshot": Query(_on_star(snapshot.trend), oracle.snapshot("trend")),
        "channels_snapshot": Query(_on_star(snapshot.channels), oracle.snapshot("channels")),
        "top_products_snapshot": Query(
            _on_star(snapshot.top_products), oracle.snapshot("top_products")
        ),
        "top_products_snapshot_50": Query(
            _on_star(lambda t: snapshot.top_products(t, RANKING_LIMIT)),
            oracle.top_products_snapshot(RANKING_LIMIT),
        ),
        "top_products_snapshot_labels": Query(
            _on_star(lambda t: snapshot.top_products(t, RANKING_LIMIT, LOWER_LABELS)),
            oracle.top_products_snapshot(RANKING_LIMIT, LOWER_LABELS),
        ),
        "geo_snapshot": Query(_on_star(snapshot.geo), oracle.snapshot("geo")),
        "geo_snapshot_all": Query(
            _on_star(lambda t: snapshot.geo(t, limit=None)), oracle.GEO_SNAPSHOT_ALL
        ),
    }


def _unmatched_queries() -> dict[str, Query]:
    """Metrics over dimensions that lack products and places which lines have."""
    f = PRESETS["f0"]
    metrics: dict[str, tuple[Callable[[SalesTables], DataFrame], str]] = {
        "customer_places": (unify.customer_places, oracle.CUSTOMER_PLACES),
        "sales_wide": (unify.sales_wide, oracle.SALES_WIDE),
        "unified_sales_geo": (unify.unified_sales_geo, oracle.UNIFIED_SALES_GEO),
        "top_products_snapshot": (snapshot.top_products, oracle.snapshot("top_products")),
        "geo_snapshot": (snapshot.geo, oracle.snapshot("geo")),
        "filtered_sales": (unify.filtered_sales_geo, oracle.filtered_sales(f)),
        "product_sales": (filtered.product_sales, oracle.product_sales(f)),
        "kpis_filtered": (filtered.kpis, oracle.kpis_filtered(f)),
        "trend_filtered": (filtered.trend, oracle.trend_filtered(f)),
        "product_monthly_panel": (filtered.product_monthly_panel, oracle.product_monthly_panel(f)),
        "geo_filtered": (filtered.geo, oracle.geo_filtered(f)),
        "channels_filtered": (filtered.channels, oracle.channels_filtered(f)),
    }
    return {
        f"{name}_unmatched": Query(_on_star(metric, gaps=True), oracle.unmatched(sql))
        for name, (metric, sql) in metrics.items()
    }


def _filtered_queries() -> dict[str, Query]:
    """The live metrics under the presets that make a difference to them."""
    metrics: dict[str, tuple[Callable, Callable, str]] = {
        "filtered_sales": (unify.filtered_sales_geo, oracle.filtered_sales, "f0 f1 f2 f4"),
        "product_sales": (filtered.product_sales, oracle.product_sales, "f0 f1 f2"),
        "hot_products": (filtered.hot_products, oracle.hot_products, "f0 f1 f3"),
        "kpis_filtered": (filtered.kpis, oracle.kpis_filtered, "f0 f1 f2 f3 f4 f5 f6 f7"),
        "trend_filtered": (filtered.trend, oracle.trend_filtered, "f0 f1 f2 f3 f4 f5 f6 f7"),
        "trend_peak_valley": (
            filtered.trend_peak_valley,
            oracle.trend_peak_valley,
            "f0 f1 f2 f7",
        ),
        "top_products_filtered": (
            lambda t, f: filtered.top_products(t, f, RANKING_LIMIT),
            lambda f: oracle.top_products_filtered(f, RANKING_LIMIT),
            "f0 f1 f2 f3",
        ),
        "product_monthly": (
            lambda t, f: filtered.product_monthly(t, ONE_PRODUCT, f),
            lambda f: oracle.product_monthly(ONE_PRODUCT, f),
            "f0 f2 f7",
        ),
        "product_monthly_panel": (
            filtered.product_monthly_panel,
            oracle.product_monthly_panel,
            "f0 f2 f7",
        ),
        "geo_filtered": (filtered.geo, oracle.geo_filtered, "f0 f1 f2 f3"),
        "channels_filtered": (filtered.channels, oracle.channels_filtered, "f0 f1 f3 f7"),
    }
    out = {}
    for name, (metric, sql, presets) in metrics.items():
        for preset in presets.split():
            f = PRESETS[preset]
            registered_name = name if preset == "f0" else f"{name}_{preset}"
            out[registered_name] = Query(
                _on_star(lambda t, metric=metric, f=f: metric(t, f)), sql(f)
            )
    out["geo_filtered_all"] = Query(
        _on_star(lambda t: filtered.geo(t, limit=None)), oracle.geo_filtered(PRESETS["f0"], None)
    )
    out["unified_sales_geo"] = Query(
        _on_star(unify.unified_sales_geo), oracle.UNIFIED_SALES_GEO
    )
    out["filter_options"] = Query(_on_star(filtered.filter_options), oracle.FILTER_OPTIONS)
    out["filter_options_grouped"] = Query(
        _on_star(lambda t: _joined_lists(filtered.filter_options_grouped(t))),
        oracle.FILTER_OPTIONS_JOINED,
    )
    return out


def _without_metric(alerts_found: DataFrame) -> DataFrame:
    """Alerts without their JSON column, whose number format differs in SQL."""
    return alerts_found.drop("metric")


def _parsed_metric(alerts_found: DataFrame) -> DataFrame:
    """What the JSON column of an alert names, and the sales it gives."""

    def first_of(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object("metric", f"$.{p}") for p in paths])

    subject = first_of("current.year_month", "product_key", "sales_channel", "country")
    amount = first_of("current.sales_amount", "sales_amount", "total_sales").cast("double")
    return alerts_found.select(
        "rule_order", "type", subject.alias("subject"), amount.alias("amount")
    )


def _joined_lists(options: DataFrame) -> DataFrame:
    return options.withColumn("option_values", F.array_join("option_values", "|"))


def _alert_queries() -> dict[str, Query]:
    out = {
        "alerts_snapshot": Query(
            _on_star(lambda t: _without_metric(job.snapshot_alerts(t)), facts=True),
            oracle.ALERTS_SNAPSHOT,
        ),
        "alerts_snapshot_metric": Query(
            _on_star(lambda t: _parsed_metric(job.snapshot_alerts(t)), facts=True),
            oracle.ALERTS_SNAPSHOT_METRIC,
        ),
    }
    for name, limits in (("dependency", DEPENDENT), ("stable", ALL_QUIET)):
        out[f"alerts_snapshot_{name}"] = Query(
            _on_star(
                lambda t, limits=limits: _without_metric(job.snapshot_alerts(t, limits)), facts=True
            ),
            oracle.alerts_snapshot(limits),
        )
    for preset in ("f0", "f1", "f7"):
        f = PRESETS[preset]
        out["alerts_filtered" if preset == "f0" else f"alerts_filtered_{preset}"] = Query(
            _on_star(lambda t, f=f: _without_metric(job.live_alerts(t, f, catalog_state(t)))),
            oracle.alerts_filtered(f),
        )
    return out


def _two_batches(t: SalesTables) -> DataFrame:
    """A stored catalog after a batch of inserts and updates, and one of deletes."""
    spark = t.product.sparkSession
    folder = scratch_folder(spark)
    catalog.save(catalog_state(t), folder)
    batch = changes(t)
    deletes = F.col("op") == catalog.DELETE
    catalog.apply_stored(spark, folder, batch.where(~deletes))
    return catalog.apply_stored(spark, folder, batch.where(deletes)).catalog


def _catalog_queries() -> dict[str, Query]:
    def state(change: Callable) -> Callable[[SparkSession, str], DataFrame]:
        return _on_star(lambda t: change(catalog_state(t), changes(t)))

    def read(look: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return _on_star(lambda t: look(catalog_state(t).catalog))

    f0, f1 = PRESETS["f0"], PRESETS["f1"]
    return {
        "catalog_seed": Query(_on_star(catalog.seed), oracle.CATALOG_SEED),
        "catalog_seed_all": Query(
            _on_star(lambda t: catalog.seed(t, limit=None)), oracle.CATALOG_SEED_ALL
        ),
        "catalog_two_batches": Query(_on_star(_two_batches), oracle.CATALOG_TWO_BATCHES),
        "catalog_search": Query(
            read(lambda c: catalog.search(c, "rENAMED 1")), oracle.catalog_search("rENAMED 1", None)
        ),
        "catalog_search_wildcard": Query(
            read(lambda c: catalog.search(c, "d%1_5", "X")), oracle.catalog_search("d%1_5", "X")
        ),
        "catalog_lookup": Query(
            read(lambda c: catalog.lookup(c, LISTED_PRODUCT)), oracle.catalog_lookup(LISTED_PRODUCT)
        ),
        "catalog_lookup_many": Query(
            _on_star(
                lambda t: catalog.lookup_many(
                    catalog_state(t).catalog,
                    unify.reseller_lines(t, LINE_EXACT).select("product_key").distinct(),
                )
            ),
            oracle.CATALOG_LOOKUP_MANY,
        ),
        "catalog_insert": Query(state(catalog.insert), oracle.CATALOG_INSERT),
        "catalog_update": Query(state(catalog.update), oracle.CATALOG_UPDATE),
        "catalog_delete": Query(
            state(lambda s, c: catalog.delete(s, c).catalog), oracle.CATALOG_DELETE
        ),
        "catalog_delete_tombstones": Query(
            state(lambda s, c: catalog.delete(s, c).tombstones), oracle.CATALOG_DELETE_TOMBSTONES
        ),
        "catalog_tombstones": Query(
            state(lambda s, c: s.tombstones), oracle.CATALOG_TOMBSTONES
        ),
        "catalog_apply_changes": Query(
            state(lambda s, c: catalog.apply_changes(s, c).catalog), oracle.CATALOG_APPLY_CHANGES
        ),
        "catalog_apply_changes_tombstones": Query(
            state(lambda s, c: catalog.apply_changes(s, c).tombstones),
            oracle.CATALOG_APPLY_TOMBSTONES,
        ),
        "catalog_change_report": Query(
            state(catalog.change_report), oracle.CATALOG_CHANGE_REPORT
        ),
        "catalog_overlay": Query(
            _on_star(lambda t: job.live_ranking(t, f0, RANKING_LIMIT, catalog_state(t))),
            oracle.catalog_overlay(f0, RANKING_LIMIT),
        ),
        "catalog_overlay_f1": Query(
            _on_star(lambda t: job.live_ranking(t, f1, RANKING_LIMIT, catalog_state(t))),
            oracle.catalog_overlay(f1, RANKING_LIMIT),
        ),
    }


def _derived_queries() -> dict[str, Query]:
    f0, f2, f3, f7 = (PRESETS[p] for p in ("f0", "f2", "f3", "f7"))
    return {
        "mom_growth_pct": Query(
            _on_star(lambda t: derived.mom_growth_pct(snapshot.trend(t))), oracle.MOM_GROWTH_PCT
        ),
        "mom_growth_pct_f7": Query(
            _on_star(lambda t: derived.mom_growth_pct(filtered.trend(t, f7))),
            oracle.mom_growth_pct(f7),
        ),
        "channel_tiles": Query(
            _on_star(lambda t: derived.channel_tiles(filtered.channels(t))),
            oracle.channel_tiles(f0),
        ),
        "channel_tiles_f3": Query(
            _on_star(lambda t: derived.channel_tiles(filtered.channels(t, f3))),
            oracle.channel_tiles(f3),
        ),
        "geo_rank": Query(_on_star(lambda t: derived.geo_rank(snapshot.geo(t))), oracle.GEO_RANK),
        "sparkline": Query(
            _on_star(lambda t: derived.sparkline(filtered.product_monthly_panel(t))),
            oracle.sparkline(f0),
        ),
        "sparkline_f2": Query(
            _on_star(lambda t: derived.sparkline(filtered.product_monthly_panel(t, f2))),
            oracle.sparkline(f2),
        ),
        "product_month_pivot": Query(
            _on_star(derived.product_month_pivot), oracle.product_month_pivot(f0, None)
        ),
        "product_month_pivot_20": Query(
            _on_star(lambda t: derived.product_month_pivot(t, limit=PIVOT_LIMIT)),
            oracle.product_month_pivot(f0, None, PIVOT_LIMIT),
        ),
        "product_month_pivot_chosen_f7": Query(
            _on_star(lambda t: derived.product_month_pivot(t, f7, ONE_PRODUCT)),
            oracle.product_month_pivot(f7, ONE_PRODUCT),
        ),
        "trend_peak_valley_snapshot": Query(
            _on_star(lambda t: filtered.peak_valley(snapshot.trend(t), reasons=False)),
            oracle.SNAPSHOT_PEAK_VALLEY,
        ),
    }


def _published(
    read: Callable[[SparkSession, SalesTables, str], DataFrame], *modules: str
) -> Callable[[SparkSession, str], DataFrame]:
    """A read from a folder to which the modules were published just now."""
    several = not modules or "alerts" in modules

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load_star(spark, sf_dir, facts=several)
        folder = scratch_folder(spark)
        job.publish_snapshot(spark, t, folder, modules=modules or results.MODULES)
        return read(spark, t, folder)

    return run


def _of_run(
    read: Callable[[SparkSession, str], DataFrame],
) -> Callable[[SparkSession, SalesTables, str], DataFrame]:
    return lambda spark, t, folder: read(spark, results.current_run(spark, folder))


def _run_with_gaps(
    read: Callable[[SparkSession, str], DataFrame],
) -> Callable[[SparkSession, str], DataFrame]:
    """A read from a run without two modules, one of whose others has no rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = load_star(spark, sf_dir, facts=True)
        folder = job.publish_snapshot(
            spark, t, scratch_folder(spark), modules=("kpis", "trend", "top_products")
        )
        results.publish(snapshot.channels(t).where(F.lit(False)), folder, "channels")
        return read(spark, folder)

    return run


def _parsed_modules(modules: DataFrame) -> DataFrame:
    """What the JSON text of each module holds."""
    rows = F.from_json(
        F.get_json_object("payload", "$.items"), "array<struct<sales_amount:decimal(28,2)>>"
    )
    total = F.aggregate(
        rows,
        F.lit(0).cast("decimal(38,2)"),
        lambda sold, row: (sold + F.coalesce(row["sales_amount"], F.lit(0))).cast("decimal(38,2)"),
    )
    headline = F.get_json_object("payload", "$.total_sales").cast("double")
    return modules.select(
        "position",
        "module",
        F.when(rows.isNotNull(), F.size(rows)).alias("items"),
        F.coalesce(headline, total.cast("double")).alias("amount"),
        F.get_json_object("payload", "$.status").alias("status"),
    )


def _parsed_context(context: DataFrame) -> DataFrame:
    def field(path: str) -> Column:
        return F.get_json_object("context", f"$.{path}")

    return context.select(
        field("kpis.total_sales").cast("double").alias("total_sales"),
        field("trend.items[0].year_month").alias("first_month"),
        field("channels.items[0].sales_channel").alias("first_channel"),
        field("top_products.items[0].product_key").cast("bigint").alias("first_product"),
        field("geo_sales.items[0].city").alias("first_city"),
        field("alerts.items[0].type").alias("first_alert"),
    )


def _context_as_text(spark: SparkSession, run: str) -> DataFrame:
    """The context written as a text report and read back."""
    text = results.report_context(spark, run).first()["context"]  # one report
    results.write_text(spark, run, "report", text)
    return results.read_text(spark, run, "report").withColumnRenamed("value", "context")


def _result_queries() -> dict[str, Query]:
    f1 = PRESETS["f1"]
    return {
        "source_row_counts": Query(_on_star(job.source_row_counts), oracle.SOURCE_ROW_COUNTS),
        "published_roundtrip": Query(
            _published(
                _of_run(
                    lambda spark, run: results.read_result(spark, run, "trend").drop("generated_at")
                ),
                "trend",
            ),
            oracle.PUBLISHED_TREND,
        ),
        "published_alerts": Query(
            _published(
                _of_run(
                    lambda spark, run: results.read_result(spark, run, "alerts").drop(
                        "generated_at", "metric", "source", "result_file"
                    )
                ),
                "alerts",
            ),
            oracle.PUBLISHED_ALERTS,
        ),
        "read_or_compute": Query(
            _published(
                lambda spark, t, folder: job.read_or_compute(spark, t, folder, "top_products").drop(
                    "generated_at"
                ),
                "top_products",
            ),
            oracle.PUBLISHED_TOP_PRODUCTS,
        ),
        "read_or_compute_live": Query(
            lambda spark, sf_dir: job.read_or_compute(
                spark, load_star(spark, sf_dir), scratch_folder(spark), "channels", f1
            ),
            oracle.served_live(f1),
        ),
        "read_or_compute_trend_extremes": Query(
            _published(
                lambda spark, t, folder: job.trend_with_extremes(
                    job.read_or_compute(spark, t, folder, "trend")
                ),
                "trend",
            ),
            oracle.TREND_EXTREMES,
        ),
        "read_or_compute_trend_extremes_live": Query(
            lambda spark, sf_dir: job.trend_with_extremes(
                job.read_or_compute(
                    spark, load_star(spark, sf_dir), scratch_folder(spark), "trend", f1
                )
            ),
            oracle.trend_extremes(f1),
        ),
        "result_manifest": Query(
            _published(
                _of_run(
                    lambda spark, run: results.manifest(spark, run).select(
                        "module", (F.col("size") > 0).alias("has_files")
                    )
                )
            ),
            oracle.RESULT_MANIFEST,
        ),
        "result_checksums": Query(
            _published(
                _of_run(lambda spark, run: results.contents(spark, run).where("module <> 'alerts'"))
            ),
            oracle.RESULT_CHECKSUMS,
        ),
        "output_completeness": Query(
            _published(
                lambda spark, t, folder: results.completeness(
                    spark,
                    results.current_run(spark, folder),
                    record=results.current_record(spark, folder),
                )
            ),
            oracle.OUTPUT_COMPLETENESS,
        ),
        "output_completeness_gaps": Query(
            _run_with_gaps(results.completeness), oracle.OUTPUT_COMPLETENESS_GAPS
        ),
        "report_modules": Query(
            _published(_of_run(lambda spark, run: _parsed_modules(results.report_modules(spark, run)))),
            oracle.REPORT_MODULES,
        ),
        "report_modules_gaps": Query(
            _run_with_gaps(lambda spark, run: _parsed_modules(results.report_modules(spark, run))),
            oracle.REPORT_MODULES_GAPS,
        ),
        "report_context": Query(
            _published(_of_run(lambda spark, run: _parsed_context(results.report_context(spark, run)))),
            oracle.REPORT_CONTEXT,
        ),
        "report_text_roundtrip": Query(
            _published(_of_run(lambda spark, run: _parsed_context(_context_as_text(spark, run)))),
            oracle.REPORT_CONTEXT,
        ),
    }


def registered() -> dict[str, Query]:
    return {
        **_snapshot_queries(),
        **_unmatched_queries(),
        **_filtered_queries(),
        **_alert_queries(),
        **_catalog_queries(),
        **_derived_queries(),
        **_result_queries(),
    }
