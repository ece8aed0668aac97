"""The batch run: reads the warehouse, publishes all modules, checks that they are complete.

    spark-submit --py-files salesengine.zip salesengine/__main__.py --files /warehouse --output /results
    python -m salesengine --jdbc --output /results

With --jdbc the connection comes from the environment. The exit code is 1 if a
module is missing, empty or damaged.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from salesengine.plans import job
from salesengine.session import build_session
from salesengine.sources import results
from salesengine.sources.jdbc import Connection, load_jdbc
from salesengine.sources.star import load_files


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="salesengine")
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--files", help="folder with one folder for each warehouse table")
    source.add_argument("--jdbc", action="store_true", help="read the warehouse over JDBC")
    parser.add_argument("--output", required=True, help="folder of the published runs")
    parser.add_argument("--format", default="parquet", choices=("parquet", "json", "orc"))
    parser.add_argument("--cores", type=int, default=8)
    parser.add_argument("--shuffle-bytes", type=int, default=0)
    options = parser.parse_args(arguments)
    if spark is None:
        spark = build_session(cores=options.cores, shuffle_bytes=options.shuffle_bytes)
    if options.jdbc:
        tables = load_jdbc(spark, Connection.from_environment())
    else:
        tables = load_files(spark, options.files)
    run = job.publish_snapshot(spark, tables, options.output, options.format)
    rows = results.completeness(
        spark, run, options.format, results.current_record(spark, options.output)
    ).collect()  # one for each module
    for row in rows:
        print(f"{row['module']}: {row['status']}, {row['rows']} rows")
    return int(any(row["status"] != "ok" for row in rows))


if __name__ == "__main__":
    sys.exit(main())
