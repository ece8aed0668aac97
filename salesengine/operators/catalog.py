"""The product catalog as snapshots and batches of changes.

A catalog is a DataFrame with one row for each product; tombstones are the keys
of deleted products; a batch of changes has columns seq (unique, in the order
the changes were made), op (insert, update, delete), product_key (NULL for an
insert) and the six attributes. Every operation gives new DataFrames.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesengine.functions.labels import known, matches_name
from salesengine.sources import versions
from salesengine.sources.scratch import scratch_folder, stored
from salesengine.sources.star import SalesTables

ATTRIBUTES = ("product_name", "product_line", "color", "size", "list_price", "model_name")
FIGURES = ("sales_amount", "order_count")
SHOWN = ("product_name", "product_line", "color", "size")
CATALOG_SCHEMA = T.StructType(
    [
        T.StructField("product_key", T.LongType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("product_line", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("list_price", T.DoubleType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("sales_amount", T.DoubleType()),
        T.StructField("order_count", T.LongType()),
    ]
)
CHANGE_SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("op", T.StringType())]
    + [f for f in CATALOG_SCHEMA.fields if f.name not in FIGURES]
)

# Fixed values.
SEEDED_PRODUCTS = 30
INSERT, UPDATE, DELETE = "insert", "update", "delete"

# New keys are numbered within this many buckets of a batch, of about equal size.
NUMBERING_BUCKETS = 256


@dataclass(frozen=True)
class CatalogState:
    catalog: DataFrame
    tombstones: DataFrame


def _new_figures() -> list[Column]:
    return [F.lit(0.0).alias("sales_amount"), F.lit(0).cast("bigint").alias("order_count")]


def seed(
    t: SalesTables, catalog: DataFrame | None = None, limit: int | None = SEEDED_PRODUCTS
) -> DataFrame:
    """The catalog as it is, or the newest products, all for no limit, if it is empty."""
    newest = (
        t.product.where(F.col("EnglishProductName").isNotNull())
        .select(
            F.col("ProductKey").cast("bigint").alias("product_key"),
            F.col("EnglishProductName").alias("product_name"),
            known(F.col("ProductLine")).alias("product_line"),
            known(F.col("Color")).alias("color"),
            known(F.col("Size")).alias("size"),
            F.coalesce(F.col("ListPrice").cast("double"), F.lit(0.0)).alias("list_price"),
            known(F.col("ModelName")).alias("model_name"),
        )
        .distinct()
    )
    if limit is not None:
        newest = newest.orderBy(F.desc("product_key")).limit(limit)
    newest = newest.select("product_key", *ATTRIBUTES, *_new_figures())
    if catalog is None:
        return newest
    return catalog.unionByName(newest.where(~catalog.exists()))


def search(
    catalog: DataFrame, name: str | None = None, product_line: str | None = None
) -> DataFrame:
    """Products whose name contains a text and whose line is the given one."""
    found = catalog
    if name:
        found = found.where(matches_name(F.col("product_name"), name))
    if product_line:
        found = found.where(F.col("product_line") == F.lit(product_line))
    return found.orderBy(F.desc("product_key"))


def lookup(catalog: DataFrame, product_key: int) -> DataFrame:
    return catalog.where(F.col("product_key") == F.lit(product_key))


def lookup_many(catalog: DataFrame, keys: DataFrame) -> DataFrame:
    return catalog.join(keys.select("product_key"), "product_key", "left_semi")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their position by seq, counted from 1 over the whole batch.

    The batch is cut at approximate percentiles of seq, whatever its values are;
    positions are counted within the buckets and shifted by the rows of the
    buckets before. No task sees the whole batch.
    """
    shares = [i / NUMBERING_BUCKETS for i in range(1, NUMBERING_BUCKETS)]
    cuts = rows.agg(F.percentile_approx("seq", shares, 10 * NUMBERING_BUCKETS)).scalar()
    below = F.filter("cuts", lambda c: c < F.col("seq"))
    bucketed = rows.withColumn("cuts", cuts).withColumn("bucket", F.size(below)).drop("cuts")
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    # One row for each bucket.
    before = F.sum("n").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("n")
    shifts = sizes.select("bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("seq"))
    return (
        bucketed.withColumn("within", within)
        .join(shifts, "bucket")
        .withColumn("position", F.col("before") + F.col("within"))
        .drop("bucket", "before", "within")
    )


def _largest_key(state: CatalogState) -> Column:
    """The largest key ever given out: deleted keys are not used again."""
    used = state.catalog.select("product_key").unionByName(state.tombstones.select("product_key"))
    return used.agg(F.coalesce(F.max("product_key"), F.lit(0)).alias("k")).scalar()


def inserted(state: CatalogState, changes: DataFrame) -> DataFrame:
    """The new products of a batch with their keys and sequence numbers."""
    new = numbered(changes.where(F.col("op") == INSERT).drop("product_key"))
    return new.select(
        (_largest_key(state) + F.col("position")).alias("product_key"),
        *ATTRIBUTES,
        *_new_figures(),
        F.col("seq").alias("born"),
    )


def _born(state: CatalogState, changes: DataFrame) -> DataFrame:
    """The new products, numbered once and written, as all that follows needs them."""
    spark = changes.sparkSession
    return stored(inserted(state, changes), scratch_folder(spark), "inserted")


def _aimed(changes: DataFrame, born: DataFrame) -> DataFrame:
    """Updates and deletes, without those of a new product made before it was there.

    Only changes and new products meet; whether a product of the catalog is there at
    all comes out of the one join with it.
    """
    births = born.select("product_key", "born")
    return (
        changes.where(F.col("op").isin(UPDATE, DELETE))
        .join(births, "product_key", "left")
        .where(F.col("born").isNull() | (F.col("seq") > F.col("born")))
        .drop("born")
    )


def _outcomes(changes: DataFrame, aimed: DataFrame) -> DataFrame:
    """For each key its first delete, and the attributes of the last update if it has none.

    The numbers are hash aggregates, so many changes of one product are reduced before
    the shuffle and never gathered or sorted. The attributes of the last update are
    joined by its number, which is unique.
    """
    numbers = aimed.groupBy("product_key").agg(
        F.min(F.when(F.col("op") == DELETE, F.col("seq"))).alias("died"),
        F.max(F.when(F.col("op") == UPDATE, F.col("seq"))).alias("updated"),
    )
    given = changes.where(F.col("op") == UPDATE).select(
        F.col("seq").alias("given"), F.struct(*ATTRIBUTES).alias("last_update")
    )
    last = F.when(F.col("died").isNull(), F.col("updated"))
    return numbers.join(given, last == F.col("given"), "left").select(
        "product_key", "died", "last_update"
    )


def _after(lives: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Products with their outcomes: new attributes, and died for those deleted."""
    updated = F.col("last_update").isNotNull()
    return lives.join(outcomes, "product_key", "left").select(
        "product_key",
        *[F.when(updated, F.col(f"last_update.{a}")).otherwise(F.col(a)).alias(a) for a in ATTRIBUTES],
        *[c for c in lives.columns if c not in ("product_key", *ATTRIBUTES)],
        "died",
    )


def apply_changes(state: CatalogState, changes: DataFrame) -> CatalogState:
    """The catalog and tombstones after a whole batch.

    Equal to making the changes one by one: a deleted key never comes back, and
    otherwise the last update decides all attributes, NULLs included. The inserts are
    numbered and written when this is called; the rest is a plan that reads them.
    """
    born = _born(state, changes)
    outcomes = _outcomes(changes, _aimed(changes, born))
    lives = state.catalog.unionByName(born.drop("born"))
    after = _after(lives, outcomes).where(F.col("died").isNull()).drop("died")
    dying = outcomes.where(F.col("died").isNotNull()).select("product_key")
    dead = lives.select("product_key").join(dying, "product_key", "left_semi")
    tombstones = state.tombstones.select("product_key").unionByName(dead).distinct()
    return CatalogState(after, tombstones)


def change_report(state: CatalogState, changes: DataFrame) -> DataFrame:
    """For each change the key it concerned and whether a product was there."""
    born = _born(state, changes)
    lives = state.catalog.select("product_key", F.lit(None).cast("bigint").alias("born")).unionByName(
        born.select("product_key", "born")
    )
    died = (
        _aimed(changes, born)
        .where(F.col("op") == DELETE)
        .groupBy("product_key")
        .agg(F.min("seq").alias("died"))
    )
    there = F.col("exists").isNotNull() & (F.col("born").isNull() | (F.col("seq") > F.col("born")))
    still_there = F.col("died").isNull() | (F.col("seq") <= F.col("died"))
    made = born.select(
        F.col("born").alias("seq"),
        F.lit(INSERT).alias("op"),
        "product_key",
        F.lit(True).alias("matched"),
    )
    # a hot key is split by AQE on the side of the changes; the others have one row for each product
    aimed = (
        changes.where(F.col("op").isin(UPDATE, DELETE))
        .select("seq", "op", "product_key")
        .join(lives.withColumn("exists", F.lit(True)), "product_key", "left")
        .join(died, "product_key", "left")
        .select("seq", "op", "product_key", (there & still_there).alias("matched"))
    )
    return made.unionByName(aimed).orderBy("seq")


def insert(state: CatalogState, changes: DataFrame) -> DataFrame:
    """The catalog with the new products of a batch."""
    return state.catalog.unionByName(inserted(state, changes).drop("born"))


def update(state: CatalogState, changes: DataFrame) -> DataFrame:
    """The catalog after the updates of a batch alone."""
    return apply_changes(state, changes.where(F.col("op") == UPDATE)).catalog


def delete(state: CatalogState, changes: DataFrame) -> CatalogState:
    """Catalog and tombstones after the deletes of a batch alone."""
    return apply_changes(state, changes.where(F.col("op") == DELETE))


def overlay(products: DataFrame, state: CatalogState) -> DataFrame:
    """Products as the catalog shows them.

    Deleted ones go; those in the catalog take its name, line, color and size,
    and its price if the rows have one, NULLs included. No row is added, so
    fewer rows than a limit before it may remain. A ranking keeps its order.
    """
    names = [a for a in (*SHOWN, "list_price") if a in products.columns]
    current = state.catalog.select(
        "product_key", F.struct(*names).alias("current"), F.lit(True).alias("listed")
    )
    live = products.join(state.tombstones.select("product_key"), "product_key", "left_anti")
    shown = live.join(current, "product_key", "left").select(
        *[
            F.when(F.col("listed"), F.col(f"current.{c}")).otherwise(F.col(c)).alias(c)
            if c in names
            else F.col(c)
            for c in products.columns
        ]
    )
    if "sales_amount" in products.columns:
        return shown.orderBy(F.desc("sales_amount"), "product_key")
    return shown


# A stored catalog is cut into buckets by key. A version lists for every bucket the
# generation, a folder, that holds it; deleted products stay in their bucket, marked.
STORED_SCHEMA = T.StructType([*CATALOG_SCHEMA.fields, T.StructField("deleted", T.BooleanType())])
DEFAULT_BUCKETS = 64
# Outcomes of a batch are sent to all tasks up to this size, counted with 64 bytes a row on top.
SENT_BYTES = 16 * 2**20


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("product_key"), F.lit(buckets)).cast("int")


def _write_generation(rows: DataFrame, base: str, buckets: int) -> tuple[str, list[int]]:
    """Write rows as a new generation; returns its name and the buckets it holds."""
    generation = uuid.uuid4().hex
    path = f"{base}/catalog/{generation}"
    rows.select(*STORED_SCHEMA.fieldNames(), bucket_of(buckets).alias("bucket")).write.partitionBy(
        "bucket"
    ).parquet(path)
    found = versions.children(rows.sparkSession, path)
    return generation, [int(name.removeprefix("bucket=")) for name in found if name.startswith("bucket=")]


def _stored_rows(spark: SparkSession, base: str, details: dict, wanted: set[int] | None = None) -> DataFrame:
    """Rows of a version, marked ones too, of the wanted buckets or all."""
    paths = [
        f"{base}/catalog/{generation}/bucket={bucket}"
        for bucket, generation in enumerate(details["generations"])
        if generation is not None and (wanted is None or bucket in wanted)
    ]
    if not paths:
        return spark.createDataFrame([], STORED_SCHEMA)
    return spark.read.schema(STORED_SCHEMA).parquet(*paths)


def _split(rows: DataFrame) -> CatalogState:
    return CatalogState(
        rows.where(~F.col("deleted")).drop("deleted"),
        rows.where("deleted").select("product_key"),
    )


def _whole(state: CatalogState) -> DataFrame:
    """Products and tombstones as stored rows."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in CATALOG_SCHEMA.fields[1:]]
    live = state.catalog.withColumn("deleted", F.lit(False))
    gone = state.tombstones.select("product_key").distinct().select("product_key", *empty, F.lit(True).alias("deleted"))
    return live.unionByName(gone)


def save(state: CatalogState, directory: str, buckets: int = DEFAULT_BUCKETS) -> int:
    """Store the catalog and its tombstones whole and make them the current version; returns its number.

    All is written before the version is listed, so a reader finds the former one until
    then, also if the write fails.
    """
    base = directory.rstrip("/")
    spark = state.catalog.sparkSession
    generation, held = _write_generation(_whole(state), base, buckets)
    generations = [generation if b in held else None for b in range(buckets)]
    largest = _stored_rows(spark, base, {"generations": generations}).agg(F.max("product_key")).first()[0]
    details = {"generations": generations, "largest": largest or 0}
    return versions.add(spark, base, generation, details)


def load(spark: SparkSession, directory: str, number: int | None = None) -> CatalogState:
    """The current version or the one with a number; an empty catalog where none was stored."""
    base = directory.rstrip("/")
    held = versions.current(spark, base) if number is None else versions.version(spark, base, number)
    return _split(_stored_rows(spark, base, held.details if held else {"generations": []}))


def apply_stored(spark: SparkSession, directory: str, changes: DataFrame) -> CatalogState:
    """Apply a batch to the stored catalog and store the outcome.

    Only buckets with a product that the batch concerns are read and written anew; all
    others stay the files they are. The version is listed only if it follows the one it was made
    from: if another batch came first, its files are removed and this batch is applied to
    what that one left, so no change is lost. ``changes`` may be read more than once.
    """
    base = directory.rstrip("/")
    while True:
        held = versions.current(spark, base)
        number = held.number if held else 0
        details = held.details if held else {"generations": [None] * DEFAULT_BUCKETS, "largest": 0}
        after, generation = _store_batch(spark, base, details, changes)
        if generation is None and held:
            return load(spark, base, number)
        name = generation or "empty"
        if versions.commit(spark, base, name, number, after):
            return load(spark, base, number + 1)
        if generation:
            versions.remove(spark, f"{base}/catalog/{generation}")


def _sent(outcomes: DataFrame) -> DataFrame:
    """Outcomes as a side to be sent to all tasks, if counting shows that they are small."""
    size = F.coalesce(F.octet_length(F.to_json("last_update")), F.lit(0)) + 80
    counted = outcomes.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(outcomes) if counted["bytes"] <= SENT_BYTES else outcomes


def _store_batch(spark: SparkSession, base: str, details: dict, changes: DataFrame) -> tuple[dict, str | None]:
    """Write what a batch makes of a version; returns the details of the next and its generation."""
    buckets = len(details["generations"])
    scratch = scratch_folder(spark)
    try:
        new = numbered(changes.where(F.col("op") == INSERT).drop("product_key")).select(
            (F.lit(details["largest"]) + F.col("position")).alias("product_key"),
            *ATTRIBUTES,
            *_new_figures(),
            F.col("seq").alias("born"),
        )
        born = stored(new, scratch, "inserted")
        outcomes = stored(_outcomes(changes, _aimed(changes, born)), scratch, "outcomes")
        keys = outcomes.select("product_key").unionByName(born.select("product_key"))
        # one number for each bucket at most
        wanted = {r[0] for r in keys.where("product_key IS NOT NULL").select(bucket_of(buckets)).distinct().collect()}
        if not wanted:
            return details, None
        lives = _stored_rows(spark, base, details, wanted)
        outcomes = _sent(outcomes)
        fresh = born.drop("born").withColumn("deleted", F.lit(False))
        # rows of old and new products meet the outcomes alike, and those of other keys stay
        rows = [_after(part, outcomes) for part in (lives, fresh)]
        marked = [part.withColumn("deleted", F.col("deleted") | F.col("died").isNotNull()) for part in rows]
        generation, written = _write_generation(marked[0].unionByName(marked[1]), base, buckets)
        largest = details["largest"] + born.count()
    finally:
        versions.remove(spark, scratch)
    after = [generation if b in written else old for b, old in enumerate(details["generations"])]
    return {"generations": after, "largest": largest}, generation


def vacuum(spark: SparkSession, directory: str, keep: int) -> list[str]:
    """Forget all but the last ``keep`` versions and remove the files none of them lists.

    Returns the paths removed. Not to be run beside a batch: one that is not yet listed
    would lose its files.
    """
    base = directory.rstrip("/")
    versions.forget(spark, base, keep)
    used = set()
    for number in versions.listed(spark, base):
        generations = versions.version(spark, base, number).details["generations"]
        used |= {(g, b) for b, g in enumerate(generations) if g is not None}
    gone = []
    for generation in versions.children(spark, f"{base}/catalog"):
        path = f"{base}/catalog/{generation}"
        held = [n for n in versions.children(spark, path) if n.startswith("bucket=")]
        unused = [n for n in held if (generation, int(n.removeprefix("bucket="))) not in used]
        gone += [path] if len(unused) == len(held) else [f"{path}/{n}" for n in unused]
    for path in gone:
        versions.remove(spark, path)
    return gone
