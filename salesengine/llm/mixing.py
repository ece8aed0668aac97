"""Mixing sources to target weights by a Pfair schedule.

Time runs in slots, one block of documents each. A source of weight w of W gives its
i-th block the window of slots from floor(i W / w) to ceil((i + 1) W / w): its release
and its deadline. Every slot takes the released block with the earliest deadline. As
the weights add up to W, no deadline is missed, and at any slot t every source that
still has blocks has had t w / W of them, give or take less than one. The schedule
repeats after W slots, so one period of it is worked out, and every block finds its
slot from its number. Sources of equal weight have the same releases and deadlines and
take turns by name, so the schedule keeps one state for every distinct weight, however
many sources there are.

Documents are numbered within a source by buckets of a hash of their ids: rows of a
bucket are numbered in a task, and buckets by their counts, so a hot source is spread
over as many tasks as it has rows for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from salesengine.llm.common import stored, unused

#: Slots of a period up to which its schedule is sent to all tasks; a longer one is shuffled.
SENT_SLOTS = 100_000
#: Rows that one task numbers, about.
BUCKET_ROWS = 20_000
#: Rows of a file in the order of the mix, about.
FILE_ROWS = 50_000
#: Routes to the files, of some bytes each, that are sent to all tasks at most.
ROUTE_BYTES, SENT_BYTES = 160, 32 * 2**20
#: Slots worked out between two additions to the schedule.
RUN = 128


def period(sources: DataFrame) -> DataFrame:
    """(source, weight, turn, slot, slots): one period of the schedule of sources and weights.

    Sources are distinct, null is one of them; ties of deadlines go to the first by name.
    The schedule is a sequence and one task's work: its time grows with slots times
    distinct weights, its memory with slots.
    """
    weight = F.col("weight").cast("long").alias("weight")
    row = sources.agg(
        F.array_sort(F.collect_list(F.struct("source", weight))).alias("s"), F.sum("weight").cast("long").alias("slots")
    ).where("slots > 0")
    kinds = F.array_sort(F.array_distinct(F.transform("s", lambda s: s["weight"])))
    numbered = F.transform("s", lambda s, i: F.struct(s["weight"].alias("weight"), i.alias("i")))
    members = F.transform(
        kinds,
        lambda w: F.struct(
            w.alias("weight"),
            F.transform(F.filter("numbered", lambda n: n["weight"] == w), lambda n: n["i"]).alias("of"),
        ),
    )
    row = row.withColumn("numbered", numbered).withColumn("kinds", members).drop("numbered")

    def step(state: Column, slot: Column) -> Column:
        """The next block of every weight is that of one of its sources; the earliest deadline wins."""

        def block(kind: Column, place: Column) -> Column:
            done, of = state["done"][place], F.size(kind["of"])
            turn = F.floor(done / of)
            return F.struct(
                F.ceil((turn + 1) * F.col("slots") / kind["weight"]).alias("deadline"),
                kind["of"][F.pmod(done, of).cast("int")].alias("i"),
                F.floor(turn * F.col("slots") / kind["weight"]).alias("release"),
                turn.alias("turn"),
                place.alias("place"),
            )

        released = F.filter(F.transform("kinds", block), lambda b: b["release"] <= slot)
        return F.transform(
            F.array(F.array_min(released)),
            lambda c: F.struct(
                F.transform(state["done"], lambda d, p: F.when(p == c["place"], d + 1).otherwise(d)).alias("done"),
                F.array_append(
                    state["turns"], F.struct(c["i"].alias("i"), c["turn"].alias("turn"), slot.alias("slot"))
                ).alias("turns"),
            ),
        )[0]

    none = F.array().cast("array<struct<i:int,turn:bigint,slot:bigint>>")

    def run(state: Column, begin: Column) -> Column:
        """Some slots in a row, whose turns are added as one."""
        slots = F.sequence(begin, F.least(begin + RUN, F.col("slots")) - 1)
        after = F.aggregate(slots, F.struct(state["done"].alias("done"), none.alias("turns")), step)
        return F.transform(
            F.array(after),
            lambda a: F.struct(a["done"].alias("done"), F.array_append(state["runs"], a["turns"]).alias("runs")),
        )[0]

    begin = F.struct(
        F.transform("kinds", lambda k: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<array<struct<i:int,turn:bigint,slot:bigint>>>").alias("runs"),
    )
    starts = F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(RUN).cast("long"))
    turns = row.select("s", "slots", F.explode(F.aggregate(starts, begin, run)["runs"]).alias("run"))
    turns = turns.select("s", "slots", F.explode("run").alias("t"))
    return turns.select(
        F.col("s")[F.col("t.i")]["source"].alias("source"),
        F.col("s")[F.col("t.i")]["weight"].alias("weight"),
        F.col("t.turn").alias("turn"),
        F.col("t.slot").alias("slot"),
        "slots",
    )


NOTHING = hashlib.md5(b"").hexdigest()


class _Names:
    """Names for columns added on the way that no column of the documents has."""

    def __init__(self, docs: DataFrame):
        for name in "hash row bucket at first source before slot weight turn slots file route low base".split():
            setattr(self, name, unused(docs, f"mix_{name}"))


def _sources(docs: DataFrame, weights: Mapping[str, int], other: int, block: int, source_col: str) -> DataFrame:
    """(source, count, weight), written."""
    if min([other, block, *weights.values()]) < 1:
        raise ValueError("weights and the block are 1 or more")
    given = F.lit(other).cast("long")
    for name, weight in weights.items():
        given = F.when(F.col("source") == name, weight).otherwise(given)
    return stored(docs.groupBy(F.col(source_col).alias("source")).count().withColumn("weight", given))


def _keyed(docs: DataFrame, of: _Names, rows: int, id_col: str) -> DataFrame:
    """``docs`` with what orders them within a source, and the bucket this falls into.

    Buckets are cut by the hash of the id, and those of rows without an id, which share a
    hash, by that of the whole row. In order of their names they are in that of the rows.
    """
    digits = 0
    while BUCKET_ROWS * 16**digits < rows:
        digits += 1
    hashable = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    part = F.when(F.col(id_col).isNull(), F.concat(F.lit("1"), F.substring(of.row, 1, digits))).otherwise(
        F.when(F.col(of.hash) < NOTHING, "0").otherwise("2")
    )
    return (
        docs.withColumn(of.hash, F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
        .withColumn(of.row, F.lpad(F.hex(F.xxhash64(*hashable)), 16, "0"))
        .withColumn(of.bucket, F.concat(F.substring(of.hash, 1, digits), part))
    )


def _ranked(keyed: DataFrame, of: _Names, id_col: str, source_col: str) -> DataFrame:
    """Keyed rows with their rank in the source, and that of the first row equal to them."""
    sums = W.partitionBy(of.source).orderBy(of.low).rowsBetween(W.unboundedPreceding, -1)
    buckets = (
        keyed.groupBy(F.col(source_col).alias(of.source), F.col(of.bucket).alias(of.low))
        .count()
        .select(of.source, of.low, F.coalesce(F.sum("count").over(sums), F.lit(0)).alias(of.before))
    )
    within = W.partitionBy(source_col, of.bucket).orderBy(of.hash, id_col, of.row)
    same = F.col(source_col).eqNullSafe(F.col(of.source)) & (F.col(of.bucket) == F.col(of.low))
    return (
        keyed.withColumn(of.at, F.row_number().over(within) - 1)
        .withColumn(of.first, F.rank().over(within) - 1)
        .join(buckets, same)
        .withColumn(of.at, F.col(of.at) + F.col(of.before))
        .withColumn(of.first, F.col(of.first) + F.col(of.before))
        .drop(of.source, of.low, of.before)
    )


def _turns(sources: DataFrame, of: _Names) -> tuple[DataFrame, bool]:
    """One period under names of our own, and whether it is short enough to be sent to all tasks."""
    slots = sources.agg(F.sum("weight")).first()[0] or 0
    turns = stored(period(sources.select("source", "weight"))).toDF(of.source, of.weight, of.turn, of.slot, of.slots)
    return (F.broadcast(turns), True) if slots <= SENT_SLOTS else (turns, False)


def _placed(
    ranked: DataFrame, turns: DataFrame, of: _Names, block: int, source_col: str, slot_col: str, position_col: str
) -> DataFrame:
    """Rows with a rank, with their slot and position."""
    number = F.floor(F.col(of.at) / block)
    placed = ranked.join(
        turns,
        F.col(source_col).eqNullSafe(F.col(of.source)) & (F.pmod(number, F.col(of.weight)) == F.col(of.turn)),
    )
    in_slot = F.floor(number / F.col(of.weight)) * F.col(of.slots) + F.col(of.slot)
    return placed.withColumn(slot_col, in_slot).withColumn(
        position_col, F.col(slot_col) * block + F.pmod(F.col(of.at), F.lit(block))
    ).drop(of.source, of.weight, of.turn, of.slot, of.slots)


def mix(
    docs: DataFrame,
    weights: Mapping[str, int],
    other: int = 1,
    block: int = 8,
    id_col: str = "doc_id",
    source_col: str = "source",
    slot_col: str = "slot",
    position_col: str = "position",
) -> DataFrame:
    """``docs`` with slot and position, the order in which to read them.

    Sources have the weight given, or ``other``; a null source is a source of its
    own. Weights are positive whole numbers. A source's documents are taken in order of
    the MD5 of their ids, a null id as an empty one, and rows with one id in that of a
    hash of all their columns, ``block`` to a slot. Every row is kept, repeats too. Where
    a source has run out, its slots stay empty and positions skip them. Columns of
    ``docs`` named like the added ones are replaced.
    """
    docs = docs.drop(slot_col, position_col)
    of = _Names(docs)
    sources = _sources(docs, weights, other, block, source_col)
    rows = sources.agg(F.sum("count")).first()[0] or 0
    ranked = _ranked(_keyed(docs, of, rows, id_col), of, id_col, source_col)
    turns, _ = _turns(sources, of)
    placed = _placed(ranked, turns, of, block, source_col, slot_col, position_col)
    return placed.select(*docs.columns, slot_col, position_col)


def in_order(
    docs: DataFrame,
    weights: Mapping[str, int],
    other: int = 1,
    block: int = 8,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """The documents dealt and sorted so that files hold them in the order of ``mix``.

    The order is worked out on ids, sources and hashes alone and cut into ranges for the
    files. Of every bucket of a source the first row in each range is kept as a route, by
    which each whole document finds its range: documents are shuffled once, and take their
    ranks within the range from that of the route. They go through one shuffle more if the
    schedule or the routes are too many to be sent to all tasks, or if rows that are equal in
    all columns lie on both sides of a cut, as a route cannot tell them apart.
    """
    slot, position = unused(docs, "slot"), unused(docs, "position")
    of = _Names(docs)
    sources = _sources(docs, weights, other, block, source_col)
    rows = sources.agg(F.sum("count")).first()[0] or 0
    turns, sent = _turns(sources, of)
    keyed = _keyed(docs, of, rows, id_col)

    def twice() -> DataFrame:
        placed = _placed(_ranked(keyed, of, id_col, source_col), turns, of, block, source_col, slot, position)
        return placed.repartitionByRange(position).sortWithinPartitions(position).select(*docs.columns)

    if not sent:
        return twice()
    spark = docs.sparkSession
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // FILE_ROWS))
    key = [of.hash, id_col, of.row]
    narrow = _ranked(keyed.select(source_col, of.bucket, *key), of, id_col, source_col)
    ordered = _placed(narrow, turns, of, block, source_col, slot, position)
    dealt = stored(ordered.repartitionByRange(files, position).withColumn(of.file, F.spark_partition_id()))
    low = F.min(F.struct(*key, F.col(of.first).alias(of.base))).alias(of.low)
    by_bucket = [F.col(source_col).alias(of.source), F.col(of.bucket).alias(of.before)]
    begins = stored(dealt.groupBy(*by_bucket, of.file).agg(low, F.min(of.at).alias(of.at)))
    if begins.where(F.col(of.low)[of.base] < F.col(of.at)).limit(1).count():
        return twice()
    routes = stored(
        begins.groupBy(of.source, of.before).agg(
            F.array_sort(F.collect_list(F.struct(of.low, of.file))).alias(of.route)
        )
    )
    size = F.size(of.route) * ROUTE_BYTES + F.coalesce(F.octet_length(F.col(of.source).cast("string")), F.lit(0))
    counted = routes.agg(F.sum(size)).first()[0] or 0
    same = F.col(source_col).eqNullSafe(F.col(of.source)) & (F.col(of.bucket) == F.col(of.before))
    met = keyed.join(F.broadcast(routes) if counted <= SENT_BYTES else routes, same)
    # routes of a bucket are in order, so the last one that does not begin behind a row is its own
    ahead = F.filter(of.route, lambda r: F.struct(*[r[of.low][c] for c in key]) <= F.struct(*key))
    routed = met.withColumn(of.route, F.element_at(ahead, -1)).select(
        *keyed.columns, F.col(of.route)[of.file].alias(of.file), F.col(of.route)[of.low][of.base].alias(of.base)
    )
    together = routed.repartitionById(files, F.col(of.file).cast("int"))
    within = W.partitionBy(of.file, source_col, of.bucket).orderBy(*key)
    ranked = together.withColumn(of.at, F.col(of.base) + F.row_number().over(within) - 1)
    placed = _placed(ranked, turns, of, block, source_col, slot, position)
    return placed.sortWithinPartitions(of.file, position).select(*docs.columns)


def file_positions(docs: DataFrame, position_col: str = "position") -> DataFrame:
    """``docs``, as read from files of ``in_order``, with the number of every row in their order.

    Numbers begin with 0 and skip none: empty slots are not in the files. A column of
    ``docs`` named like the added one is replaced.
    """
    docs = docs.drop(position_col)
    file, start = unused(docs, "mix_file"), unused(docs, "mix_start")
    name = F.col("_metadata.file_name")
    sizes = docs.groupBy(name.alias(file)).agg(F.count("*").alias("rows"))
    # parts are numbered, with zeros in front up to 99,999; a task may write several files
    number = [F.regexp_extract(file, "^part-([0-9]+)-.*-c([0-9]+)", i).cast("long") for i in (1, 2)]
    before = W.orderBy(*number, file).rowsBetween(W.unboundedPreceding, -1)  # one row for each file
    starts = stored(sizes.select(file, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias(start)))
    placed = docs.select(
        *docs.columns, name.alias(file), F.col("_metadata.row_index").alias(position_col)
    ).join(starts, file)
    return placed.select(*docs.columns, (F.col(start) + F.col(position_col)).alias(position_col))
