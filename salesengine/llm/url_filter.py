"""URL filter: host and path rules, and an exact list of keys held in a Bloom filter cascade.

The first filter of the cascade encodes the listed keys. Keys of the corpus that
are not listed but pass it, its false positives, are encoded by the second; listed
keys that pass the second by the third, and so on until no false positive is left.
As the cascade is built over every key of the corpus, its answer for them is exact,
and a row is judged by looking at bits, without a join.

A filter is one array of 64-bit words that every task holds as a scalar subquery.
Its size follows from counted keys. Beyond ``max_filter_bytes`` the keys are dealt by
hash to as many cascades as that bound needs, each with filters of its own, and a key
is looked up in the cascade it was dealt to. As tasks hold all of them, they end at
``max_total_bytes``; longer lists are joined (distinct keys, so that hot hosts weigh
nothing).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesengine.llm.common import ascii_lower, stored, unused

MAX_LEVELS = 64
MAX_FILTER_BYTES, MAX_TOTAL_BYTES = 16 * 2**20, 64 * 2**20
#: Parts dealt by hash differ in size; each is planned as if it had this much more.
UNEVEN = 1.1


@dataclass(frozen=True)
class Rule:
    """Holds for the host and its subdomains and for paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        on_host = (host == self.host) | host.endswith("." + self.host)
        return on_host & path.startswith(self.path)


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, lower case; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; empty if there is none."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def best_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null.

    Of rules of one length the one with the longer host wins, then a block.
    """
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block", r.text))
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(
        *[
            F.when(
                rule.fits(host, path),
                F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict")),
            )
            for rule in order
        ],
        nothing,
    )


@dataclass(frozen=True)
class Level:
    words: DataFrame
    level: int
    bits: int
    hashes: int

    def holds(self, key: Column) -> Column:
        found = F.lit(True)
        for at in _positions(key, self.level, self.bits, self.hashes):
            word = F.element_at(self.words.scalar(), (F.floor(at / 64) + 1).cast("int"))
            found = found & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return found


@dataclass(frozen=True)
class Cascade:
    """Exact for the keys it was built over; other keys may be taken for listed ones."""

    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        found = F.lit(False)
        for level in reversed(self.levels):
            found = level.holds(key) & ~found
        return found


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    first = F.pmod(F.xxhash64(F.lit(level), key), F.lit(bits))
    step = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits))
    return [F.pmod(first + step * i, F.lit(bits)) for i in range(hashes)]


def _shape(keys: int, rate: float) -> tuple[int, int]:
    """Bits, a multiple of 64, and hash functions for a rate of false positives."""
    hashes = max(1, round(math.log2(1 / rate)))
    return -(-math.ceil(keys * hashes / math.log(2)) // 64) * 64, hashes


def _build(keys: DataFrame, count: int, rate: float, level: int) -> Level:
    bits, hashes = _shape(count, rate)
    places = keys.select(
        F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("at")
    )
    bit = F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int")
    )
    words = places.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )
    every = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    row = every.agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long"))))),
            lambda w: w["col2"],
        ).alias("words")
    )
    return Level(stored(row), level, bits, hashes)


@dataclass(frozen=True)
class Cascades:
    """Cascades of the parts to which keys are dealt by hash."""

    parts: tuple[Cascade, ...]

    def contains(self, key: Column) -> Column:
        if len(self.parts) == 1:
            return self.parts[0].contains(key)
        part, found = _part(key, len(self.parts)), F.lit(False)
        for number, cascade in enumerate(self.parts):
            found = F.when(part == number, cascade.contains(key)).otherwise(found)
        return found


def _part(key: Column, parts: int) -> Column:
    """Of hashes no level takes, so that a part's keys lie evenly in its filters."""
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)).cast("int")


def _parts(count: int, others: int, rate: float, max_filter_bytes: int, max_total_bytes: int) -> int:
    """How many parts keep filters within the first bound; 0 if all would exceed the second.

    Counts the first two filters; later ones hold ``rate`` of those two before and less.
    """
    first = _first_rate(count, others)
    bits = [_shape(count, first)[0], _shape(math.ceil(others * first), rate)[0]]
    if UNEVEN * sum(bits) > 8 * max_total_bytes:
        return 0
    return max(1, math.ceil(UNEVEN * max(bits) / (8 * max_filter_bytes)))


def _first_rate(count: int, others: int) -> float:
    return min(0.5, max(count, 1) / max(others, 1))


def build_cascades(
    universe: DataFrame,
    max_filter_bytes: int = MAX_FILTER_BYTES,
    max_total_bytes: int = MAX_TOTAL_BYTES,
    rate: float = 1 / 64,
) -> Cascades | None:
    """Cascades of the listed among distinct keys (key, listed); None if they get too large."""
    count, others = universe.where("listed").count(), universe.where("NOT listed").count()
    parts = _parts(count, others, rate, max_filter_bytes, max_total_bytes) if count else 1
    if not parts:
        return None
    if parts == 1:
        return Cascades((build_cascade(universe, count, others, rate),))
    part = _part(F.col("key"), parts)
    dealt = stored(universe.withColumn("part", part).repartition("part"))
    sizes = {
        (r.part, r.listed): r["count"] for r in dealt.groupBy("part", "listed").count().collect()
    }  # two for each part
    built = [
        build_cascade(
            dealt.where(F.col("part") == n).drop("part"),
            sizes.get((n, True), 0),
            sizes.get((n, False), 0),
            rate,
        )
        for n in range(parts)
    ]
    return Cascades(tuple(built))


def build_cascade(universe: DataFrame, count: int, others: int, rate: float = 1 / 64) -> Cascade:
    """The cascade of the listed among distinct keys (key, listed), of which there are so many.

    The first filter's rate makes its false positives about as many as the listed
    keys, so a cascade takes a few bits for a listed key; ``rate`` is that of the
    later ones, each of which holds about that share of the one before.
    """
    encode = universe.where("listed").select("key")
    other = universe.where("NOT listed").select("key")
    next_rate = _first_rate(count, others)
    levels: list[Level] = []
    while count:
        if len(levels) == MAX_LEVELS:
            raise ValueError("keys of both kinds have the same hashes")
        level = _build(encode, count, next_rate, len(levels))
        levels.append(level)
        wrong = stored(other.where(level.holds(F.col("key"))))
        encode, other = wrong, encode
        count, next_rate = wrong.count(), rate
    return Cascade(tuple(levels))


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    listed: DataFrame,
    url: str = "url",
    max_filter_bytes: int = MAX_FILTER_BYTES,
    max_total_bytes: int = MAX_TOTAL_BYTES,
) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict (allow or block).

    The longest rule that fits decides; without one a url is blocked if its host,
    or its host and path, is among the keys of ``listed`` (one string column; nulls
    and repeats do not matter). Null urls and urls without ``://`` have an empty
    host and path, meet no rule and are allowed. Every row of ``pages`` is kept,
    repeats too; columns of ``pages`` with one of the added names are replaced.
    """
    key_column = listed.columns[0]
    parts = pages.select(
        *[c for c in pages.columns if c.lower() not in {"host", "path", "rule", "listed", "verdict"}],
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
    )
    address = F.concat("host", "path")
    marked = listed.select(F.col(key_column).alias("key"), F.lit(True).alias("listed"))
    keys = parts.select(F.explode(F.array_distinct(F.array("host", address))).alias("key"))
    universe = stored(
        keys.withColumn("listed", F.lit(False))
        .unionByName(marked.where("key IS NOT NULL AND key <> ''"))
        .groupBy("key")
        .agg(F.max("listed").alias("listed"))
        .where("key <> ''")
    )
    cascades = build_cascades(universe, max_filter_bytes, max_total_bytes)
    if cascades is not None:
        hit = (F.col("host") != "") & (
            cascades.contains(F.col("host")) | cascades.contains(address)
        )
        found = parts.withColumn("listed", hit)
    else:
        found = _joined(parts, universe.where("listed").select("key"), address)
    rule = unused(found, "best")
    return (
        found.withColumn(rule, best_rule(rules, F.col("host"), F.col("path")))
        .withColumn("rule", F.col(f"{rule}.rule"))
        .withColumn(
            "verdict",
            F.coalesce(
                F.col(f"{rule}.verdict"), F.when(F.col("listed"), "block").otherwise("allow")
            ),
        )
        .drop(rule)
    )


def _joined(parts: DataFrame, listed: DataFrame, address: Column) -> DataFrame:
    """The same marks by two joins, for lists too long for filters in memory."""
    by_host, by_address = unused(parts, "by_host"), unused(parts, "by_address")
    hosts = listed.select(F.col("key").alias(by_host))
    addresses = listed.select(F.col("key").alias(by_address))
    return (
        parts.join(hosts, F.col("host") == F.col(by_host), "left")
        .join(addresses, address == F.col(by_address), "left")
        .withColumn("listed", F.col(by_host).isNotNull() | F.col(by_address).isNotNull())
        .drop(by_host, by_address)
    )
