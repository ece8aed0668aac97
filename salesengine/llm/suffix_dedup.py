"""Repeated byte strings across documents by bucket-pointer refinement.

A string of ``length`` bytes is repeated if it starts at two places, of one document or
of two. Starting places are put into buckets by a q-gram, and buckets are refined by the
bucket identifiers of later offsets until they tell whole strings apart; places alone in
their bucket are settled at once, and so is every place whose string contains one.

1. *Initial buckets.* Of the q-grams in a string the one with the least hash is its
   anchor, the same wherever the string stands; neighbouring places share one. Only
   anchors are put into buckets, about one for 85 bytes. Grams that occur once are
   settled: none of their strings is repeated.
2. *Classes.* The places of one anchor span a stretch of bytes, those of all their
   strings. Where all stretches of a bucket are equal, all its places are repeated.
   Elsewhere equal stretches are a class, of which one member stands for all; classes
   with two members are repeated, and only those with one are left to be refined, beside
   the others of their bucket.
3. *Refinement.* The stretches of a bucket meet in one task. Their places get identifiers
   by 8 bytes, and by sorting on pairs of identifiers, its own and that at a later
   offset, identifiers of 16, 32 and so on; places that are alone settle every string
   over them and leave the sort. A bucket of too many classes is first cut by larger
   parts of its strings, into cells of neighbouring places and in the end single ones.

Documents are known by a 128-bit hash of their text, as are classes and cells; initial
buckets by a 64-bit one, which only puts places together. No task holds more than a
piece of a text, a document, or ``together`` classes. Of texts, those that hold a
repeated string, and no others, are shuffled; bitmaps of at most 8 MB tell which these
may be, and where they are too full more are shuffled, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.llm.bpe import Bitmap
from salesengine.llm.common import in_small_batches, slices, stored

#: Bytes that the first identifiers in a bucket stand for.
FIRST = 8
#: Bits of a place's number of neighbours and of the way to its anchor.
SMALL = 12


@dataclass(frozen=True)
class Settings:
    """The least repeat, the bytes of a gram, and how much is worked on at once.

    ``together`` classes of a bucket are refined in one task, and ``piece`` places of
    texts are hashed at a time; a longer text is taken in pieces.
    """

    length: int = 200
    gram: int = 32
    together: int = 1_024
    piece: int = 1 << 17
    seed: int = 11

    @property
    def window(self) -> int:
        return self.length - self.gram + 1


class Anchors:
    """Rolling hashes of grams, and the anchors of all strings of a piece of text."""

    def __init__(self, settings: Settings):
        self.settings = settings
        rng = np.random.default_rng(settings.seed)
        self.bytes = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        factor = int(rng.integers(0, 1 << 63)) * 2 + 1
        self.mix = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        size = settings.piece + settings.length
        self.powers, self.inverse = (
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, f, np.uint64)]), dtype=np.uint64)
            for f in (np.uint64(factor), np.uint64(pow(factor, -1, 1 << 64)))
        )

    def grams(self, data: np.ndarray) -> np.ndarray:
        q, n = self.settings.gram, len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.bytes[data] * self.powers[:n], out=sums[1:])
        out = (sums[q:] - sums[:-q]) * self.inverse[: n - q + 1]
        for _ in range(2):
            out ^= out >> np.uint64(32)
            out *= self.mix
        return out ^ (out >> np.uint64(32))

    def runs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(gram, first, last, anchor) of neighbouring places that share an anchor.

        ``ends`` are those of the texts in ``data``, over which no string reaches.
        """
        length, window = self.settings.length, self.settings.window
        if len(data) < length:
            return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
        grams = self.grams(data)
        low = np.uint64((1 << (self.settings.piece + length).bit_length()) - 1)
        # the hash above, the place below: the least is the leftmost of the least hash
        least, step = (grams & ~low) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * step <= window:
            least, step = np.minimum(least[:-step], least[step:]), 2 * step
        if step < window:
            least = np.minimum(least[: len(least) - (window - step)], least[window - step :])
        anchor = (least & low).astype(np.int64)
        whole = np.ones(len(anchor), bool)
        for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            whole[max(begin, end - length + 1) : end] = False
        place = np.flatnonzero(whole)
        anchor = anchor[place]
        new = np.ones(len(place), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place))[: len(first)] - 1
        return grams[anchor[first]], place[first], place[last], anchor[first]


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins, with the last one's end; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held, bounds


def pieces(bounds: np.ndarray, length: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text after the last, first byte, end) of what is worked on at once.

    Whole texts, or parts of one too long; these overlap, so that every string lies in one.
    """
    at, count = 0, len(bounds) - 1
    while at < count:
        if bounds[at + 1] - bounds[at] > most:
            for begin in range(int(bounds[at]), int(bounds[at + 1]) - length + 1, most):
                yield at, at + 1, begin, min(begin + most + length - 1, int(bounds[at + 1]))
            at += 1
            continue
        after = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
        yield at, after, int(bounds[at]), int(bounds[after])
        at = after


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def keys(held: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, 2): the names of the texts."""
    view = memoryview(held)
    ends = bounds.tolist()
    return _pairs([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(ends, ends[1:])])


def _among(words: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in a bitmap."""
    mask = np.uint64(64 * len(words) - 1)
    found = True
    for h in hashes:
        at = h.view(np.uint64) & mask
        found = found & ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1)
    return found


RECORD = "gram long, h1 long, h2 long, k1 long, k2 long, place long"


def stretches(texts: DataFrame, settings: Settings, wanted: np.ndarray | None = None) -> DataFrame:
    """RECORD of every anchor: its gram, the hash of its stretch, its text, and its places.

    ``place`` holds the first place, the number of places, and the way to the anchor. With
    ``wanted``, the words of a bitmap, only for grams that may be in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(settings)
        for part in slices(batches, 4_096):
            held, bounds = raw_texts(part.column("text"))
            view, names = memoryview(held), keys(held, bounds)
            for text, after, begin, end in pieces(bounds, settings.length, settings.piece):
                ends = np.minimum(bounds[text + 1 : after + 1], end) - begin
                gram, first, last, anchor = anchors.runs(held[begin:end], ends)
                if wanted is not None:
                    fits = _among(wanted, gram, gram >> np.uint64(32))
                    gram, first, last, anchor = (x[fits] for x in (gram, first, last, anchor))
                if not len(gram):
                    continue
                spans = zip((first + begin).tolist(), (last + begin + settings.length).tolist())
                hashes = _pairs([xxhash.xxh3_128_digest(view[a:b]) for a, b in spans])
                of = text + np.searchsorted(ends, first, side="right")
                place = ((first + begin - bounds[of]) << 2 * SMALL) + ((last - first + 1) << SMALL) + anchor - first
                columns = [gram.view(np.int64), hashes[:, 0], hashes[:, 1], names[of, 0], names[of, 1], place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(c)) for c in columns], "gram h1 h2 k1 k2 place".split()
                )

    return texts.select("text").mapInArrow(run, RECORD)


def _named_among(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return _among(wanted, names[:, 0].copy(), names[:, 1].copy())


def packed(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(doc_id, k1, k2, data): texts whose names may be in a bitmap, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for part in slices(batches, 512):
            held, bounds = raw_texts(part.column("text"))
            names = keys(held, bounds)
            chosen = np.flatnonzero(_named_among(names, wanted))
            view = memoryview(held)
            data = [packer.compress(view[bounds[i] : bounds[i + 1]]) for i in chosen.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(chosen)),
                    *(pa.array(names[chosen, i].copy()) for i in (0, 1)),
                    pa.array(data, pa.binary()),
                ],
                ["doc_id", "k1", "k2", "data"],
            )

    return texts.mapInArrow(run, "doc_id long, k1 long, k2 long, data binary")


LIVE = "b1 long, b2 long, size long, weight long, k1 long, k2 long, first long, way int, data binary"
HIT = "k1 long, k2 long, first long, places long"


def fetched(texts: DataFrame, asked: DataFrame, settings: Settings) -> DataFrame:
    """LIVE: the stretches of the asked classes (gram, size, weight, k1, k2, place)."""
    names = asked.select(F.col("k1").alias("h1"), F.col("k2").alias("h2")).distinct()
    wanted = Bitmap.of(stored(names)).words
    whole = packed(texts, wanted).groupBy("k1", "k2").agg(F.first("data").alias("data"))
    lists = asked.groupBy(F.col("k1").alias("a1"), F.col("k2").alias("a2")).agg(
        F.collect_list(F.struct("gram", "size", "weight", "place")).alias("classes")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for part in slices(batches, 64):
            rows = []
            for k1, k2, data, classes in zip(*(c.to_pylist() for c in part.columns)):
                text = opened.decompress(data)
                for c in classes:
                    first, places, way = unpack(c["place"])
                    stretch = text[first : first + places + settings.length - 1]
                    rows.append((c["gram"], 0, c["size"], c["weight"], k1, k2, first, way, stretch))
            yield from _live_batches(rows)

    joined = whole.join(lists, (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")))
    return joined.select("k1", "k2", "data", "classes").mapInArrow(run, LIVE)


def unpack(place: int) -> tuple[int, int, int]:
    low = (1 << SMALL) - 1
    return place >> 2 * SMALL, place >> SMALL & low, place & low


def _live_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
    for at in range(0, len(rows), 4_096):
        columns = zip(*rows[at : at + 4_096])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], "b1 b2 size weight k1 k2 first way data".split()
        )


def refine(
    bucket: np.ndarray, weight: np.ndarray, way: np.ndarray, stretch: list[bytes], length: int
) -> tuple[np.ndarray, np.ndarray]:
    """(class, place) of all places in some buckets whose string another place of the bucket has.

    Buckets are numbers; a class that stands for more than one member counts as often.
    Strings are equal only at the same way from their anchors, so places are put
    together by that, too. All comparisons are of the bytes themselves.
    """
    sizes = np.array([len(s) for s in stretch])
    data = np.frombuffer(b"".join(stretch) + bytes(FIRST), np.uint8)
    total = int(sizes.sum())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = sizes[owner] - inside
    weights = weight[owner]

    def alone(at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.bincount(ids, weights[at])[ids] < 2

    def number(*columns: np.ndarray) -> np.ndarray:
        order = np.lexsort(columns)
        new = np.ones(len(order), bool)
        new[1:] = reduce(np.logical_or, [c[order[1:]] != c[order[:-1]] for c in columns])
        ids = np.empty(len(order), np.int64)
        ids[order] = np.cumsum(new) - 1
        return ids

    def still(live: np.ndarray, settled: np.ndarray, span: int) -> np.ndarray:
        """Live places but those whose string contains a settled place of this span."""
        count = np.concatenate([[0], np.cumsum(settled)])
        return live[count[live + length - span + 1] == count[live]]

    live = np.flatnonzero(left >= length)
    ids = np.full(total, -1, np.int64)
    at = np.flatnonzero(left >= FIRST)
    words = np.ndarray((total,), "<u8", buffer=data, strides=(1,))
    ids[at] = number(words[at], inside[at] - way[owner[at]], bucket[owner[at]])
    span = FIRST
    while True:
        settled = np.zeros(total, bool)
        settled[at] = alone(at, ids[at])
        live = still(live, settled, span)
        if not len(live) or 2 * span > length:
            break
        # only places within a live string are refined further
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, live, 1)
        np.add.at(edge, live + length - 2 * span + 1, -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        finer = np.full(total, -1, np.int64)
        finer[at] = number(ids[at + span], ids[at])
        ids, span = finer, 2 * span
    if len(live) and span < length:
        whole = number(ids[live + length - span], ids[live])
        live = live[~alone(live, whole)]
    return owner[live], inside[live]


def solved(live: DataFrame, settings: Settings) -> DataFrame:
    """HIT of the classes of one member, from buckets of ``together`` classes or fewer.

    A task gathers whole buckets up to that number and refines them at once.
    """
    own = [c for c in live.columns if c != "size"]

    def found(rows: list[tuple]) -> pa.RecordBatch:
        _, names = np.unique(np.array([r[:2] for r in rows], np.int64), axis=0, return_inverse=True)
        weight = np.array([r[2] for r in rows])
        way = np.array([r[6] for r in rows])
        own, place = refine(names.ravel(), weight, way, [r[7] for r in rows], settings.length)
        single = weight[own] == 1
        own, place = own[single], place[single]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(own)))
        columns = list(zip(*(rows[i][3:6] for i in own[first].tolist()))) or [[], [], []]
        begin = np.array(columns[2], np.int64) + place[first]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(begin), pa.array(count, pa.int64())],
            ["k1", "k2", "first", "places"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for part in slices(batches, 512):
            for row, size in zip(zip(*(part.column(c).to_pylist() for c in own)), part.column("size").to_pylist()):
                if rows and row[:2] != rows[-1][:2] and len(rows) + size > settings.together:
                    yield found(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield found(rows)

    dealt = live.repartition("b1", "b2").sortWithinPartitions("b1", "b2")
    return dealt.mapInArrow(run, HIT)


def cut(live: DataFrame, width: int, settings: Settings) -> DataFrame:
    """LIVE, with the hash of the stretch as h1 and h2, of the cells of all classes.

    A cell is ``width`` neighbouring ways to the anchor. Its bucket is named by the bytes
    that all its strings have in common, so equal strings come to one bucket, and by the
    ways, so that they stay side by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows, hashes = [], []
            for b1, b2, _, weight, k1, k2, first, way, data in zip(*(c.to_pylist() for c in part.columns)):
                places = len(data) - settings.length + 1
                for cell in range((way - places + 1) // width, way // width + 1):
                    low = max(0, way - (cell + 1) * width + 1)
                    high = min(places - 1, way - cell * width)
                    common = data[way - cell * width : way - (cell + 1) * width + 1 + settings.length]
                    head = b"%d %d %d " % (b1, b2, cell)
                    named = np.frombuffer(xxhash.xxh3_128_digest(head + common), "<i8").tolist()
                    stretch = data[low : high + settings.length]
                    rows.append((*named, 0, weight, k1, k2, first + low, way - low, stretch))
                    hashes.append(xxhash.xxh3_128_digest(stretch))
            both = _pairs(hashes)
            at = 0
            for batch in _live_batches(rows):
                these = both[at : at + batch.num_rows]
                at += batch.num_rows
                columns = [pa.array(np.ascontiguousarray(these[:, i])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "h1", "h2"])

    return live.mapInArrow(run, f"{LIVE}, h1 long, h2 long")


def refined(live: DataFrame, settings: Settings) -> DataFrame:
    """HIT of all classes of one member in LIVE buckets, whose sizes are known.

    Buckets that are too large are cut into cells, whose members are put together by
    classes like those of grams: one of two members or more is settled, and only those
    of one go on, beside one for each other class.
    """
    hits = stored(solved(live.where(F.col("size") <= settings.together), settings))
    large, width = live.where(F.col("size") > settings.together), settings.window
    bucket = ["b1", "b2"]
    while width > 1 and large.limit(1).count():
        width = max(1, width // 8)
        cells = stored(cut(large, width, settings))
        one = F.min(F.struct("k1", "k2", "first", "way", "data")).alias("one")
        classes = stored(cells.groupBy(*bucket, "h1", "h2").agg(F.sum("weight").alias("total"), one))
        twice = stored(classes.where("total > 1").select(*bucket, "h1", "h2"))
        settled = cells.where("weight = 1").join(twice, [*bucket, "h1", "h2"], "left_semi")
        places = F.length("data") - (settings.length - 1)
        hits = hits.unionByName(settled.select("k1", "k2", "first", places.cast("long").alias("places")))
        sizes = classes.groupBy(*bucket).agg(F.count("*").alias("size"), F.min("total").alias("least"))
        unsettled = stored(sizes.where("least = 1 AND size > 1").select(*bucket, "size"))
        live = stored(classes.join(unsettled, bucket).select(*bucket, "size", F.col("total").alias("weight"), "one.*"))
        hits = hits.unionByName(stored(solved(live.where(F.col("size") <= settings.together), settings)))
        large = live.where(F.col("size") > settings.together)
    return hits


def repeats(texts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """HIT: runs of places whose string is repeated, by the names of their texts.

    ``texts`` has a column ``text``; rows with equal texts are different documents.
    """
    grams = (
        stretches(texts, settings)
        .groupBy("gram")
        .agg(F.count("*").alias("n"), F.min("h1").alias("low"), F.max("h1").alias("high"))
        .where("n > 1")
        .select(F.col("gram").alias("shared"), (F.col("low") != F.col("high")).alias("mixed"))
    )
    grams = stored(grams)
    halves = grams.select(F.col("shared").alias("h1"), F.shiftrightunsigned("shared", 32).alias("h2"))
    wanted = Bitmap.of(halves).words
    known = stored(
        stretches(texts, settings, wanted).join(grams, F.col("gram") == F.col("shared")).drop("shared")
    )
    classes = stored(
        known.where("mixed")
        .groupBy("gram", "h1", "h2")
        .agg(F.count("*").alias("weight"), F.min(F.struct("k1", "k2", "place")).alias("one"))
    )
    buckets = classes.groupBy(F.col("gram").alias("bucket")).agg(F.count("*").alias("size"), F.min("weight").alias("least"))
    unsettled = stored(buckets.where("least = 1 AND size > 1").select("bucket", "size"))
    asked = stored(
        classes.join(unsettled, F.col("gram") == F.col("bucket")).select("gram", "size", "weight", "one.*")
    )
    live = stored(fetched(texts, asked, settings))
    twice = stored(classes.where("weight > 1").select("gram", "h1", "h2"))
    mixed = known.where("mixed").join(twice, ["gram", "h1", "h2"], "left_semi")
    settled = known.where("NOT mixed").select("k1", "k2", "place").unionByName(mixed.select("k1", "k2", "place"))
    count = F.shiftright("place", SMALL).bitwiseAND(F.lit((1 << SMALL) - 1))
    first = F.shiftright("place", 2 * SMALL)
    return settled.select("k1", "k2", first.alias("first"), count.alias("places")).unionByName(refined(live, settings))


def removed(hits: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes under the strings of all hits."""
    found = np.array(sorted((h["first"], h["first"] + h["places"] - 1 + length) for h in hits), np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(found[:, 1])
    new = np.ones(len(found), bool)
    new[1:] = found[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return found[first, 0], reach[np.append(first[1:], len(found))[: len(first)] - 1]


def remove_repeats(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): one row for each row of ``docs``.

    Texts are taken as UTF-8. ``spans`` are the begins and ends of the removed runs of
    bytes, all that lie under a string of ``length`` bytes which starts anywhere else,
    ``kept`` the other bytes. A null text is empty. Rows with equal texts or ids, or a
    null id, are documents like others, so copies of a text of ``length`` bytes or more
    are removed whole, the first one too. Other columns are not read.
    """
    if settings.gram < FIRST or settings.window < 1 or settings.window >= 1 << SMALL:
        raise ValueError("a gram has 8 bytes or more, and a string from 1 to 4,095 grams")
    texts = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hits = repeats(texts, settings)
    spans = stored(hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "places")).alias("hits")))
    wanted = Bitmap.of(spans.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"))).words

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def result(ids: pa.Array, sizes: list[int], runs: list[list[dict]], kept: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(runs, span), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"],
        )

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for part in slices(batches, 256):
            sizes, runs, left = [], [], []
            for data, found in zip(part.column("data").to_pylist(), part.column("hits").to_pylist()):
                text = opened.decompress(data)
                begin, end = removed(found or [], settings.length)
                kept = zip([0, *end.tolist()], [*begin.tolist(), len(text)])
                sizes.append(len(text))
                runs.append([{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())])
                left.append(b"".join(text[a:b] for a, b in kept))
            yield result(part.column("doc_id"), sizes, runs, left)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            held, bounds = raw_texts(part.column("text"))
            chosen = np.flatnonzero(~_named_among(keys(held, bounds), wanted))
            kept = [held[bounds[i] : bounds[i + 1]].tobytes() for i in chosen.tolist()]
            ids = part.column("doc_id").take(pa.array(chosen))
            yield result(ids, [len(k) for k in kept], [[]] * len(kept), kept)

    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    named = spans.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "hits")
    hit = packed(texts, wanted).join(named, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")), "left")
    return hit.select("doc_id", "data", "hits").mapInArrow(without, schema).unionByName(texts.mapInArrow(whole, schema))
