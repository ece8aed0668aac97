"""BPE encoding with content-defined chunk reuse, and decoding.

A text is cut where a hash of the 16 bytes before a place is small, so that texts
which share a passage share the chunks within it. Chunks are counted over all texts
by a 128-bit hash. One that occurs twice or more is encoded once, where its first
occurrence is, and its ids are sent to the others; the rest are encoded in place.
Only texts with a shared chunk are shuffled, to meet its ids. Which these are, a
bitmap of bounded size tells the tasks that read the texts; where it is too full, it
sends some texts the longer way for nothing.

A chunk's ids are those of the words that lie whole between its first and last white
space. At a join the halves of the word that was cut are put together and encoded
anew. The join is then encoded by the library together with the words beside it; if
the ids of the window do not agree with the ones put together, the window is widened
to the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salesengine.llm.common import in_small_batches, light_slices, slices, stored

WINDOW = 16
#: Chunks are of this many bytes on average and at least, and at most.
MEAN, LEAST, MOST = 1_024, 256, 16_384
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
HASHED_AT_ONCE = 1 << 20
#: Words a worker remembers before it forgets all that it met once.
REMEMBERED = 500_000
JOIN_BYTES = 64
#: Bytes of text, packed or not, that are split into words at once, about.
AT_ONCE, PACKED_AT_ONCE = 1 << 20, 1 << 18
#: Size of the bitmap at most, as a power of two: 8 MB.
MAX_BITS = 26
WORD = re.compile(rb"[^ \t-\r]+")
ENDINGS = (b",", b".")
WORD_END = "</w>"


def cuts(data: bytes) -> list[int]:
    """Bounds of the chunks, 0 and the length included; never within a character. Just 0 if empty."""
    n = len(data)
    if n <= LEAST:
        return [0, n] if n else [0]
    limit = np.uint64((1 << 64) // MEAN)
    places = []
    for at in range(0, n - WINDOW, HASHED_AT_ONCE):
        count = min(HASHED_AT_ONCE, n - WINDOW - at)
        halves = [
            np.ndarray((count,), "<u8", buffer=data, offset=at + shift, strides=(1,)) for shift in (0, 8)
        ]
        low = np.flatnonzero(halves[0] * FACTORS[0] + halves[1] * FACTORS[1] < limit)
        places += (low + (at + WINDOW)).tolist()
    out = [0]
    for place in [*places, n]:
        while place - out[-1] > MOST:
            forced = out[-1] + MOST
            while data[forced] & 0xC0 == 0x80:
                forced -= 1
            out.append(forced)
        if place == n or place - out[-1] >= LEAST and data[place] & 0xC0 != 0x80:
            out.append(place)
    return out


def chunk_hash(chunk: bytes) -> tuple[int, int]:
    """128 bits as two signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(chunk))


class Bitmap:
    """Two bits for each shared chunk; may name others, never misses one."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, 64 * len(words) - 1

    def __contains__(self, chunk: tuple[int, int]) -> bool:
        return all(int(self.words[(h & self.mask) >> 6]) >> (h & 63) & 1 for h in chunk)

    @staticmethod
    def of(shared: DataFrame) -> Bitmap:
        bits = 1 << min(MAX_BITS, max(10, (16 * shared.count()).bit_length()))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))
        rows = (
            shared.select(F.explode(F.array("h1", "h2")).alias("h"))
            .select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at"))
            .groupBy(F.floor(F.col("at") / 64).alias("word"))
            .agg(F.bit_or(bit).alias("bits"))
            .toArrow()  # at most 2 ** MAX_BITS / 64 rows of two numbers
        )
        words = np.zeros(bits // 64, np.int64)
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        return Bitmap(words.view(np.uint64))


class Encoder:
    """Ids of words, remembered from task to task; ids are little-endian 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory: dict[bytes, bytes] = {}
        #: Words met again since the others were forgotten last; they stay when the rest goes.
        self.again: set[bytes] = set()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.ends_word = np.array([t.endswith(WORD_END) for t in tokens])

    def library(self, texts: Iterable[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def learn(self, lists: Iterable[list[bytes]]) -> None:
        """Encodes the words not yet known.

        An ASCII word is encoded in lower case, which the tokenizer gives it anyway,
        and without a comma or full stop behind a letter or digit, which it splits off.
        """
        words = set(ENDINGS).union(*lists)
        if len(self.memory) > REMEMBERED:
            kept = self.again if 2 * len(self.again) < REMEMBERED else ()
            self.memory, self.again = {w: self.memory[w] for w in kept}, set()
        memory = self.memory
        new = {w: _plain(w) for w in words if w not in memory}
        self.again.update(words.difference(new))
        missing = [b for b in {base for base, _ in new.values()} if b not in memory]
        letters = [b for b in missing if b.isalpha() or not b.isascii() and b.decode().isalpha()]
        rest = list(set(missing).difference(letters))
        for at in range(0, len(letters), 4096):
            memory.update(self._letters(letters[at : at + 4096]))
        memory.update(zip(rest, self.library(rest)))
        for word, (base, ending) in new.items():
            memory[word] = memory[base] + memory[ending] if ending else memory[base]

    def _letters(self, words: list[bytes]) -> Iterable[tuple[bytes, bytes]]:
        """Words of letters, each of which ends in one token that ends a word, encoded as one text."""
        data = self.library([b" ".join(words)])[0]
        ends = 4 * (np.flatnonzero(self.ends_word[np.frombuffer(data, "<u4")]) + 1)
        if len(ends) != len(words) or ends[-1] != len(data):
            return zip(words, self.library(words))
        bounds = [0, *ends.tolist()]
        return ((word, data[a:b]) for word, a, b in zip(words, bounds, bounds[1:]))

    def ids(self, words: Iterable[bytes]) -> bytes:
        return b"".join(map(self.memory.__getitem__, words))


def check_kind(tokenizer: Tokenizer) -> None:
    """Refuse tokenizers of a kind for which words cannot be encoded on their own.

    Their words end in a suffix of their own, are split at white space, of which nothing
    is left, and at a comma or full stop, and do not depend on the case of ASCII letters.
    """
    bare = Tokenizer.from_str(tokenizer.to_str())
    bare.no_truncation()
    bare.no_padding()

    def ids(text: str) -> list[int]:
        return bare.encode(text, add_special_tokens=False).ids

    words = ["The", "9", "it'll", "na\u00efve", "x_y", "QUICK", "a.b"]
    alone = [i for word in words for i in ids(word)]
    fits = json.loads(bare.to_str())["model"].get("end_of_word_suffix") == WORD_END
    fits = fits and all(ids(space + space.join(words) + space) == alone for space in " \t\n\v\f\r")
    fits = fits and ids("QUICK") == ids("quick")
    fits = fits and all(ids("quick" + e) == ids("quick") + ids(e) for e in (",", "."))
    if not fits:
        raise ValueError("the tokenizer does not encode words between white space on their own")


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which runs one task after another."""
    state = sys.modules.setdefault("_bpe_of_this_worker", ModuleType("_bpe_of_this_worker"))
    if path not in vars(state):
        setattr(state, path, Encoder(path))
    return getattr(state, path)


def _plain(word: bytes) -> tuple[bytes, bytes]:
    """The word to encode, and the full stop or comma to add."""
    if word.isalpha():
        return word.lower(), b""
    if not word.isascii() or b"<|" in word:
        return word, b""
    word = word.lower()
    if word.endswith(ENDINGS) and word[-2:-1].isalnum():
        return word[:-1], word[-1:]
    return word, b""


def core(chunk: bytes) -> list[bytes] | None:
    """Words between the first and the last white space; None without white space."""
    words = chunk.split()
    if len(words) == 1 and len(words[0]) == len(chunk):
        return None
    return words[0 if chunk[:1].isspace() else 1 : None if chunk[-1:].isspace() else -1]


def _edges(chunk: bytes) -> tuple[bytes, bytes]:
    """What comes before the first white space and after the last of a chunk that has one."""
    head = b"" if chunk[:1].isspace() else chunk.split(None, 1)[0]
    tail = b"" if chunk[-1:].isspace() else chunk.rsplit(None, 1)[-1]
    return head, tail


def parts(data: bytes, bounds: list[int], known: dict[int, bytes]) -> list[list[bytes] | bytes]:
    """The text as lists of words and, for chunks whose ids are known, these; joined words are whole."""
    out: list[list[bytes] | bytes] = []
    pending = b""
    for place, (a, b) in enumerate(zip(bounds, bounds[1:])):
        chunk = data[a:b]
        inner = known.get(place)
        if inner is None:
            inner = core(chunk)
        if inner is None:
            pending += chunk
            continue
        head, tail = _edges(chunk)
        if pending or head:
            out.append([pending + head])
        out.append(inner)
        pending = tail
    if pending:
        out.append([pending])
    return out


def join_window(data: bytes, place: int) -> list[bytes] | None:
    """The words at a join and beside it, and the text they span as the last item."""
    low, high = max(0, place - JOIN_BYTES), min(len(data), place + JOIN_BYTES)
    spans = [m.span() for m in WORD.finditer(data, low, high)]
    if spans and low and spans[0][0] == low and not data[low - 1 : low].isspace():
        spans = spans[1:]
    if spans and high < len(data) and spans[-1][1] == high and not data[high : high + 1].isspace():
        spans = spans[:-1]
    at = next((i for i, (_, end) in enumerate(spans) if end >= place), len(spans))
    spans = spans[max(0, at - 1) : at + 2]
    if not spans:
        return None
    return [data[a:b] for a, b in spans] + [data[spans[0][0] : spans[-1][1]]]


def encode_texts(encoder: Encoder, texts: list[bytes], known: list[dict[int, bytes]]) -> list[bytes]:
    """Ids of whole texts from chunks, whose ids may be known by their place, with joins repaired."""
    bounds = [cuts(data) for data in texts]
    cut = [parts(*of) for of in zip(texts, bounds, known)]
    windows = []
    for i, data in enumerate(texts):
        for place in bounds[i][1:-1]:
            window = join_window(data, place)
            if window:
                windows.append((i, window[:-1], window[-1]))
    encoder.learn([*(p for ps in cut for p in ps if isinstance(p, list)), *(w for _, w, _ in windows)])
    whole = encoder.library([window for _, _, window in windows])
    wrong = {i for (i, words, _), ids in zip(windows, whole) if encoder.ids(words) != ids}
    out = [b"".join(p if isinstance(p, bytes) else encoder.ids(p) for p in ps) for ps in cut]
    for i in wrong:
        out[i] = encoder.library([texts[i]])[0]
    return out


def encode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: str | None = None,
    decoded_col: str | None = None,
) -> DataFrame:
    """(doc_id, ids): one row for each row of ``docs``, ids as little-endian 32-bit numbers.

    ``path`` is the tokenizer's file, which executors have at the same place; see
    ``check_kind`` for those that are refused. A null
    text is encoded like an empty one, to no ids. Null ids and repeated rows are kept.
    ``carry`` names a column of whole numbers, the same whenever ``docs`` is read, that
    every row keeps; other columns are not read. ``decoded_col`` names a column for the
    ids' text, as by ``decode``, for which no second pass over the ids is needed then.
    """
    source = in_small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        *([] if carry is None else [F.col(carry).cast("long").alias("carried")]),
    )
    own = [name for name in source.columns if name != "text"]
    own_schema = ", ".join(f"{name} long" for name in own)
    tokenizer = Tokenizer.from_file(path)
    check_kind(tokenizer)
    vocabulary = tokenizer.get_vocab_size(with_added_tokens=True)
    sent = "<u2" if vocabulary <= 1 << 16 else "<u4"
    text_of = None if decoded_col is None else decoder(tokenizer)
    out_schema = "ids binary" if decoded_col is None else "ids binary, decoded string"

    def outcome(columns: list[pa.Array], names: list[str], ids: list[bytes]) -> pa.RecordBatch:
        columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
        if text_of is not None:
            columns, names = [*columns, pa.array(map(text_of, ids), pa.string())], [*names, "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    def texts_of(part: pa.RecordBatch) -> list[bytes]:
        return [(t or "").encode() for t in part.column("text").to_pylist()]

    def keys_of(part: pa.RecordBatch, texts: list[bytes]) -> list[bytes]:
        owners = zip(*(part.column(name).to_pylist() for name in own))
        heads = [b"".join(b"%d:" % i if i is not None else b":" for i in row) for row in owners]
        return [hashlib.sha256(head + t).digest() for head, t in zip(heads, texts)]

    def unpacked(part: pa.RecordBatch) -> list[bytes]:
        opened = zstandard.ZstdDecompressor()
        return [opened.decompress(data) for data in part.column("data").to_pylist()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            texts = texts_of(part)
            keys, places, hashes = [], [], []
            for row, data in zip(keys_of(part, texts), texts):
                bounds = cuts(data)
                keys += [row] * (len(bounds) - 1)
                places += range(len(bounds) - 1)
                hashes += [chunk_hash(data[a:b]) for a, b in zip(bounds, bounds[1:])]
            columns = [pa.array([h[i] for h in hashes], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(places, pa.int32()), *columns],
                ["row", "place", "h1", "h2"],
            )

    chunks = stored(source.mapInArrow(cut, "row binary, place int, h1 long, h2 long").distinct())
    shared = stored(
        chunks.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(F.struct("row", "place")).alias("home"))
        .where("n > 1")
    )
    bits = docs.sparkSession.sparkContext.broadcast(Bitmap.of(shared).words)

    def shares(data: bytes) -> bool:
        bounds, bitmap = cuts(data), Bitmap(bits.value)
        return any(chunk_hash(data[a:b]) in bitmap for a, b in zip(bounds, bounds[1:]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for part in slices(batches, 512):
            texts = texts_of(part)
            keep = pa.array([shares(t) for t in texts], pa.bool_())
            keys, packed = keys_of(part, texts), [packer.compress(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), *map(part.column, own), pa.array(packed, pa.binary())],
                ["row", *own, "data"],
            ).filter(keep)

    def encode_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for part in light_slices(batches, "text", 256, AT_ONCE):
            texts = texts_of(part)
            alone = [not shares(t) for t in texts]
            ids = encode_texts(encoder, [t for t, a in zip(texts, alone) if a], [{}] * sum(alone))
            keep = pa.array(alone, pa.bool_())
            yield outcome([part.column(name).filter(keep) for name in own], own, ids)

    def encode_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for part in light_slices(batches, "data", 256, PACKED_AT_ONCE):
            hashes, words = [], []
            for data, homes in zip(unpacked(part), part.column("homes").to_pylist()):
                bounds = cuts(data)
                for home in homes:
                    hashes.append((home["h1"], home["h2"]))
                    words.append(core(data[bounds[home["place"]] : bounds[home["place"] + 1]]))
            encoder.learn([ws for ws in words if ws])
            ids = [
                None if ws is None else np.frombuffer(encoder.ids(ws), "<u4").astype(sent).tobytes()
                for ws in words
            ]
            columns = [pa.array([h[i] for h in hashes], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], ["h1", "h2", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for part in light_slices(batches, "data", 256, PACKED_AT_ONCE):
            known = [
                {c["place"]: np.frombuffer(c["ids"], sent).astype("<u4").tobytes() for c in chunks or ()}
                for chunks in part.column("chunks").to_pylist()
            ]
            ids = encode_texts(encoder, unpacked(part), known)
            yield outcome([*map(part.column, own), part.column("copies")], [*own, "copies"], ids)

    homes = shared.groupBy(F.col("home.row").alias("at")).agg(
        F.collect_list(F.struct("h1", "h2", "home.place")).alias("homes")
    )
    whole = (
        source.mapInArrow(pack, f"row binary, {own_schema}, data binary")
        .where("row IS NOT NULL")  # holds; Spark would add it for one of the two joins only
        .groupBy("row")
        .agg(*(F.first(name).alias(name) for name in [*own, "data"]), F.count("*").alias("copies"))
    )
    once = (
        whole.join(homes, F.col("row") == F.col("at"))
        # all columns, as below, so that both take the texts from one shuffle
        .select("row", *own, "copies", "data", "homes")
        .mapInArrow(encode_shared, "h1 long, h2 long, ids binary")
        .where("ids IS NOT NULL")
    )
    sent_to = (
        chunks.join(once, ["h1", "h2"])
        .groupBy(F.col("row").alias("to"))
        .agg(F.collect_list(F.struct("place", "ids")).alias("chunks"))
    )
    encoded = (
        whole.join(sent_to, F.col("row") == F.col("to"), "left")
        .select("row", *own, "copies", "data", "chunks")
        .mapInArrow(assemble, f"{own_schema}, copies long, {out_schema}")
    )
    together = encoded.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
    out = together.unionByName(source.mapInArrow(encode_alone, f"{own_schema}, {out_schema}"))
    return out.select(
        "doc_id",
        "ids",
        *([] if carry is None else [F.col("carried").alias(carry)]),
        *([] if decoded_col is None else [F.col("decoded").alias(decoded_col)]),
    )


def decoder(tokenizer: Tokenizer) -> Callable[[bytes], str]:
    """The text of ids, for tokenizers without a decoder of their own, whose tokens are joined by blanks."""
    if tokenizer.decoder is not None:
        raise ValueError("the tokenizer has a decoder of its own")
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    tokens = [tokenizer.id_to_token(i) or "" for i in range(size)]
    return lambda ids: " ".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, special tokens included; null for null ids.

    For the tokenizers that ``decoder`` takes.
    """
    schema = encoded.drop(text_col).withColumn(text_col, F.lit("")).schema
    text_of = decoder(Tokenizer.from_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in light_slices(batches, ids_col, 256, AT_ONCE):
            texts = [None if ids is None else text_of(ids) for ids in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.string())], [*part.schema.names, text_col]
            )

    return in_small_batches(encoded).drop(text_col).mapInArrow(run, schema)
