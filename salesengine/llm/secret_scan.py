"""Secret scan: fixed patterns, and a character convolutional network over other candidates.

A candidate is a run of 12 or more characters of keys and tokens with a digit in it.
The network reads all of it and the text around it. It is trained on all findings,
labelled by the patterns: dealt out to shards, each of which is fitted on by a task,
with the tasks' weights averaged after every epoch. Its logits are calibrated on all
findings held back, and the threshold of each shape of candidate is the highest that
keeps the asked recall of those. Candidates at or above it that touch no pattern's
span become spans of kind ``model``; the patterns' spans always stay.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.llm.common import in_small_batches, stored, text_batches, unused

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
#: One of these is in every match of ASSIGN.
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
DIGIT = re.compile(r"[0-9]")
SHAPES = ("digits", "hex", "mixed")
CONTEXT = 24
REPLACEMENT = "[SECRET]"


def base_spans(text: str, runs: list[re.Match] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order; positions are code points.

    Access keys and hex strings lie in runs of at least 12 key characters.
    """
    found = []
    lower = text.encode().lower()
    if any(word in lower for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text) if runs is None else runs:
        if run.end() - run.start() >= 20:
            within = run.span()
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, *within) if len(m[0]) >= 20]
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, *within)]
    return sorted(found)


#: Characters of a candidate that the filters see at once, and of a batch with its padding.
BLOCK, PADDED = 4_096, 1 << 16
#: Known findings from which on a fifth is enough to calibrate on; of fewer, half are held back.
ENOUGH = 150


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    window: str
    known: bool

    @property
    def offset(self) -> int:
        return min(self.start, CONTEXT)

    @property
    def length(self) -> int:
        return self.end - self.start

    @property
    def shape(self) -> int:
        value = self.window[self.offset : self.offset + self.length]
        return 0 if value.isdigit() else 1 if re.fullmatch("[0-9a-fA-F]+", value) else 2


def candidates(text: str, runs: list[re.Match], spans: list[tuple[int, int, int]]) -> list[Candidate]:
    """Every run with a digit, with the text around it; known if it touches a pattern's span."""
    out = []
    for run in runs:
        a, b = run.span()
        if DIGIT.search(text, a, b):
            known = any(start < b and a < end for start, _, end in spans)
            out.append(Candidate(a, b, text[max(0, a - CONTEXT) : b + CONTEXT], known))
    return out


@dataclass(frozen=True)
class Settings:
    """Shape of the fit; a task fits on about ``shard`` findings, of ``chars`` characters with their context."""

    shard: int = 4_096
    chars: int = 1 << 24
    recall: float = 0.99
    embed: int = 8
    width: int = 5
    filters: int = 24
    epochs: int = 8
    seed: int = 7


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    thresholds: list[float] = field(default_factory=lambda: [1.1] * len(SHAPES))
    fitted: int = 0
    held: int = 0

    def logits(self, found: list[Candidate]) -> np.ndarray:
        """Batches of like length, of bounded size; a long candidate is read in overlapping blocks."""
        out = np.empty(len(found))
        width = len(self.weights["conv"]) // self.weights["embed"].shape[1]
        order = sorted(range(len(found)), key=lambda i: len(found[i].window))
        for rows in batches_of([len(found[i].window) for i in order]):
            rows = [order[i] for i in rows]
            pooled, _ = strongest(self.weights, encode([found[i] for i in rows], width))
            out[rows] = pooled @ self.weights["out"] + self.weights["bias"][0]
        return out

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * logits + self.shift)))

    def scores(self, found: list[Candidate]) -> np.ndarray:
        return self.score(self.logits(found))


def batches_of(lengths: list[int]) -> Iterator[range]:
    """Places of rising lengths that are padded to one: 64, or fewer of long ones."""
    begin = 0
    for i, length in enumerate(lengths):
        if i > begin and (i - begin == 64 or (i - begin + 1) * length > PADDED):
            yield range(begin, i)
            begin = i
    if lengths:
        yield range(begin, len(lengths))


def encode(found: list[Candidate], width: int) -> np.ndarray:
    """Character classes padded to one length: ASCII or other, within the candidate or around it.

    Every row has ``width`` places of padding or more, so that each filter sees nothing but
    padding somewhere, and no score depends on what else is in the batch.
    """
    longest = max(len(c.window) for c in found) + width
    codes = np.zeros((len(found), longest), np.int64)
    for row, c in zip(codes, found):
        chars = np.frombuffer(c.window.encode("utf-32-le", "surrogatepass"), np.uint32)
        row[: len(chars)] = np.minimum(chars, 127) + 1
        row[c.offset : c.offset + c.length] += 128
    return codes


def forward(w: dict[str, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of embedded characters, the filters' largest values, and where these are."""
    width = len(w["conv"]) // w["embed"].shape[1]
    if codes.shape[1] < width:
        codes = np.pad(codes, ((0, 0), (0, width - codes.shape[1])))
    embedded = w["embed"][codes]
    wide = np.concatenate([embedded[:, i : codes.shape[1] - width + 1 + i] for i in range(width)], axis=2)
    values = wide @ w["conv"] + w["conv_bias"]
    where = values.argmax(axis=1)
    top = np.maximum(np.take_along_axis(values, where[:, None, :], axis=1)[:, 0], 0)
    return wide, top, where


def strongest(w: dict[str, np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filters' largest values and where these are, taken block by block."""
    width = len(w["conv"]) // w["embed"].shape[1]
    best, place = None, None
    for start in range(0, codes.shape[1] - width + 1, BLOCK):
        _, top, where = forward(w, codes[:, start : start + BLOCK + width - 1])
        if best is None:
            best, place = top, where
        else:
            place = np.where(top > best, start + where, place)
            best = np.maximum(best, top)
    return best, place


class Descent:
    """Weights on their way down and the running moments of their gradients."""

    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        e, f = settings.embed, settings.filters
        self.settings = settings
        self.weights = {
            "embed": rng.normal(0, 0.3, (257, e)),
            "conv": rng.normal(0, 1 / np.sqrt(e * settings.width), (e * settings.width, f)),
            "conv_bias": np.zeros(f),
            "out": rng.normal(0, 0.2, f),
            "bias": np.zeros(1),
        }
        self.first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        self.step = 0
        self.rng = rng

    def epoch(self, found: list[Candidate], order: np.ndarray, weight: np.ndarray) -> None:
        """One pass over the findings in this order, 64 at a time; ``weight`` is by label."""
        for at in range(0, len(order), 64):
            rows = sorted(order[at : at + 64], key=lambda i: len(found[i].window))
            total = {k: np.zeros_like(v) for k, v in self.weights.items()}
            for part in batches_of([len(found[i].window) for i in rows]):
                self.add_gradients(total, [found[rows[i]] for i in part], weight / len(rows))
            self.step += 1
            for k, g in total.items():
                self.first[k] = 0.9 * self.first[k] + 0.1 * g
                self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
                mean, spread = self.first[k] / (1 - 0.9**self.step), self.second[k] / (1 - 0.999**self.step)
                self.weights[k] = self.weights[k] - 0.01 * mean / (np.sqrt(spread) + 1e-8)

    def add_gradients(self, total: dict[str, np.ndarray], found: list[Candidate], weight: np.ndarray) -> None:
        w, e, width = self.weights, self.settings.embed, self.settings.width
        labels = np.array([c.known for c in found], int)
        codes = encode(found, width)
        top, where = strongest(w, codes)
        score = 1 / (1 + np.exp(-(top @ w["out"] + w["bias"][0])))
        error = (score - labels) * weight[labels]
        active = error[:, None] * w["out"] * (top > 0)
        total["out"] += top.T @ error
        total["bias"] += error.sum()
        total["conv_bias"] += active.sum(axis=0)
        chars = [np.take_along_axis(codes, where + i, axis=1) for i in range(width)]
        picked = np.concatenate([w["embed"][c] for c in chars], axis=2)  # row, filter, inputs
        total["conv"] += np.einsum("rfi,rf->if", picked, active)
        back = active[:, :, None] * w["conv"].T[None]
        for i, at_char in enumerate(chars):
            np.add.at(total["embed"], at_char, back[:, :, i * e : (i + 1) * e])

    def flat(self) -> np.ndarray:
        parts = (self.weights, self.first, self.second)
        return np.concatenate([v.ravel() for part in parts for v in part.values()])

    def resume(self, flat: np.ndarray, step: int) -> None:
        self.step, at = step, 0
        for part in (self.weights, self.first, self.second):
            for k, v in part.items():
                part[k] = flat[at : at + v.size].reshape(v.shape)
                at += v.size


def by_label(known: int, rows: int) -> np.ndarray:
    """Weights with which both labels count the same."""
    return np.array([0.5 / (1 - known / rows), 0.5 / (known / rows)])


def fit(found: list[Candidate], settings: Settings) -> Model | None:
    """Fits on one machine; None without findings of both labels: then no span is added."""
    labels = np.array([c.known for c in found], float)
    place = np.arange(len(found))
    held = place % 5 == 0 if labels.sum() >= ENOUGH else place % 4 < 2
    if not all(0 < labels[part].sum() < part.sum() for part in (held, ~held)):
        return None
    descent = Descent(settings)
    train = np.flatnonzero(~held)
    weight = by_label(labels[train].sum(), len(train))
    for _ in range(settings.epochs):
        descent.rng.shuffle(train)
        descent.epoch(found, train, weight)
    calibration = [c for c, h in zip(found, held) if h]
    model = Model(descent.weights, fitted=len(train), held=len(calibration))
    model.scale, model.shift = calibrate(model.logits(calibration), labels[held])
    scores = model.scores(calibration)
    model.thresholds = thresholds(scores, labels[held], [c.shape for c in calibration], settings.recall)
    return model


def fit_in_shards(found: DataFrame, rows: int, chars: int, settings: Settings) -> Model | None:
    """The same fit for findings of any number; which are held back depends on their hashes.

    ``found`` has offset, length, window and known, and is read once an epoch. The order in
    which tasks end does not matter: sums are taken over decimals and counts.
    """
    key = F.xxhash64("window", "offset", "length")
    known = found.where("known").count()
    held = F.pmod(key, F.lit(5)) == 0 if known >= ENOUGH else F.pmod(key, F.lit(4)) < 2
    found = found.withColumn("held", held)
    counted = {(r.held, r.known): r["count"] for r in found.groupBy("held", "known").count().collect()}
    if len(counted) < 4:
        return None
    train, back = found.where(~F.col("held")), found.where("held")
    fitted = counted[False, True] + counted[False, False]
    weight = by_label(counted[False, True], fitted)
    shards = max(1, round(rows / settings.shard), -(-chars // settings.chars))
    dealt = train.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "window", "offset", "length"), F.lit(shards)))
    descent = Descent(settings)
    for epoch in range(settings.epochs):
        descent.resume(*averaged(dealt, descent, epoch, weight))
    model = Model(descent.weights, fitted=fitted, held=counted[True, True] + counted[True, False])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = read_findings(batch)
            columns = [
                pa.array(model.logits(part), pa.float64()),
                pa.array([c.known for c in part], pa.bool_()),
                pa.array([c.shape for c in part], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["logit", "known", "shape"])

    logits = stored(back.drop("held").mapInArrow(run, "logit double, known boolean, shape int"))
    steps = F.round(F.col("logit") * STEPS).cast("long").alias("step")
    bins = logits.groupBy(steps, "known").count().orderBy("step", "known").collect()  # of a bounded range
    model.scale, model.shift = calibrate(
        np.array([b.step / STEPS for b in bins]),
        np.array([b.known for b in bins], float),
        np.array([b["count"] for b in bins], float),
    )
    secrets = logits.where("known").select("shape", (F.col("logit") * (1 if model.scale >= 0 else -1)).alias("value"))

    def lowest(part: DataFrame, n: int) -> float:
        value = order_statistic(part, int((1 - settings.recall) * n))
        return float(model.score(np.array([value if model.scale >= 0 else -value]))[0])

    of_shape = {r["shape"]: r["count"] for r in secrets.groupBy("shape").count().collect()}
    every = lowest(secrets, sum(of_shape.values()))
    model.thresholds = [
        lowest(secrets.where(F.col("shape") == s), of_shape[s]) if of_shape.get(s, 0) >= 20 else every
        for s in range(len(SHAPES))
    ]
    return model


#: Steps of a logit at which findings are counted together to calibrate on.
STEPS = 256


def read_findings(batch: pa.RecordBatch | pa.Table) -> list[Candidate]:
    names = ("offset", "length", "window", "known")
    rows = zip(*(batch.column(name).to_pylist() for name in names))
    return [Candidate(offset, offset + length, window, known) for offset, length, window, known in rows]


def averaged(dealt: DataFrame, descent: Descent, epoch: int, weight: np.ndarray) -> tuple[np.ndarray, int]:
    """State and steps after an epoch that every shard makes on its own findings, by their numbers."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = sorted(read_findings(rows), key=lambda c: (c.window, c.start, c.end))
        own = copy.deepcopy(descent)
        order = np.random.default_rng([descent.settings.seed, epoch, key[0].as_py()]).permutation(len(found))
        own.epoch(found, order, weight)
        state = pa.array([own.flat().tolist()], pa.list_(pa.float64()))
        return pa.Table.from_arrays([state, pa.array([len(found)]), pa.array([own.step])], ["state", "n", "step"])

    ended = dealt.groupBy("shard").applyInArrow(run, "state array<double>, n long, step long")
    sums = (
        ended.select("n", "step", F.posexplode("state").alias("place", "value"))
        .groupBy("place")
        .agg(
            F.sum(F.col("value").cast("decimal(28,18)") * F.col("n").cast("decimal(10,0)")).alias("total"),
            F.sum("n").alias("n"),
            F.max("step").alias("step"),
        )
        .orderBy("place")
        .collect()  # one row for each weight and moment
    )
    return np.array([float(r.total) / r.n for r in sums]), sums[0].step


def order_statistic(values: DataFrame, place: int) -> float:
    """The value at this place of the rising order, by counts over ever narrower ranges."""
    low, high = values.agg(F.min("value"), F.max("value")).first()
    while low < high:
        part = F.least(F.floor((F.col("value") - low) / ((high - low) / 1000)), F.lit(999))
        counts = (
            values.where(F.col("value").between(low, high))
            .groupBy(part.alias("part"))
            .agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            .orderBy("part")
            .collect()  # a thousand rows at most
        )
        for r in counts:
            if place < r.n:
                low, high = r.low, r.high
                break
            place -= r.n
    return low


def calibrate(logits: np.ndarray, labels: np.ndarray, n: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Scale and shift by which the logits' sigmoid fits the labels best, with a weak prior.

    ``n`` is the number of findings each logit and label stands for.
    """
    scale, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(scale * logits + shift, -30, 30)))
        v = n * (p * (1 - p) + 1e-6)
        grad = np.array([(n * (p - labels) * logits).sum() + 0.1 * (scale - 1), (n * (p - labels)).sum()])
        hess = np.array([[(v * logits**2).sum() + 0.1, (v * logits).sum()], [(v * logits).sum(), v.sum()]])
        move = np.linalg.solve(hess, grad)
        scale, shift = scale - np.clip(move[0], -1, 1), shift - np.clip(move[1], -1, 1)
    return float(scale), float(shift)


def thresholds(scores: np.ndarray, labels: np.ndarray, shapes: list[int], recall: float) -> list[float]:
    """By shape the highest score that keeps the recall, of all where a shape has under 20 findings."""

    def of(part: np.ndarray) -> float:
        known = np.sort(scores[part & (labels == 1)])
        return float(known[int((1 - recall) * len(known))])

    by_shape = np.array(shapes)
    everything = np.ones(len(scores), bool)
    return [
        of(by_shape == s) if ((by_shape == s) & (labels == 1)).sum() >= 20 else of(everything)
        for s in range(len(SHAPES))
    ]


def train(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text") -> Model | None:
    """Fits on all different findings of all texts, of any length.

    A fifth of them, half where few are known, is held back for scale and thresholds. As
    many as one task would fit on are fitted on here, more in shards by the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "text"):
            found = []
            for text in texts:
                runs = list(RUN.finditer(text))
                if runs:
                    found += candidates(text, runs, base_spans(text, runs))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c.offset for c in found], pa.int32()),
                    pa.array([c.length for c in found], pa.int32()),
                    pa.array([c.window for c in found], pa.string()),
                    pa.array([c.known for c in found], pa.bool_()),
                ],
                ["offset", "length", "window", "known"],
            )

    found = in_small_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(
        run, "offset int, length int, window string, known boolean"
    )
    best = stored(found.groupBy("window", "offset", "length").agg(F.max("known").alias("known")))
    n, chars = best.agg(F.count("*"), F.coalesce(F.sum(F.length("window")), F.lit(0))).first()
    if n > settings.shard or chars > settings.chars:
        return fit_in_shards(best, n, chars, settings)
    rows = best.collect()  # a shard at most
    rows.sort(key=lambda r: (hash_order(r.window), r.offset, r.length))
    return fit([Candidate(r.offset, r.offset + r.length, r.window, r.known) for r in rows], settings)


def hash_order(window: str) -> int:
    value = 0
    for byte in window.encode():
        value = (value * 1_000_003 ^ byte) & 0xFFFFFFFF
    return value


def spans(text: str, model: Model | None) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) in order of start and kind; a pattern's span has score 1."""
    runs = list(RUN.finditer(text))
    found = base_spans(text, runs)
    out = [(*span, 1.0) for span in found]
    others = [c for c in candidates(text, runs, found) if not c.known] if model and runs else []
    if others:
        for c, score in zip(others, model.scores(others).tolist()):
            if score >= model.thresholds[c.shape]:
                out.append((c.start, 3, c.end, score))
    return sorted(out)


def scan(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, spans): one row for each row of ``docs``, with spans (kind, start, end, score).

    Spans are sorted by start, then kind; ends are exclusive and positions code
    points. Null and empty texts have none. Null ids and repeated rows are kept;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        )
        for part, texts in text_batches(batches, "text"):
            found = [
                [{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in spans(t, model)]
                for t in texts
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    source = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
    )


def masked(text: str, model: Model | None) -> str:
    """The text with a fixed word in place of every secret; spans that overlap are one."""
    out, at = [], 0
    for a, _, b, _ in spans(text, model):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], REPLACEMENT]
        at = b
    return "".join([*out, text[at:]]) if out else text


def mask(
    docs: DataFrame, model: Model | None, text_col: str = "text", length_col: str | None = None
) -> DataFrame:
    """``docs`` with secrets masked in the text, and the new number of characters in ``length_col``.

    Null texts stay null; all rows and columns are kept.
    """
    original = in_small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, text_col):
            place = part.schema.get_field_index(text_col)
            nulls = part.column(place).is_null().to_pylist()
            new = pa.array([None if n else masked(t, model) for t, n in zip(texts, nulls)], pa.string())
            yield part.set_column(place, part.schema.field(place).with_type(pa.string()), new)

    out = original.mapInArrow(run, docs.schema)
    if length_col is None:
        return out
    before = unused(docs, "before")
    return out.withColumn(before, F.col(length_col)).withColumn(
        length_col, F.when(F.col(before).isNotNull(), F.length(text_col).cast(docs.schema[length_col].dataType))
    ).drop(before)
