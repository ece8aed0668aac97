"""Toxicity: a linear-chain conditional random field tags toxic words of whole texts.

Labels name documents, so words get theirs first: in toxic documents of the fitting
sample those words are toxic whose form, or whose first letters, are found in several
toxic documents and hardly in clean ones. The field has two states and learns from
these words; its emissions come from hashed features of a word's form, so that words
not seen before are tagged by their parts. Forward and backward passes over sentences
give each word its marginal probability; a document's score is a calibrated function
of its marginals, fitted on documents the field has not seen, and the words at or
above one half are the offending spans.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.llm.common import in_small_batches, text_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PUNCTUATION = b"\"'.,;:!?()[]{}<>|#*$%&-_/\\"
STOPS = (b".", b"!", b"?")
#: Weights of hashed features; number 0 is that of features a word lacks, always 0.
BUCKETS = 1 << 17
#: Bytes of a form that are told apart, in eights, and the prefixes that are features.
FORM_BYTES, PREFIXES = 32, (3, 4, 5, 6, 7, 8)
#: A chain ends with a sentence, or after this many words.
LONGEST_CHAIN = 64
#: Smaller chances to be toxic count as none, else a long text gathers them.
SLIGHT = 0.1
#: Words a task remembers before it starts anew.
REMEMBERED = 400_000
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
#: Hashes by which near copies are looked up, half of which they share, and the share of
#: word pairs, of all that either text has, from which on a text is a near copy.
COPY_HASHES, COPY_SHARE = 16, 0.8


@dataclass(frozen=True)
class Settings:
    """Bounds of the fitting sample, and how words get labels and the field its weights.

    At most ``toxic`` and ``clean`` labelled documents of at most ``chars`` characters
    are fitted on, those with the smallest hashes of their ids.
    """

    toxic: int = 2_000
    clean: int = 4_000
    chars: int = 10_000
    least_odds: float = 30.0
    least_evidence: float = 6.5
    epochs: int = 8
    least_steps: int = 400
    seed: int = 11


@dataclass
class Model:
    weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    score: np.ndarray

    def emissions(self, words: list[bytes]) -> np.ndarray:
        return self.weights[features(words)].sum(axis=1)


def form(word: bytes) -> bytes:
    return word.lower().strip(PUNCTUATION)


def association_keys(word: bytes) -> list[bytes]:
    w = form(word)
    if not w or w.isdigit():
        return []
    return [b"=" + w] + [b"^" + w[:n] for n in PREFIXES[1:] if len(w) > n]


def features(words: list[bytes]) -> np.ndarray:
    """Buckets of every word: one all words share, its form, and its first bytes."""
    forms = [form(w) for w in words]
    blocks = np.array(forms, f"S{FORM_BYTES}").view("<u8").reshape(len(words), FORM_BYTES // 8)
    sizes = np.array([len(f) for f in forms], np.uint64)
    out = np.zeros((len(words), 2 + len(PREFIXES)), np.int64)
    shift = np.uint64(64 - 17)
    out[:, 0] = 1
    whole = (blocks * FACTORS).sum(axis=1, dtype=np.uint64) + sizes
    out[:, 1] = 2 + (whole * FACTORS[1] >> shift).astype(np.int64) % (BUCKETS - 2)
    for i, n in enumerate(PREFIXES, 2):
        mask = np.uint64((1 << 8 * n) - 1)
        hashed = (((blocks[:, 0] & mask) + np.uint64(n)) * FACTORS[0]) * FACTORS[2] >> shift
        out[:, i] = np.where(sizes >= n, 2 + hashed.astype(np.int64) % (BUCKETS - 2), 0)
    return out


def chains(stops: np.ndarray) -> np.ndarray:
    """Lengths of the chains of a text, from where its words end a sentence."""
    ends = np.flatnonzero(stops) + 1
    if len(stops) and (not len(ends) or ends[-1] != len(stops)):
        ends = np.append(ends, len(stops))
    lengths = np.diff(ends, prepend=0)
    whole, rest = np.divmod(lengths, LONGEST_CHAIN)
    if not whole.any():
        return lengths
    pieces = [[LONGEST_CHAIN] * w + [r] * (r > 0) for w, r in zip(whole.tolist(), rest.tolist())]
    return np.array([x for piece in pieces for x in piece])


def marginals(
    emissions: np.ndarray, lengths: np.ndarray, start: np.ndarray, moves: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state in chains laid end to end; if asked, expected moves between states.

    Chains are padded into one table, the longest first, so that a step takes those still running.
    """
    if not len(lengths):
        return np.zeros(0), np.zeros((2, 2))
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    longest = int(sizes[0])
    running = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]
    forward = np.empty((2, longest, len(sizes)))
    backward = np.zeros((2, longest, len(sizes)))
    for t in range(longest):
        n = running[t]
        u = emissions[first[:n] + t]
        if t == 0:
            forward[0, 0], forward[1, 0] = start[0], start[1] + u
        else:
            a, b = forward[0, t - 1, :n], forward[1, t - 1, :n]
            forward[0, t, :n] = np.logaddexp(a + moves[0, 0], b + moves[1, 0])
            forward[1, t, :n] = np.logaddexp(a + moves[0, 1], b + moves[1, 1]) + u
    for t in range(longest - 2, -1, -1):
        n = running[t + 1]
        u = emissions[first[:n] + t + 1]
        a, b = backward[0, t + 1, :n], backward[1, t + 1, :n] + u
        backward[0, t, :n] = np.logaddexp(a + moves[0, 0], b + moves[0, 1])
        backward[1, t, :n] = np.logaddexp(a + moves[1, 0], b + moves[1, 1])
    out = np.empty(len(emissions))
    total = np.logaddexp(forward[0, 0] + backward[0, 0], forward[1, 0] + backward[1, 0])
    expected = np.zeros((2, 2))
    for t in range(longest):
        n = running[t]
        out[first[:n] + t] = np.exp(forward[1, t, :n] + backward[1, t, :n] - total[:n])
        if pairs and t + 1 < longest:
            n = running[t + 1]
            u = emissions[first[:n] + t + 1]
            for i in (0, 1):
                for j in (0, 1):
                    chance = forward[i, t, :n] + moves[i, j] + j * u + backward[j, t + 1, :n] - total[:n]
                    expected[i, j] += np.exp(chance).sum()
    return out, expected


def summary(chances: np.ndarray) -> np.ndarray:
    """What the score of a document is made of: its words with more than a slight chance."""
    if not len(chances) or chances.max() < SLIGHT:
        return np.zeros(4)
    words, chances = len(chances), chances[chances >= SLIGHT]
    hits = float(chances.sum())
    none = -float(np.log1p(-np.minimum(chances, 1 - 1e-9)).sum())
    return np.array([chances.max(), math.log1p(hits), hits / words, min(none, 20.0)])


def near_copies(texts: list[list[bytes]]) -> list[bool]:
    """Whether a text is a near copy of one before it: of the pairs of words both have COPY_SHARE are shared.

    Of the smallest hashes of their pairs such texts share at least half, but for one in a thousand.
    """
    factors = np.random.default_rng(0).integers(1 << 63, size=COPY_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.zeros((len(texts), COPY_HASHES), np.uint64)
    every: list[np.ndarray] = []
    out = []
    for i, words in enumerate(texts):
        pairs = [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])] or [zlib.crc32(b"".join(words))]
        every.append(np.unique(np.array(pairs, np.uint64)))
        mixed = every[i][:, None] * FACTORS[0]
        mixed ^= mixed >> np.uint64(31)
        least[i] = (mixed * factors >> np.uint64(20)).min(axis=0)
        alike = np.flatnonzero(2 * (least[:i] == least[i]).sum(axis=1) >= COPY_HASHES)
        shared = ((np.intersect1d(every[i], every[j], assume_unique=True).size, every[j].size) for j in alike.tolist())
        out.append(any(both >= COPY_SHARE * (every[i].size + size - both) for both, size in shared))
    return out


def word_labels(texts: list[list[bytes]], toxic: list[int], settings: Settings) -> set[bytes]:
    """Forms and first letters that tell toxic documents from clean ones.

    They are at least ``least_odds`` times as frequent in toxic ones, by more than
    chance would make them: ``least_evidence`` is the log likelihood ratio to a word
    found as often as documents of either kind have words. A near copy of one document
    of its kind does not count again.
    """
    counts, n, sizes = (Counter(), Counter()), [0, 0], [0, 0]
    for label in (0, 1):
        own = [words for words, of in zip(texts, toxic) if of == label]
        for words, copy in zip(own, near_copies(own)):
            if not copy:
                n[label] += 1
                sizes[label] += len(set(words))
                counts[label].update({k for w in set(words) for k in association_keys(w)})
    share = sizes[1] / max(1, sum(sizes))

    def tells(t: int, c: int) -> bool:
        evidence = t * math.log(t / ((t + c) * share)) + (c and c * math.log(c / ((t + c) * (1 - share))))
        odds = (t / n[1]) / ((c + 0.02) / max(1, n[0]))
        return evidence >= settings.least_evidence and odds >= settings.least_odds

    return {key for key, t in counts[1].items() if tells(t, counts[0][key])}


def fit(texts: list[str], toxic: list[int], settings: Settings) -> Model:
    """Fits the field on three of four documents and the score on the fourth."""
    known: dict[bytes, bytes] = {}  # a word is held once, however often it stands
    split = [[known.setdefault(w, w) for w in t.encode().split()] for t in texts]
    fitted = [i for i in range(len(split)) if i % 4]
    listed = word_labels([split[i] for i in fitted], [toxic[i] for i in fitted], settings)
    rng = np.random.default_rng(settings.seed)
    words: list[bytes] = []
    marks: list[bool] = []
    lengths: list[int] = []
    tells = {w for w in known if not listed.isdisjoint(association_keys(w))}
    for i in rng.permutation(fitted).tolist() if fitted else []:
        words += split[i]
        marks += [bool(toxic[i]) and w in tells for w in split[i]]
        lengths += chains(np.array([w.endswith(STOPS) for w in split[i]], bool)).tolist()
    model = Model(np.zeros(BUCKETS), np.zeros(2), np.zeros((2, 2)), np.array([-3.0, 3, 1, 1, 0.5]))
    if not any(marks):  # nothing to learn from: every word is clean
        model.moves[:, 1] = model.start[1] = -10
    else:
        _fit_field(model, words, np.array(marks, float), np.array(lengths), settings, rng)
    held = [i for i in range(len(split)) if i % 4 == 0]
    if 0 < sum(toxic[i] for i in held) < len(held):
        rows = np.array([summary(c) for c in Tagger(model).tag([split[i] for i in held])])
        model.score = fit_score(rows, np.array([toxic[i] for i in held], float), model.score)
    return model


def _fit_field(
    model: Model, words: list[bytes], marks: np.ndarray, lengths: np.ndarray, settings: Settings, rng
) -> None:
    """Gradient steps with rates of their own for every weight, over batches of chains."""
    places = {w: i for i, w in enumerate(dict.fromkeys(words))}
    number = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
    buckets = features(list(places))
    firsts = np.cumsum(lengths) - lengths
    squares, move_squares, decay = np.full(BUCKETS, 1e-2), np.full((2, 2), 1e-1), 1e-4
    epochs = max(settings.epochs, settings.least_steps // (1 + len(lengths) // 512))
    for _ in range(epochs):
        order = rng.permutation(len(lengths))
        for at in range(0, len(order), 512):
            batch = order[at : at + 512]
            sizes = lengths[batch]
            inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = np.repeat(firsts[batch], sizes) + inner
            here, truth = buckets[number[rows]], marks[rows]
            emissions = model.weights[here].sum(axis=1)
            chances, expected = marginals(emissions, sizes, model.start, model.moves, pairs=True)
            slope = np.bincount(here.ravel(), np.repeat(truth - chances, here.shape[1]), BUCKETS) / len(batch)
            slope -= decay * model.weights
            slope[0] = 0
            squares += slope * slope
            model.weights += 0.5 * slope / np.sqrt(squares)
            after = np.flatnonzero(inner)  # words behind another one of their chain
            seen = np.zeros((2, 2))
            np.add.at(seen, (truth[after - 1].astype(int), truth[after].astype(int)), 1)
            gap = (seen - expected) / len(batch) - decay * model.moves
            move_squares += gap * gap
            model.moves += 0.1 * gap / np.sqrt(move_squares)


def fit_score(rows: np.ndarray, labels: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Logistic weights for the summaries, drawn to the ones before, by damped Newton steps."""
    x = np.hstack([np.ones((len(rows), 1)), rows])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - labels * z).sum() + 0.25 * ((w - before) ** 2).sum())

    w = before.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - labels) + 0.5 * (w - before)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w


class Tagger:
    """Marginals of the words of texts; remembers the emissions of words within a task."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.emissions, self.stops = np.zeros(0), np.zeros(0, bool)

    def tag(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED:
            self._forget()
        number = self.number
        new = [w for w in set().union(*texts) if w not in number]
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new))))
            self.emissions = np.concatenate([self.emissions, self.model.emissions(new)])
            self.stops = np.concatenate([self.stops, [w.endswith(STOPS) for w in new]])
        rows = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]
        lengths = np.concatenate([chains(self.stops[row]) for row in rows])
        every = self.emissions[np.concatenate(rows)]
        chances, _ = marginals(every, lengths, self.model.start, self.model.moves)
        return np.split(chances, np.cumsum([len(row) for row in rows])[:-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Fits on a bounded sample of the labelled documents, see Settings.

    ``labels`` has the id and the label; a document with several labels is toxic if
    one says so. Null ids, labels and texts are left out. Without labels of both
    kinds the score is a fixed small one.
    """
    marked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("marked"))
        .agg((F.max(label_col) > 0).cast("int").alias("label"))
    )
    short = docs.where(F.length(text_col) <= settings.chars)
    order = F.xxhash64("marked")
    wanted = [
        marked.where(F.col("label") == label).orderBy(order, "marked").limit(bound)
        for label, bound in ((1, settings.toxic), (0, settings.clean))
    ]
    chosen = wanted[0].unionByName(wanted[1])  # bounded by the settings
    bound = settings.toxic + settings.clean
    rows = (
        short.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), F.col("id") == F.col("marked"))
        .orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
        .limit(bound)
        .select("text", "label")
        .collect()
    )
    return fit([r.text for r in rows], [r.label for r in rows], settings)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, score, spans): one row for each row of ``docs``.

    The score is between 0 and 1; null and empty texts have that of a text without
    a toxic word. Spans (start, end, chance) are the words with a marginal of one half
    or more, in code points, ends exclusive. Null ids and repeated rows are kept;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))
        for part, texts in text_batches(batches, "text", 256):
            chances = tagger.tag([t.encode().split() for t in texts])
            rows = np.array([summary(c) for c in chances])
            scores = 1 / (1 + np.exp(-np.clip(model.score[0] + rows @ model.score[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(scores), pa.array([spans(*x) for x in zip(texts, chances)], kind)],
                ["doc_id", "score", "spans"],
            )

    source = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(
        run, "doc_id long, score double, spans array<struct<start:long,end:long,chance:double>>"
    )


def spans(text: str, chances: np.ndarray) -> list[dict]:
    if not (chances >= 0.5).any():
        return []
    return [
        {"start": m.start(), "end": m.end(), "chance": c}
        for m, c in zip(WORD.finditer(text), chances.tolist())
        if c >= 0.5
    ]
