"""Quality classifier from weak labels.

Heuristic labellers vote on every text: good, bad, or nothing. How often each
combination of votes occurs in the whole corpus is counted; expectation-maximisation
on these counts estimates the shares of good texts and of several kinds of bad ones, how
often each labeller says what of each, and so the chance that a text with given votes is
good.
These posteriors are the soft labels on which a linear scorer is trained, whose
features are hashed words, their shapes and their repetition; it scores every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.llm.common import in_small_batches, stored, text_batches
from salesengine.llm.quality_rules import Text

BUCKETS = 1 << 16
#: Words a task remembers before it starts anew.
REMEMBERED = 400_000
#: Words without weight that every text has besides its own, so that a short one shows little.
PADDING = 10
#: Scores from here on are kept: rejecting a good text is the worse mistake.
KEPT = 0.3
#: Texts with fewer words are too short for shares to tell anything.
SHORT = 20


@dataclass(frozen=True)
class Labeller:
    """Votes bad at or above one bound of a measure, good at or below another, else nothing."""

    name: str
    measure: Callable[[Text], float]
    good: float
    bad: float

    def vote(self, t: Text) -> str:
        if t.n_words < SHORT:
            return "0"
        value = self.measure(t)
        return "-" if value >= self.bad else "+" if value <= self.good else "0"


def _share(count: Callable[[Text], int]) -> Callable[[Text], float]:
    return lambda t: count(t) / t.n_words


LABELLERS = (
    Labeller("symbols", _share(lambda t: t.n_symbols), 0.02, 0.1),
    Labeller("windows", _share(lambda t: t.n_repeat_words), 0.2, 0.5),
    Labeller("stutters", _share(lambda t: t.n_stutters), 0.05, 0.2),
    Labeller("shouting", _share(lambda t: t.n_shouted), 0.1, 0.5),
    Labeller("marks", _share(lambda t: t.n_marked), 0.02, 0.3),
    Labeller("lines", lambda t: t.n_dup_lines / max(1, len(t.lines)), 0.1, 0.5),
    Labeller("letters", _share(lambda t: t.n_words - t.n_plain), 0.05, 0.3),
    Labeller("variety", lambda t: 1 - len(set(t.words)) / t.n_words**0.8, 0.4, 0.9),
)
#: Good texts, called bad and not, that each labeller is taken to have seen before.
FALSE_ALARMS = (0.2, 99.8)


def votes(t: Text, labellers: Sequence[Labeller] = LABELLERS) -> str:
    return "".join(labeller.vote(t) for labeller in labellers)


@dataclass
class Labels:
    """What the votes say: the share of each class, and how often its labellers say bad and good.

    Class 0 is good text; the others are kinds of bad text. ``rates`` is by class, labeller
    and vote, and sums to one over the two votes.
    """

    share: np.ndarray
    rates: np.ndarray

    def good(self, pattern: str) -> float:
        """The chance to be good for votes that need not have been seen before.

        A labeller that did not vote says nothing; without a vote it is the share of good texts.
        """
        odds = np.log(self.share)
        for labeller, vote in enumerate(pattern):
            if vote != "0":
                odds = odds + np.log(self.rates[:, labeller, 0 if vote == "-" else 1])
        chance = np.exp(odds - odds.max())
        return float(chance[0] / chance.sum())


def estimate(counts: Mapping[str, int], labellers: int = len(LABELLERS), rounds: int = 500) -> Labels:
    """Expectation-maximisation on how often each combination of votes occurs.

    Votes are independent within a class. One class is good text, and there is a kind of
    bad text for each labeller, as kinds are many and a labeller knows one or two of them;
    it begins with the texts that its labeller calls bad, and what no labeller calls bad
    begins as good. All shares and all rates, false alarms among them, are estimated. Where
    a labeller is alone with its bad votes, the counts cannot tell false alarms from a kind
    of its own; FALSE_ALARMS, a fixed number of good texts of which few are called bad, says
    so then, and weighs less and less as the corpus grows.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    votes_of = np.array([list(p) for p in patterns]).reshape(len(patterns), labellers)
    voted = np.stack([votes_of == "-", votes_of == "+"], axis=2).astype(float)
    bad = voted[:, :, 0]
    said = bad.sum(axis=1, keepdims=True)
    begin = np.where(said > 0, 0.9 * bad / np.maximum(said, 1), 0.1 / labellers)
    belief = np.concatenate([np.where(said > 0, 0.1, 0.9), begin], axis=1)
    pseudo = np.full((1 + labellers, labellers, 2), 0.5)
    pseudo[0] = FALSE_ALARMS
    while True:
        share = n @ belief + 0.5
        seen = np.einsum("p,pc,plv->clv", n, belief, voted) + pseudo
        found = Labels(share / share.sum(), seen / seen.sum(axis=2, keepdims=True))
        rounds -= 1
        odds = np.log(found.share) + np.einsum("plv,clv->pc", voted, np.log(found.rates))
        chance = np.exp(odds - odds.max(axis=1, keepdims=True))
        chance /= chance.sum(axis=1, keepdims=True)
        if rounds < 1 or not len(patterns) or np.abs(chance - belief).max() < 1e-7:
            return found
        belief = chance


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample the scorer is trained on: texts of each kind, and their length."""

    sample: int = 2_500
    chars: int = 10_000
    epochs: int = 10
    scale: float = 8.0
    seed: int = 3



def shape(word: bytes) -> bytes:
    """Letters as a or A, digits as 9, runs as one, other characters as they are."""
    out = bytearray()
    for byte in word[:64]:
        c = 97 if 97 <= byte <= 122 or byte >= 128 else 65 if 65 <= byte <= 90 else 57 if 48 <= byte <= 57 else byte
        if not out or out[-1] != c:
            out.append(c)
    return bytes(out)


def buckets(word: bytes) -> tuple[int, int]:
    """Of the word in lower case and of its shape."""
    return 1 + zlib.crc32(word.lower()) % (BUCKETS - 1), 1 + zlib.crc32(b"s" + shape(word)) % (BUCKETS - 1)


@dataclass
class Model:
    """Weights of hashed features, of the share of words like the one before, and a constant."""

    weights: np.ndarray
    stutter: float
    constant: float
    scale: float


def repeated(words: list[bytes]) -> float:
    return sum(a == b for a, b in zip(words, words[1:])) / len(words) if words else 0.0


def fit(texts: list[str], labels: np.ndarray, settings: Settings) -> Model:
    """Logistic weights for soft labels; without both kinds of text every score is one half."""
    model = Model(np.zeros(BUCKETS), 0.0, 0.0, settings.scale)
    if not len(texts) or not labels.min() < 0.5 <= labels.max():
        return model
    split = [t.encode().split() for t in texts]
    known: dict[bytes, tuple[int, int]] = {}
    rows = []
    for words in split:
        for w in words:
            if w not in known:
                known[w] = buckets(w)
        found, count = np.unique([b for w in words for b in known[w]] or [0], return_counts=True)
        rows.append((found, count * settings.scale / (PADDING + len(words))))
    stutter = np.array([repeated(words) for words in split]) * settings.scale
    balance = np.where(labels >= 0.5, 0.5 / (labels >= 0.5).mean(), 0.5 / (labels < 0.5).mean())
    rng, order = np.random.default_rng(settings.seed), np.arange(len(rows))
    squares, other = np.full(BUCKETS, 1e-2), np.full(2, 1e-2)
    for _ in range(settings.epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            found = np.concatenate([rows[i][0] for i in batch])
            value = np.concatenate([rows[i][1] for i in batch])
            z = np.bincount(owner, model.weights[found] * value, len(batch))
            z += model.stutter * stutter[batch] + model.constant
            error = (labels[batch] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * balance[batch] / len(batch)
            slope = np.bincount(found, value * error[owner], BUCKETS) - 1e-5 * model.weights
            slope[0] = 0
            squares += slope * slope
            model.weights += 0.3 * slope / np.sqrt(squares)
            slopes = np.array([(stutter[batch] * error).sum(), error.sum()])
            other += slopes * slopes
            moves = 0.3 * slopes / np.sqrt(other)
            model.stutter, model.constant = model.stutter + moves[0], model.constant + moves[1]
    return model


class Scorer:
    """Scores of texts; remembers what words weigh within a task."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[bytes, float] = {}

    def score(self, words: list[bytes]) -> float:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, weights = self.known, self.model.weights
        for word in set(words):
            if word not in known:
                a, b = buckets(word)
                known[word] = float(weights[a] + weights[b])
        total = sum(map(known.__getitem__, words)) / (PADDING + len(words))
        z = self.model.scale * (total + self.model.stutter * repeated(words)) + self.model.constant
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def voted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, votes) of every row; a null text gets no votes, like one too short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            found = pa.array([votes(Text(t)) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), found], ["doc_id", "votes"])

    source = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, votes string")


def train(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> tuple[Model, Labels]:
    """The scorer, and what was estimated of the labellers.

    All texts vote. The scorer is fitted on a bounded sample, see Settings: of good
    and of bad texts those with the smallest hashes of their ids; without an id a text
    is not in it.
    """
    every = stored(voted(docs, id_col, text_col))
    # at most three to the power of the number of labellers
    counts = {r.votes: r["count"] for r in every.groupBy("votes").count().collect()}
    labels = estimate(counts)
    good = [p for p in counts if labels.good(p) >= 0.5]
    order = F.xxhash64("doc_id")
    known = every.where("doc_id IS NOT NULL")
    chosen = [
        known.where(kind).orderBy(order, "doc_id").limit(settings.sample)
        for kind in (F.col("votes").isin(good), ~F.col("votes").isin(good))
    ]
    marked = chosen[0].unionByName(chosen[1]).groupBy(F.col("doc_id").alias("id")).agg(F.min("votes").alias("votes"))
    rows = (
        docs.where(F.length(text_col) <= settings.chars)
        .select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(marked), F.col("doc_id") == F.col("id"))  # two samples at most
        .orderBy(order, "doc_id", F.xxhash64("text"))
        .limit(2 * settings.sample)
        .select("text", "votes")
        .collect()
    )
    return fit([r.text for r in rows], np.array([labels.good(r.votes) for r in rows]), settings), labels


def score(
    docs: DataFrame,
    model: Model,
    labels: Labels,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, votes, posterior, score, kept): one row for each row of ``docs``.

    ``kept``: the scorer gives KEPT or more. Votes that no text of the training table had
    get their posterior from the rates like others. Null and empty texts have no votes
    and the score of a text without words. Null ids and repeated rows are kept; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        chance = cache(labels.good)
        for part, texts in text_batches(batches, "text"):
            said, scores = [], []
            for text in texts:
                t = Text(text)
                said.append(votes(t))
                scores.append(scorer.score(t.words))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(said, pa.string()),
                    pa.array([chance(v) for v in said], pa.float64()),
                    pa.array(scores, pa.float64()),
                    pa.array([s >= KEPT for s in scores], pa.bool_()),
                ],
                ["doc_id", "votes", "posterior", "score", "kept"],
            )

    source = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, votes string, posterior double, score double, kept boolean")
