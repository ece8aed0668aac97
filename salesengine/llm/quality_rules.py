"""Quality rules as a short-circuit cascade.

A document is rejected as soon as one rule rejects it, so the order of the rules
decides only the time. A task asks the rules by rejections per second, the best first,
and takes the time and the rejections of every rule it asks, of all its documents; the
order is made anew from these counts again and again. On its first documents it asks
all rules, so that each has been counted. What a rule needs of a text (words, lines,
windows) is worked out when it is first asked for and shared with the rules behind it.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesengine.llm.common import in_small_batches, text_batches

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = b" \t\n\v\f\r"
WINDOW = 3


class Text:
    """A text and what rules ask about it. Words are split at ASCII white space."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def data(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words."""
        return len(self.text) - sum(self.data.count(space) for space in SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(symbol) for symbol in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines that hold a word."""
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        """Lines equal to an earlier one."""
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that occur twice or more in the text."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        count = Counter(windows)
        repeated = bytearray(len(words))
        for i, window in enumerate(windows):
            if count[window] > 1:
                repeated[i : i + WINDOW] = b"\1" * WINDOW
        return sum(repeated)

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the one before."""
        return sum(a == b for a, b in zip(self.words, self.words[1:]))

    @cached_property
    def n_shouted(self) -> int:
        """Words of several letters, all of them capitals."""
        return sum(len(w) > 2 and w.isupper() for w in self.words)

    @cached_property
    def n_marked(self) -> int:
        """Words that end in two or more signs of exclamation or question."""
        return sum(w.endswith((b"!!", b"??", b"!?", b"?!")) for w in self.words)

    @cached_property
    def n_plain(self) -> int:
        """Words with a letter, ASCII or not."""
        return sum(w.lower() != w.upper() or not w.isascii() for w in self.words)

    @cached_property
    def longest_word(self) -> int:
        return max(map(len, self.words), default=0)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: Limits in the manner of published web-text filters; shares are of the words or lines.
RULES = (
    Rule("symbols", lambda t: t.n_symbols > 0.1 * t.n_words),
    Rule("repeated_lines", lambda t: t.n_dup_lines > 0.5 * len(t.lines)),
    Rule("repeated_windows", lambda t: t.n_repeat_words > 0.45 * t.n_words),
    Rule("stutters", lambda t: t.n_stutters > 0.2 * t.n_words),
    Rule("shouting", lambda t: t.n_shouted > 0.5 * t.n_words),
    Rule("marks", lambda t: t.n_marked > 0.3 * t.n_words),
    Rule("few_letters", lambda t: t.n_plain < 0.7 * t.n_words),
    Rule("word_length", lambda t: not 2.5 * t.n_words <= t.word_chars <= 12 * t.n_words),
    Rule("long_word", lambda t: t.longest_word > 1000),
)


#: What every text that is kept must pass before the rules.
BASE = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("half_repeated", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
)


def base_failed(t: Text) -> bool:
    return any(rule.rejects(t) for rule in BASE)


class Cascade:
    """Asks the rules in their order of rejections per second, counted over all documents it is given.

    The order is made anew after every ``every`` documents; the first as many are asked of
    all rules.
    """

    def __init__(self, rules: Sequence[Rule], every: int):
        self.rules, self.every, self.met = list(rules), every, 0
        self.spent = dict.fromkeys(self.rules, 0.0)
        self.rejected = dict.fromkeys(self.rules, 1)  # a rule that has not rejected yet may still

    def rejects(self, t: Text) -> bool:
        whole, rules = self.met < self.every, self.rules
        if whole and rules:
            # every rule begins in turn, so that what several need is charged to each of them
            # as often as it is the first to ask; what is known of the text already is free
            first = self.met % len(rules)
            rules = rules[first:] + rules[:first]
        any_rejects = False
        for rule in rules:
            began = time.perf_counter()
            no = rule.rejects(t)
            self.spent[rule] += time.perf_counter() - began
            self.rejected[rule] += no
            any_rejects |= no
            if no and not whole:
                break
        self.met += 1
        if self.every and not self.met % self.every:
            self.rules.sort(key=lambda r: self.spent[r] / self.rejected[r])
        return any_rejects


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    every: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: its id, base measures, base_failed and kept.

    A null text has no word and, like an empty one, fails the base. Null ids and
    repeated rows are kept as they are; other columns are not read. ``every`` is
    the number of documents after which a task orders the rules anew; the result
    is the same for any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade(rules, every)
        for part, texts in text_batches(batches, "text"):
            rows = []
            for text in texts:
                t = Text(text)
                failed = base_failed(t)
                kept = not failed and not cascade.rejects(t)
                rows.append(
                    (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept)
                )
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], NAMES)

    source = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, SCHEMA)


NAMES = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
SCHEMA = ", ".join(
    f"{name} {'boolean' if name in ('base_failed', 'kept') else 'long'}" for name in NAMES
)


def keep(
    docs: DataFrame, rules: Sequence[Rule] = RULES, every: int = 64, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that pass the base and all rules, with all their columns.

    The base is asked like the rules, so its measures are only taken of texts that no
    better rule has rejected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade([*BASE, *rules], every)
        for part, texts in text_batches(batches, text_col):
            yield part.filter(pa.array([not cascade.rejects(Text(text)) for text in texts], pa.bool_()))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
