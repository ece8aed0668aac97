"""Conversation structure repair by a suffix-shared automaton of signatures.

Each turn of a conversation becomes a letter for its role and its fault; the letters in
order are the signature. What the rest of a conversation costs depends on the letters
that are left and on the roles before them, which one of four grammar states sums up.
Signatures are minimised from the end: they are sorted by their reverse, so that those
with a common suffix follow each other and share its nodes, and nodes with the same best
edits and the same costs-to-go, but for a constant, are one. A node's costs and best
edits are worked out once for every grammar state; the audit of a signature is read off
its nodes, and every conversation with that signature takes it.

Signatures and audits hold a letter for each turn. Turns are only ever streamed in the
order of their conversation, so a task holds one signature and one audit, never texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesengine.llm.common import in_small_batches, slices, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Grammar states: nothing yet, after the system's turn, the user's, the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a kept initial leads to, by state; others are against the grammar.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that the grammar asks for in a state, and the state after it.
ASKED = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
FINAL = (START, ASSISTANT)
#: Letters of a signature: an initial, or one of no known role, in upper case if
#: truncated; and one for a turn that must be deleted.
OTHER, GONE = "o", "d"
NEVER = 1 << 60
FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


#: Of a node, by grammar state: its cost-to-go less the least of them, and its best first edit.
Node = tuple[tuple[int, ...], str]


class Automaton:
    """Nodes from the end of signatures, each worked out once, and the path of the last signature."""

    def __init__(self, costs: Costs = Costs()):
        self.costs = costs
        self.nodes: list[Node] = []
        self.numbers: dict[Node, int] = {}
        self.arcs: dict[tuple[int, str], int] = {}
        end = [(0, "") if state in FINAL else (NEVER, "") for state in range(4)]
        self.path = array("L", [self._number(end)])
        self.last = ""

    def _number(self, options: list[tuple[int, str]]) -> int:
        """The node of these costs and edits, after insertions; ties go to the smaller letter."""
        options = list(options)
        for _ in options:
            for state, (_, after) in enumerate(ASKED):
                options[state] = min(options[state], (options[after][0] + self.costs.insert, INSERT))
        least = min(cost for cost, _ in options)
        node = tuple(cost - least for cost, _ in options), "".join(e or "." for _, e in options)
        if node not in self.numbers:
            self.numbers[node] = len(self.nodes)
            self.nodes.append(node)
        return self.numbers[node]

    def _before(self, number: int, letter: str) -> int:
        """The node one letter further from the end."""
        known = self.arcs.get((number, letter))
        if known is not None:
            return known
        rest, _ = self.nodes[number]
        options = []
        for state in range(4):
            ways = [(rest[state] + self.costs.delete, DELETE)]
            if letter != GONE:
                left = self.costs.truncated if letter.isupper() else 0
                ways.append((rest[ASKED[state][1]] + self.costs.rerole + left, REROLE))
                kept = NEXT[state].get(letter.lower())
                if kept is not None:
                    ways.append((rest[kept] + left, KEEP))
            options.append(min(ways))
        return self.arcs.setdefault((number, letter), self._number(options))

    def audit(self, signature: str) -> tuple[int, str]:
        """Cost and edits of the cheapest repair; of equal ones the ASCII-least edits."""
        backwards = signature[::-1]
        shared = 0
        for a, b in zip(self.last, backwards):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :]
        for letter in backwards[shared:]:
            self.path.append(self._before(self.path[-1], letter))
        self.last = backwards
        state, at, cost = START, len(signature), 0
        edits = bytearray()
        while True:
            edit = self.nodes[self.path[at]][1][state]
            if edit == ".":
                return cost, edits.decode()
            edits += edit.encode()
            if edit == INSERT:
                cost, state = cost + self.costs.insert, ASKED[state][1]
                continue
            at -= 1
            letter = backwards[at]
            if edit == DELETE:
                cost += self.costs.delete
                continue
            cost += self.costs.truncated if letter.isupper() else 0
            if edit == REROLE:
                cost, state = cost + self.costs.rerole, ASKED[state][1]
            else:
                state = NEXT[state][letter.lower()]


def audits(signatures: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(signature, cost, audit) of distinct signatures, dealt and sorted by their reverse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(costs)
        for part in slices(batches, 1_024):
            given = part.column(0).to_pylist()
            found = [automaton.audit(s) for s in given]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
                ["signature", "cost", "audit"],
            )

    backwards = F.reverse("signature")
    dealt = signatures.select("signature").distinct().repartitionByRange(backwards)
    return dealt.sortWithinPartitions(backwards).mapInArrow(run, "signature string, cost long, audit string")


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, tie): nulls of role and text are one space; see ``repair``."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn(
        "tie", F.md5("text")
    )


def summaries(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, signature) of every conversation.

    Texts stay where they are read: what is dealt by conversation is a digest and two
    facts of each.
    """
    solid = "[^ \\t-\\r]"
    narrow = in_order(turns).select(
        "conv_id",
        "turn",
        "role",
        "tie",
        (~F.col("text").rlike(solid)).alias("blank"),
        (~F.col("text").rlike("[.!?][ \\t-\\r]*\\z")).alias("truncated"),
    )
    earlier = W.partitionBy("conv_id", "role", "tie").orderBy(F.asc_nulls_first("turn"))
    # dealt by conversation once: the window's rows of one text lie within it
    marked = narrow.repartition("conv_id").withColumn("again", F.row_number().over(earlier) > 1)
    ordered = marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "tie", "again").select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "again", "truncated"
    )
    kind = turns.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, {', '.join(f'{f} long' for f in FAULTS)}, signature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(ids: list, found: list[Summary]) -> pa.RecordBatch:
            columns = [pa.array(ids, id_type)]
            columns += [pa.array([s.count(f) for s in found], pa.int64()) for f in FAULTS]
            columns.append(pa.array([s.signature.decode() for s in found], pa.string()))
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *FAULTS, "signature"])

        ids, done, current, id_type = [], [], None, None
        for batch in batches:
            id_type = batch.column(0).type
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or conv != ids[-1]:
                    if len(done) >= 1_024:
                        yield summed(ids, done)
                        ids, done = [], []
                    current = Summary()
                    ids.append(conv)
                    done.append(current)
                current.add(*row)
        if done:
            yield summed(ids, done)

    return ordered.mapInArrow(run, schema)


class Summary:
    """Faults of one conversation and its signature, turn by turn."""

    def __init__(self):
        self.least = self.most = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.signature = bytearray()
        self.initial: str | None = None

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, truncated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.least = turn if self.least is None else self.least
            self.most = self.turn = turn
            self.turns += 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        letter = initial if initial in ("s", "u", "a") else OTHER
        if blank:
            self.blank += 1
            letter = GONE
        elif again:
            self.duplicate += 1
            letter = GONE
        elif truncated:
            self.truncated += 1
            letter = letter.upper()
        self.signature += letter.encode()

    def count(self, fault: str) -> int:
        if fault == "gaps":
            return 0 if self.least is None else self.most - self.least + 1 - self.turns
        return getattr(self, fault)


def repaired(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns left and added, clustered and in order.

    ``conversations`` has the audit of every conv_id of ``turns``. It is sent ahead of
    its turns, which are read once and in order; a position is a turn's place among
    those left.
    """
    none = F.lit(None).cast("string")
    ahead = conversations.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), none.alias("role"),
        F.col("audit").alias("text"), none.alias("tie"),
    )
    rows = in_order(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "tie")
    dealt = in_small_batches(ahead.unionByName(rows)).repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "tie")
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, at, state, place, conv = "", 0, START, 0, None
        out: list[tuple] = []

        def insertions() -> Iterator[tuple]:
            nonlocal at, state, place
            while edits[at : at + 1] == INSERT:
                role, state = ASKED[state]
                yield conv, place, INSERT, role, ""
                at, place = at + 1, place + 1

        def packed(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*out))
            kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "position", "edit", "role", "text"]
            )

        kind = None
        for batch in chain(batches, [None]):
            if batch is None:
                out += insertions()
            else:
                kind = batch.column("conv_id").type
                for this, ahead_or_turn, role, text in zip(
                    *(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))
                ):
                    if ahead_or_turn == 0:
                        out += insertions()
                        edits, at, state, place, conv = text, 0, START, 0, this
                        continue
                    out += insertions()
                    edit, at = edits[at], at + 1
                    if edit == DELETE:
                        continue
                    if edit == REROLE:
                        role, state = ASKED[state]
                    else:
                        state = NEXT[state][role[:1]]
                    out.append((conv, place, edit, role, text))
                    place += 1
            if out:
                yield packed(kind)
                out = []

    return ordered.select("conv_id", "kind", "role", "text").mapInArrow(
        run, f"conv_id {id_type}, position long, edit string, role string, text string"
    )


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) over ``role:text`` of turns joined by line ends, for turns as ``repaired`` gives them."""
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pair(conv: object, kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], kind), pa.array([digest.hexdigest()])], ["conv_id", "sha256"]
            )

        digest, current, kind = None, None, None
        for batch in batches:
            kind = batch.column("conv_id").type
            names = ("conv_id", "position", "role", "text")
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in names)):
                if place == 0:
                    if digest is not None:
                        yield pair(current, kind)
                    digest, current = hashlib.sha256(), conv
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield pair(current, kind)

    return turns.select("conv_id", "position", "role", "text").mapInArrow(run, f"conv_id {id_type}, sha256 string")


def repair(turns: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its faults and edits, and the repaired turns.

    ``turns`` has conv_id, turn, role and text; other columns are not read. Turns are
    taken by number, null numbers first; of equal numbers by role, then by the MD5 of the
    text, so repeated rows stand side by side. A null role or text is one space; turns
    with a null conv_id are one conversation. A turn is blank without a character other
    than ASCII white space, a duplicate if role and text stood before, and truncated if
    its last such character is none of ``.!?``; the first of these counts. An empty role
    has no initial and cannot be kept.

    The first result has a row for each conversation (conv_id, gaps, blank, duplicate,
    truncated, illegal, signature, cost, audit), the second is that of ``repaired``. Both
    are empty for no turns. A conversation's hash is one sequence of bytes, so its turns
    pass through one task, as a sorted stream.
    """
    found = stored(summaries(turns))
    edits = stored(audits(found, costs))
    # a signature that many conversations have is split by Spark on their side
    judged = stored(found.join(edits, "signature").select("conv_id", *FAULTS, "signature", "cost", "audit"))
    return judged, repaired(turns, judged)

