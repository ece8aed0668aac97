"""Chat formatting: tool calls and their results are linked, ordered, validated and serialised.

Events are rows of a conversation: messages, calls and results. A result names its
call, a call may name the call whose result it follows. Links are hash joins on the
conversation and the identifier, so a conversation of any length is spread over all
tasks. Every event follows at most one other, so its level, the number of events it
has to wait for, is found by doubling pointers, in as many rounds as the logarithm of
the longest chain. In order of level and turn no event comes before one it follows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesengine.llm.common import stored

COLUMNS = "conv_id turn kind role call_id name arguments follows content".split()


@dataclass(frozen=True)
class Parameter:
    """Of a call: its JSON type, whether it must be there, and bounds of numbers or allowed texts."""

    type: str
    required: bool = True
    minimum: float | None = None
    maximum: float | None = None
    allowed: tuple[str, ...] = ()

    def fits(self, arguments: Column, name: str) -> Column:
        path = f"$['{name}']"
        kind = F.schema_of_variant(F.variant_get(arguments, path, "variant"))
        right = {
            "string": kind == "STRING",
            "integer": kind == "BIGINT",
            "number": kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"),
            "boolean": kind == "BOOLEAN",
            "array": kind.startswith("ARRAY"),
            "object": kind.startswith("OBJECT"),
        }[self.type]
        if self.minimum is not None:
            right = right & (F.try_variant_get(arguments, path, "double") >= self.minimum)
        if self.maximum is not None:
            right = right & (F.try_variant_get(arguments, path, "double") <= self.maximum)
        if self.allowed:
            right = right & F.try_variant_get(arguments, path, "string").isin(*self.allowed)
        missing = F.variant_get(arguments, path, "variant").isNull()
        return F.when(missing, F.lit(not self.required)).otherwise(F.coalesce(right, F.lit(False)))


Schemas = Mapping[str, Mapping[str, Parameter]]


def validity(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments, a JSON text, are an object that fits the schema of the name.

    Unknown names, texts that are no JSON, and parameters the schema lacks do not fit.
    """
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    out = F.lit(False)
    for known, parameters in schemas.items():
        fits = is_object
        keys = F.json_object_keys(arguments)
        fits = fits & F.coalesce(
            F.size(F.array_except(keys, F.array(*[F.lit(p) for p in parameters]))) == 0, F.lit(False)
        )
        for parameter, rule in parameters.items():
            fits = fits & rule.fits(parsed, parameter)
        out = F.when(name == known, fits).otherwise(out)
    return out


def levels(nodes: DataFrame) -> DataFrame:
    """(node, level) of distinct nodes (node, parent): steps to the first one, null on a cycle.

    A parent that is no node counts as none.
    """
    known = nodes.select(F.col("node").alias("known"))
    current = stored(
        nodes.join(known, F.col("parent") == F.col("known"), "left").select(
            "node", F.col("known").alias("parent"), F.col("known").isNotNull().cast("long").alias("level")
        )
    )
    total = current.count()
    reach = 1
    while reach <= 2 * max(total, 1):
        if not current.where("parent IS NOT NULL").limit(1).count():
            break
        ahead = current.select(
            F.col("node").alias("at"), F.col("parent").alias("next"), F.col("level").alias("more")
        )
        # nodes whose first one is found rest; only the others look ahead
        moved = current.join(ahead, F.col("parent") == F.col("at")).select(
            "node", F.col("next").alias("parent"), (F.col("level") + F.col("more")).alias("level")
        )
        current = stored(current.where("parent IS NULL").unionByName(moved))
        reach *= 2
    return current.select("node", F.when(F.col("parent").isNull(), F.col("level")).alias("level"))


def _node(kind: str, call_id: Column) -> Column:
    """Kind, conversation and identifier, each on its own; null if a part of them is null."""
    whole = F.struct(F.lit(kind).alias("kind"), F.col("conv_id").alias("conv_id"), call_id.alias("call_id"))
    return F.when(F.col("conv_id").isNotNull() & call_id.isNotNull(), whole)


def link(events: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each event: (conv_id, turn, kind, call_id, linked, valid, level, json).

    ``events`` has COLUMNS; kinds are message, call and result, others count as
    messages. ``linked``: a result whose call is there, a call that has a result.
    ``valid``: a call whose arguments fit its schema; null for others. Events on a
    cycle have no level. Repeated identifiers share their links and take the smallest
    of the calls they follow; rows without a conversation or identifier are linked to
    nothing and have level 0. All rows are kept. ``json`` has its keys sorted, no
    blanks, and no nulls; arguments that are no JSON are left out.
    """
    rows = events.select(*COLUMNS).withColumn(
        "node",
        F.when(F.col("kind") == "call", _node("call", F.col("call_id"))).when(
            F.col("kind") == "result", _node("result", F.col("call_id"))
        ),
    )
    before = F.when(F.col("kind") == "call", _node("result", F.col("follows"))).when(
        F.col("kind") == "result", _node("call", F.col("call_id"))
    )
    nodes = stored(
        rows.where("node IS NOT NULL").select("node", before.alias("parent")).groupBy("node").agg(F.min("parent").alias("parent"))
    )
    other = F.when(F.col("kind") == "call", _node("result", F.col("call_id"))).when(
        F.col("kind") == "result", _node("call", F.col("call_id"))
    )
    partners = nodes.select(F.col("node").alias("partner"))
    depth = levels(nodes).select(F.col("node").alias("placed"), "level")
    linked = (
        rows.withColumn("other", other)
        .join(partners.hint("shuffle_hash"), F.col("other") == F.col("partner"), "left")
        .join(depth, F.col("node") == F.col("placed"), "left")
    )
    call = F.struct(
        F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name"
    )
    json = (
        F.when(F.col("kind") == "call", F.to_json(F.struct("role", call.alias("tool_call"))))
        .when(F.col("kind") == "result", F.to_json(F.struct("content", F.col("call_id").alias("id"), "role")))
        .otherwise(F.to_json(F.struct("content", "role")))
    )
    return linked.select(
        "conv_id",
        "turn",
        "kind",
        "call_id",
        F.col("partner").isNotNull().alias("linked"),
        F.when(F.col("kind") == "call", validity(F.col("name"), F.col("arguments"), schemas)).alias("valid"),
        F.when(F.col("node").isNull(), F.lit(0).cast("long")).otherwise(F.col("level")).alias("level"),
        json.alias("json"),
    )
