"""Tool calls of conversations: linked to their results, ordered, checked and written as JSON.

Calls and results are joined by conversation and identifier.  A result comes after its call,
and a call after the results of the calls it depends on; otherwise everything stays where it
was said.  Arguments are parsed as variants and checked against the schema of their tool.
Every event becomes one line of canonical JSON: keys in order, no white space.

All of it is DataFrame operations.  One conversation may hold most of the rows: nothing is
grouped by conversation alone, except sums over blocks of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.session import materialise

BLOCK_TURNS = 4_096
#: Field -> (kind, required); kinds are string, integer, number, boolean, object, array.
Schema = dict[str, tuple[str, bool]]

_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "object": "OBJECT<", "array": "ARRAY<"}
_CALL = ("conv_id", "turn", "call_id", "tool", "arguments", "depends")
_RESULT = ("conv_id", "turn", "call_id", "content")


def argument_faults(tool: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """What is wrong with the arguments of a call, as an array of texts; empty if nothing is."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    faults: list[Column] = [
        F.when(tool.isNull() | ~tool.isin(*schemas), F.lit("unknown tool")),
        F.when(value.isNull(), F.lit("not JSON")).when(~kind.startswith("OBJECT<"), F.lit("not an object")),
    ]
    is_object = value.isNotNull() & kind.startswith("OBJECT<")
    for name, schema in sorted(schemas.items()):
        here = (tool == name) & is_object
        for field, (wanted, required) in sorted(schema.items()):
            part = F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant"))
            right = part.startswith("DECIMAL") | part.isin("BIGINT", "DOUBLE", "FLOAT") if wanted == "number" \
                else part.startswith(_KINDS[wanted])
            absent = part.isNull() | (part == "VOID")
            faults.append(F.when(here & absent & F.lit(required), F.lit(f"missing {field}"))
                          .when(here & ~absent & ~right, F.lit(f"{field} is not {wanted}")))
        names = F.map_keys(F.from_json(arguments, "map<string,string>"))
        extra = F.array_sort(F.array_except(names, F.array(*map(F.lit, schema))))
        faults.append(F.when(here & (F.size(extra) > 0), F.concat(F.lit("unexpected "), F.array_join(extra, " "))))
    return F.array_compact(F.array(*faults))


def _firsts(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``first``: whether a row is the earliest with its conversation and identifier."""
    key = F.struct(*order)
    best = rows.groupBy("conv_id", "call_id").agg(F.min(key).alias("_best"))
    return rows.join(best, ["conv_id", "call_id"]).withColumn("first", key == F.col("_best")).drop("_best")


def order_keys(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, and ``at`` (turn, steps after it) of each call that can be ordered.

    In rounds: a call is placed once all it depends on are.  There are as many rounds as the
    longest chain of dependencies has calls; what is on or behind a circle is never placed.
    Dependencies on identifiers without a call do not count.
    """
    answered = results.select("conv_id", "call_id", F.col("turn").alias("answer"))
    nodes = calls.select("conv_id", "call_id", "turn", F.array_distinct(F.coalesce("depends", F.array().cast(
        "array<string>"))).alias("depends")).join(answered, ["conv_id", "call_id"], "left")
    nodes = materialise(nodes, "call-nodes")
    known = nodes.select("conv_id", F.col("call_id").alias("dep"))
    edges = nodes.select("conv_id", "call_id", F.explode("depends").alias("dep")).where("dep is not null").join(
        known, ["conv_id", "dep"])
    edges = materialise(edges, "call-edges")

    def after(at: Column) -> Column:
        """When the result of a call placed at ``at`` comes; the call itself if it has none."""
        own = F.struct(F.col("answer").alias("seq"), F.lit(0).alias("hop"))
        later = F.struct(at["seq"].alias("seq"), (at["hop"] + 1).alias("hop"))
        return F.when(F.col("answer").isNull(), at).otherwise(F.greatest(own, later))

    own = F.struct(F.col("turn").alias("seq"), F.lit(0).alias("hop"))
    free = nodes.join(edges.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
    placed = materialise(free.withColumn("at", own).withColumn("end", after(F.col("at"))).select(
        "conv_id", "call_id", "at", "end"), "call-order")
    waiting = edges
    while True:
        ends = placed.select("conv_id", F.col("call_id").alias("dep"), F.col("end").alias("dep_end"))
        ready = waiting.join(ends, ["conv_id", "dep"], "left").groupBy("conv_id", "call_id").agg(
            F.count(F.when(F.col("dep_end").isNull(), 1)).alias("open"), F.max("dep_end").alias("dep_end"))
        later = F.struct(F.col("dep_end")["seq"].alias("seq"), (F.col("dep_end")["hop"] + 1).alias("hop"))
        new = ready.where("open = 0").join(nodes, ["conv_id", "call_id"]).withColumn(
            "at", F.greatest(own, later)).withColumn("end", after(F.col("at")))
        new = materialise(new.select("conv_id", "call_id", "at", "end"), "call-order")
        if new.isEmpty():
            return placed.select("conv_id", "call_id", "at")
        placed = placed.unionByName(new)
        waiting = waiting.join(new.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row for each event: ``conv_id``, ``place`` in its conversation from 0 on, ``kind``,
    ``call_id``, ``turn``, ``status``, ``faults`` and ``message`` (canonical JSON).

    ``calls`` has ``conv_id, turn, call_id, tool, arguments`` (JSON text) and ``depends``
    (identifiers), ``results`` has ``conv_id, turn, call_id, content``.  Rows that are equal in
    these columns count once; other columns are not read.  A status is one of

    - ``ok``; ``invalid``: the arguments have faults (see ``faults``)
    - ``unanswered``: a call without a result; ``orphan``: a result without a call
    - ``repeated``: not the first call or result with its identifier
    - ``circular``: the call depends on itself by way of others, or on such a call
    - ``unnamed``: no conversation, identifier or turn

    Unplaced events stand at their own turn.  Null arguments are not JSON; null content is
    left out of the message.
    """
    calls = calls.select(F.col("conv_id"), F.col("turn").cast("long"), F.col("call_id").cast("string"),
                         F.col("tool").cast("string"), F.col("arguments").cast("string"),
                         F.col("depends").cast("array<string>")).distinct()
    results = results.select(F.col("conv_id"), F.col("turn").cast("long"), F.col("call_id").cast("string"),
                             F.col("content").cast("string")).distinct()
    calls, results = materialise(calls, "calls"), materialise(results, "results")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & F.col("turn").isNotNull()
    call = _firsts(calls.where(named), ["turn", "tool", "arguments", "depends"])
    result = _firsts(results.where(named), ["turn", "content"])
    call, result = materialise(call, "named-calls"), materialise(result, "named-results")
    one, answer = call.where("first"), result.where("first")
    keys = order_keys(one, answer)

    own = F.struct(F.col("turn").alias("seq"), F.lit(0).alias("hop"))
    ids = ["conv_id", "call_id"]
    linked = one.join(answer.select(*ids, F.lit(True).alias("answered")), ids, "left").join(keys, ids, "left")
    linked = linked.withColumn("faults", argument_faults(F.col("tool"), F.col("arguments"), schemas))
    status = (
        F.when(F.col("at").isNull(), "circular").when(F.size("faults") > 0, "invalid")
        .when(F.col("answered").isNull(), "unanswered").otherwise("ok")
    )
    none = F.array().cast("array<string>")
    said = _call_message()
    events = linked.select("conv_id", F.coalesce("at", own).alias("at"), F.lit("call").alias("kind"), "call_id",
                           "turn", status.alias("status"), "faults", said.alias("message"))

    spot = keys.select(*ids, F.col("at").alias("call_at"))
    back = answer.join(one.select(*ids, F.lit(True).alias("called")), ids, "left").join(spot, ids, "left")
    later = F.struct(F.col("call_at")["seq"].alias("seq"), (F.col("call_at")["hop"] + 1).alias("hop"))
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("call_at").isNull(), "circular").otherwise("ok")
    events = events.unionByName(back.select(
        "conv_id", F.when(F.col("call_at").isNull(), own).otherwise(F.greatest(own, later)).alias("at"),
        F.lit("result").alias("kind"), "call_id", "turn", status.alias("status"), none.alias("faults"),
        _result_message().alias("message")))

    for rows, kind, message in ((call, "call", _call_message()), (result, "result", _result_message())):
        events = events.unionByName(rows.where(~F.col("first")).select(
            "conv_id", own.alias("at"), F.lit(kind).alias("kind"), "call_id", "turn",
            F.lit("repeated").alias("status"), none.alias("faults"), message.alias("message")))
    for rows, kind, message in ((calls, "call", _call_message()), (results, "result", _result_message())):
        events = events.unionByName(rows.where(~named).select(
            "conv_id", own.alias("at"), F.lit(kind).alias("kind"), "call_id", "turn",
            F.lit("unnamed").alias("status"), none.alias("faults"), message.alias("message")))
    return _numbered(events)


def _call_message() -> Column:
    value = F.try_parse_json("arguments")
    return F.to_json(F.struct(
        value.alias("arguments"), "call_id", F.lit("call").alias("kind"),
        F.when(value.isNull(), F.col("arguments")).alias("raw_arguments"), "tool"))


def _result_message() -> Column:
    return F.to_json(F.struct("call_id", "content", F.lit("result").alias("kind")))


def _numbered(events: DataFrame) -> DataFrame:
    """Places within each conversation: sums over blocks of turns, and numbers within a block."""
    events = materialise(events.withColumn("block", F.floor(F.col("at")["seq"] / BLOCK_TURNS)), "events")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    blocks = blocks.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "block").orderBy("at", "kind", "call_id", "turn", "message")
    numbered = events.withColumn("nth", F.row_number().over(inside))
    same = numbered["conv_id"].eqNullSafe(blocks["_conv"]) & numbered["block"].eqNullSafe(blocks["_block"])
    return numbered.join(blocks, same).select(
        "conv_id", (F.col("base") + F.col("nth") - 1).alias("place"), "kind", "call_id", "turn", "status", "faults",
        "message")
