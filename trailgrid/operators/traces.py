"""Traces of agents: messages to actions, queries with their answers, alignment, errors, histories.

Messages are rows (trace, pos, role, content, calls array<struct<name, arguments>>). All windows are
over one trace, which is one agent's run and small; traces are never brought together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import strip


def succeeded(content: Column) -> Column:
    """Whether a tool's result is one: not empty, no error mark, no error in its first line."""
    said = F.coalesce(content, F.lit(""))
    return (strip(said) != "") & ~F.contains(said, F.lit("[ERROR]")) & ~F.startswith(strip(said), F.lit("Error"))


def actions(messages: DataFrame, trust_tools: bool = False) -> DataFrame:
    """(trace, pos, sub, kind, turn, name, content, result, success): kind is query, tool, answer or unknown.

    A result goes to the earliest call still without one; results that no call awaits are dropped.
    trust_tools takes every result for a success.
    """
    role, said = F.col("role"), F.coalesce("content", F.lit(""))
    called = F.coalesce(F.size("calls"), F.lit(0)) > 0
    is_result = (role == "tool") | ((role == "user") & F.contains(said, F.lit("[Tool Execution Result")))
    kind = (
        F.when(is_result, "result").when((role == "user") & F.contains(said, F.lit("[ERROR]")), None).when(role == "user", "query")
        .when((role == "assistant") & called, "tool").when((role == "assistant") & (strip(said) == ""), "unknown").when(role == "assistant", "answer")
    )
    rows = messages.select("trace", "pos", "content", kind.alias("kind"), "calls").where("kind is not null")
    rows = rows.select("trace", "pos", "content", "kind", F.posexplode_outer(F.when(F.col("kind") == "tool", F.col("calls"))).alias("sub", "call"))
    rows = rows.withColumn("sub", F.coalesce("sub", F.lit(0)))
    w = Window.partitionBy("trace").orderBy("pos", "sub")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    n = lambda k: F.sum((F.col("kind") == k).cast("long")).over(so_far)
    rows = rows.withColumns({"turn": n("query"), "tools": n("tool"), "results": n("result")})
    rows = rows.withColumn("lost", F.greatest(F.lit(0), F.max(F.col("results") - F.col("tools")).over(so_far)))
    kept = F.col("lost") == F.coalesce(F.lag("lost").over(w), F.lit(0))
    rows = rows.withColumn("slot", F.when(F.col("kind") == "tool", F.col("tools")).when((F.col("kind") == "result") & kept, F.col("results") - F.col("lost")))
    answered = F.max(F.when(F.col("kind") == "result", F.coalesce("content", F.lit("")))).over(Window.partitionBy("trace", "slot"))
    rows = rows.withColumn("result", F.when(F.col("kind") == "tool", answered)).where("kind != 'result'")
    good = F.col("result").isNotNull() if trust_tools else succeeded(F.col("result"))
    return rows.select("trace", "pos", "sub", "kind", "turn", F.col("call.name").alias("name"), F.coalesce("call.arguments", "content").alias("content"), "result", F.when(F.col("kind") == "tool", good).alias("success"))


def pairs(acts: DataFrame) -> DataFrame:
    """(trace, step_index, query, answer, tools): each query with the first answer before the next query and its tools up to then."""
    w = Window.partitionBy("trace").orderBy("pos", "sub")
    at = F.struct("pos", "sub")
    rows = acts.withColumn("q", F.sum((F.col("kind") == "query").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("q > 0")
    closed = F.min(F.when(F.col("kind") == "answer", at)).over(Window.partitionBy("trace", "q"))
    rows = rows.withColumn("before", closed.isNull() | (at < closed))
    said = F.col("kind") == "answer"
    made = rows.groupBy("trace", "q").agg(
        F.max(F.when(F.col("kind") == "query", F.col("content"))).alias("query"), F.min_by(F.when(said, F.col("content")), F.when(said, at)).alias("answer"),
        F.count_if(F.col("before") & F.col("kind").isin("tool", "unknown")).alias("tools"),
    ).where("query != ''")
    return made.select("trace", F.row_number().over(Window.partitionBy("trace").orderBy("q")).alias("step_index"), "query", "answer", "tools")


def align(gold: DataFrame, found: DataFrame) -> DataFrame:
    """gold (trace, step_index, ...) with answer, tools and is_missing of the pair at the same place."""
    return gold.join(found.select("trace", "step_index", "answer", "tools"), ["trace", "step_index"], "left").withColumn("is_missing", F.coalesce(F.col("answer") == "", F.lit(True)))


def tool_metrics(acts: DataFrame) -> DataFrame:
    """(trace, tools, success_rate, parallelism): 0 without tools; parallelism is calls by messages that call."""
    is_tool = F.col("kind") == "tool"
    made = acts.groupBy("trace").agg(F.count_if(is_tool).alias("tools"), F.count_if(is_tool & F.col("success")).alias("good"), F.count_if(is_tool & (F.col("sub") == 0)).alias("asked"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return made.select("trace", "tools", share("good", "tools").alias("success_rate"), share("tools", "asked").alias("parallelism"))


def whole_steps(steps: Column) -> Column:
    """Steps up to the last final answer, without earlier final answers and empty tool steps. steps: array<struct<type, size, ...>>."""
    indexed = F.transform(steps, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    last = F.array_max(F.transform(F.filter(indexed, lambda x: x["s"]["type"] == "final_answer"), lambda x: x["i"]))
    keep = F.filter(indexed, lambda x: (last.isNull() | (x["i"] <= last)) & ((x["s"]["type"] != "final_answer") | (x["i"] == last)) & ((x["s"]["type"] != "tool_call") | (x["s"]["size"] > 0)))
    return F.transform(keep, lambda x: x["s"])


def first_calls(calls: DataFrame, *order: str) -> DataFrame:
    """calls (scope, call_id, ...) without later ones of an id; blank ids all stay."""
    rn = F.row_number().over(Window.partitionBy("scope", "call_id").orderBy(*order))
    blank = F.coalesce(F.trim("call_id"), F.lit("")) == ""
    return calls.withColumn("rn", F.when(blank, 1).otherwise(rn)).where("rn = 1").drop("rn")


def unrecovered(steps: DataFrame) -> DataFrame:
    """Failed (trace, step, tool, targets array) that no later success of the tool with a common target follows.

    A failure without targets takes any later success. The latest success of each (trace, tool, target) is all
    that is compared, so nothing grows with pairs.
    """
    bad, good = steps.where("not success"), steps.where("success")
    latest = good.select("trace", "tool", "step", F.explode("targets").alias("target")).groupBy("trace", "tool", "target").agg(F.max("step").alias("again"))
    any_later = good.groupBy("trace", "tool").agg(F.max("step").alias("any_again"))
    each = bad.select("trace", "step", "tool", F.explode_outer("targets").alias("target")).join(latest, ["trace", "tool", "target"], "left").join(any_later, ["trace", "tool"], "left")
    again = F.when(F.col("target").isNull(), F.col("any_again")).otherwise(F.col("again"))
    return each.groupBy("trace", "step", "tool").agg(F.max(F.coalesce(again > F.col("step"), F.lit(False))).alias("recovered")).where("not recovered").drop("recovered")


def recent(messages: DataFrame, budget: int, cost: Column) -> DataFrame:
    """The latest messages of each trace that fit the budget (one stays whatever it costs), not starting with a tool's."""
    back = Window.partitionBy("trace").orderBy(F.desc("pos"))
    spent = F.sum("cost").over(back.rowsBetween(Window.unboundedPreceding, 0))
    kept = messages.withColumn("cost", cost).withColumns({"spent": spent, "nth": F.row_number().over(back)}).where((F.col("spent") <= budget) | (F.col("nth") == 1))
    led = F.max((F.col("role") != "tool").cast("int")).over(Window.partitionBy("trace").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("led", led).where("led = 1").drop("cost", "spent", "nth", "led")


def merge_tool_messages(messages: DataFrame) -> DataFrame:
    """(trace, pos, role, content): neighbouring tool messages become one, joined by a blank line."""
    w = Window.partitionBy("trace").orderBy("pos")
    fresh = ((F.col("role") != "tool") | F.coalesce(F.lag("role").over(w) != "tool", F.lit(True))).cast("long")
    runs = messages.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("content", F.lit("")).alias("content"))))
    return runs.groupBy("trace", "island").agg(F.min("pos").alias("pos"), F.min("role").alias("role"), F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n").alias("content")).drop("island")
