"""Training segments of rollouts, their conversations with trainable marks, and token-level advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rewards import return_to_go


def segments(rollouts: DataFrame, gamma: float = 0.95, kappa: float = 1.0) -> DataFrame:
    """(rollout, segment, kind, step, value): a return for each tool step, for the answer and for the memory, where there are such.

    rollouts: (rollout, rewards array<double>, answer string, answer_reward double, memory_reward double). A null
    answer or memory reward has no segment; a null answer reward counts 0. Answers and memories have step -1.
    """
    reward = F.coalesce("answer_reward", F.lit(0.0))
    row = lambda tail, kind, step, value: F.struct(F.concat(F.col("rollout").cast("string"), F.lit("_"), tail).alias("segment"), F.lit(kind).alias("kind"), step.cast("int").alias("step"), value.alias("value"))
    tools = F.transform(return_to_go(F.coalesce("rewards", F.array().cast("array<double>")), reward, gamma, kappa), lambda g, t: row(F.concat(F.lit("tool_"), t.cast("string")), "tool", t, g))
    answer = F.when(F.col("answer").isNotNull(), row(F.lit("answer"), "answer", F.lit(-1), reward))
    memory = F.when(F.col("memory_reward").isNotNull(), row(F.lit("memory"), "memory", F.lit(-1), F.col("memory_reward")))
    return rollouts.select("rollout", F.inline(F.concat(tools, F.array_compact(F.array(answer, memory)))))


def conversation(rollouts: DataFrame) -> DataFrame:
    """(rollout, pos, role, kind, trainable, step, content): a rollout's messages as its model saw and wrote them.

    rollouts: (rollout, system, question, steps array<struct<step int, response string, invalid boolean, observations
    array<struct<content string, success boolean>>>>, answer). Calls and the answer are trainable; an invalid step is
    followed by one error message in place of its observations. Null texts are empty; a null answer has no message.
    """
    none = F.lit(None).cast("int")
    said = lambda role, kind, train, step, text: F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.lit(train).alias("trainable"), step.alias("step"), F.coalesce(text, F.lit("")).alias("content"))

    def messages(s: Column) -> Column:
        mark = lambda o: F.when(o["success"], "[Tool Result] ").otherwise("[ERROR] ")
        shown = F.transform(F.coalesce(s["observations"], F.array().cast("array<struct<content:string,success:boolean>>")), lambda o: said("user", "tool_observation", False, s["step"], F.concat(mark(o), F.coalesce(o["content"], F.lit("")))))
        refused = F.array(said("user", "error_feedback", False, s["step"], F.lit("[ERROR] Multiple tool calls detected...")))
        return F.concat(F.array(said("assistant", "tool_call", True, s["step"], s["response"])), F.when(s["invalid"], refused).otherwise(shown))

    opening = F.array(said("system", "system_prompt", False, none, F.col("system")), said("user", "user_question", False, none, F.col("question")))
    closing = F.array_compact(F.array(F.when(F.col("answer").isNotNull(), said("assistant", "answer", True, none, F.col("answer")))))
    made = rollouts.select("rollout", F.posexplode(F.concat(opening, F.flatten(F.transform("steps", messages)), closing)).alias("pos", "m"))
    return made.select("rollout", "pos", "m.*")


def with_advantages(messages: DataFrame, segs: DataFrame) -> DataFrame:
    """messages with `advantage`: of a call its step's value, of an answer or memory its own, else 0."""
    value = segs.select("rollout", F.when(F.col("kind") == "tool", "tool_call").otherwise(F.col("kind")).alias("kind"), F.col("step").alias("at"), F.col("value").alias("advantage"))
    return messages.withColumn("at", F.coalesce("step", F.lit(-1))).join(value, ["rollout", "kind", "at"], "left").drop("at").withColumn("advantage", F.coalesce("advantage", F.lit(0.0)))


def token_arrays(messages: DataFrame, tokens: Column, limit: int = 4096) -> DataFrame:
    """(rollout, ids, advantages, trainable), one entry a token, cut to the limit; rollouts without tokens have no row.

    tokens: an array of token ids of a message, by built-in functions or a pandas UDF of a tokenizer. Tokens past the
    limit go before a rollout is gathered, so that a task holds at most `limit` of them for it.
    """
    sized = messages.withColumn("ids", tokens).where("size(ids) > 0").withColumn("n", F.size("ids"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rollout").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sized.withColumn("before", before).where(F.col("before") < limit).withColumn("ids", F.slice("ids", F.lit(1), (F.lit(limit) - F.col("before")).cast("int")))
    part = F.struct("pos", "ids", "advantage", F.col("trainable").cast("double").alias("mask"))
    whole = cut.groupBy("rollout").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    spread = lambda name: F.flatten(F.transform("parts", lambda p: F.array_repeat(p[name], F.size(p["ids"]))))
    return whole.select("rollout", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), spread("advantage").alias("advantages"), spread("mask").alias("trainable"))
