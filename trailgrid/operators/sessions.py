"""State that agents keep between turns, as relations: caches, snapshots, accumulated traces, histories, records of turns and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import strip


def valid_summaries(summaries: DataFrame, files: DataFrame) -> DataFrame:
    """Summaries (path, modified, ...) of files (path, modified) that were not changed since; those of files that are gone are dropped."""
    now = files.select("path", F.col("modified").alias("_now"))
    return summaries.join(now, "path").where(F.col("modified") >= F.col("_now")).drop("_now")


def unexpired(cache: DataFrame, now: Column, days: float) -> DataFrame:
    """Entries (…, made timestamp) not older than some days."""
    return cache.where(F.col("made") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0)))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of snapshots (path, size, modified): new, gone or changed files; those that stay the same are left out."""
    b, a = before.select("path", F.struct("size", "modified").alias("b")), after.select("path", F.struct("size", "modified").alias("a"))
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, "path", "full").select("path", change.alias("change")).where("change is not null")


def without_old_reasoning(messages: DataFrame) -> DataFrame:
    """messages (trace, pos, role, content, reasoning, signature) without reasoning and signature up to the last real user message."""
    said = (F.col("role") == "user") & (F.coalesce("content", F.lit("")) != "") & ~F.startswith("content", F.lit("[Tool Execution Result"))
    last = F.max(F.when(said, F.col("pos"))).over(Window.partitionBy("trace"))
    old = F.col("pos") <= F.coalesce("_last", F.lit(-1))
    marked = messages.withColumn("_last", last)
    return marked.withColumns({c: F.when(~old, F.col(c)) for c in ("reasoning", "signature")}).drop("_last")


def carried_signature(messages: DataFrame, kept: Column) -> DataFrame:
    """The kept messages (trace, pos, role, signature): where none has a signature, the first assistant's takes the latest of those dropped."""
    w = Window.partitionBy("trace")
    marked = messages.withColumn("_kept", kept)
    lost = F.max_by(F.when(~F.col("_kept"), F.col("signature")), F.when(~F.col("_kept") & (F.coalesce("signature", F.lit("")) != ""), F.col("pos"))).over(w)
    has = F.max(F.col("_kept") & (F.coalesce("signature", F.lit("")) != "")).over(w)
    first = F.min(F.when(F.col("_kept") & (F.col("role") == "assistant"), F.col("pos"))).over(w)
    marked = marked.withColumns({"_lost": lost, "_has": has, "_first": first}).where("_kept")
    return marked.withColumn("signature", F.when(~F.col("_has") & (F.col("pos") == F.col("_first")), F.coalesce("_lost", "signature")).otherwise(F.col("signature"))).drop("_kept", "_lost", "_has", "_first")


def accumulated(calls: DataFrame) -> DataFrame:
    """(trace, entry, messages, response) of model calls (trace, turn, system, messages array<string>, response): calls with one system prompt in a row are one entry.

    An entry's messages are those of its last call, which repeats what came before; a new prompt starts a new entry.
    """
    order = Window.partitionBy("trace").orderBy("turn")
    fresh = F.coalesce(F.lag("system").over(order) != F.col("system"), F.lit(True)).cast("long")
    runs = calls.withColumn("fresh", fresh).withColumn("entry", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("trace", "entry").agg(F.max_by("messages", "turn").alias("messages"), F.max_by("response", "turn").alias("response"), F.count("*").alias("calls"))


def next_context(mode: Column, system: Column, summary: Column, history: Column) -> Column:
    """Messages (array<string>) that a new question starts from: reset, keep the summary, or continue the whole history."""
    kept = F.array_compact(F.array(system, F.when(F.coalesce(strip(summary), F.lit("")) != "", summary)))
    return F.when(mode == "continue", F.concat(F.array(system), history)).when(mode == "summary", kept).otherwise(F.array(system))


def turn_records(events: DataFrame) -> DataFrame:
    """(trace, turn, steps, latency, success) of events (trace, turn, at timestamp, kind): from a turn's question to its last event; it succeeds with an answer."""
    seconds = (F.unix_micros(F.max("at")) - F.unix_micros(F.min("at"))) / 1e6
    return events.groupBy("trace", "turn").agg(F.count_if(F.col("kind") == "step").alias("steps"), seconds.alias("latency"), (F.count_if(F.col("kind") == "answer") > 0).alias("success"))


def repair_ids(calls: DataFrame, iteration: int) -> DataFrame:
    """calls (scope, step, pos, ...) with new ids repair_call_<iteration>_<number>, numbers from 0 with three digits or more."""
    n = F.row_number().over(Window.partitionBy("scope").orderBy("step", "pos")) - 1
    return calls.withColumn("call_id", F.format_string(f"repair_call_{iteration}_%03d", n))


def sequential_ids(calls: DataFrame) -> DataFrame:
    """calls (scope, step, pos, call_id) with `new_id` call_<number> from 1, three digits or more; observations follow by (scope, step, call_id)."""
    n = F.row_number().over(Window.partitionBy("scope").orderBy("step", "pos"))
    return calls.withColumn("new_id", F.format_string("call_%03d", n))


def failure_reasons(audits: DataFrame) -> DataFrame:
    """(sample, sq, reasons) of audits (sample, sq, issues array): a list of issues; none is 'Unknown'."""
    text = F.array_join(F.transform("issues", lambda i: F.concat(F.lit("- "), i)), "\n")
    return audits.select("sample", "sq", F.when(F.coalesce(F.size("issues"), F.lit(0)) > 0, text).otherwise("Unknown").alias("reasons"))


def true_files(evaluated: Column, remembered: Column) -> Column:
    """The files a sub-question needs: those of its evaluation, or where it has none, those its memory names."""
    names = F.filter(F.transform(remembered, lambda t: t["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.when(F.coalesce(F.size(evaluated), F.lit(0)) > 0, evaluated).otherwise(F.coalesce(names, F.array().cast("array<string>")))


def judged(claimed: Column, covered: Column, missing: Column, points: Column, files_ok: Column) -> Column:
    """A judge's verdict that its own lists bear out: it passes only if it says so, nothing is missing, every point is covered and files are."""
    return F.coalesce(claimed & files_ok & (F.size(missing) == 0) & (F.size(F.array_distinct(covered)) == F.size(points)), F.lit(False))


def trainer_messages(messages: DataFrame, calls_text) -> DataFrame:
    """(trace, pos, role, content): an assistant's calls written into its text, neighbouring tool results merged."""
    from .traces import merge_tool_messages

    called = F.coalesce(F.size("calls"), F.lit(0)) > 0
    text = F.when((F.col("role") == "assistant") & called, F.concat_ws("\n", F.nullif(F.coalesce("content", F.lit("")), F.lit("")), calls_text(F.col("calls")))).otherwise(F.col("content"))
    return merge_tool_messages(messages.withColumn("content", text).drop("calls"))


def with_evaluations(traces: DataFrame, evaluations: DataFrame) -> DataFrame:
    """traces with the latest evaluation (trace, made, ...) of each; files of traces are never rewritten."""
    nth = F.row_number().over(Window.partitionBy("trace").orderBy(F.desc("made")))
    latest = evaluations.withColumn("_n", nth).where("_n = 1").drop("_n")
    return traces.join(latest, "trace", "left")


def call_reevaluation(records: DataFrame) -> DataFrame:
    """records (sample, sq, steps array<struct<type, ...>>, answer, data_source, unrecovered, schema_issues, files, unseen) with `issues` of the checks that need no model."""
    steps = F.coalesce(F.transform("steps", lambda s: s["type"]), F.array().cast("array<string>"))
    finals = F.size(F.filter(steps, lambda t: t == "final_answer"))
    sources = F.coalesce(F.col("data_source"), F.array().cast("array<string>"))
    checks = {
        "answer is empty": F.coalesce(strip(F.col("answer")), F.lit("")) == "", "data_source is empty": F.size(sources) == 0, "unrecovered errors": F.col("unrecovered") > 0, "no final step": finals == 0,
        "several final steps": finals > 1, "final step is not last": (finals > 0) & (F.element_at(F.concat(steps, F.array(F.lit(""))), F.greatest(F.size(steps), F.lit(1))) != "final_answer"), "invalid calls": F.col("schema_issues") > 0,
        "files not covered": F.size(F.array_except(F.coalesce(F.col("files"), F.array().cast("array<string>")), sources)) > 0, "numbers not observed": F.size("unseen") > 0,
    }
    return records.withColumn("issues", F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), what) for what, test in checks.items()])))
