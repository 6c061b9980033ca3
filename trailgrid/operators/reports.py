"""Figures of evaluation reports and audits: tokens, runs, special cases, counters, summaries, and what outputs must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of evidence and of dependencies, and the fields that a dependency of each kind needs.
EVIDENCE = ("raw_value", "derived_value", "text_fact")
DEPENDENCY_FIELDS = {
    "numeric_fact": ("entity", "time", "metric", "value", "unit"), "entity_set": ("entities",), "reference": ("reference_text", "target_sq"), "constraint": ("constraint_content",), "table_ref": ("table_name",),
}


def token_count(text: Column) -> Column:
    """Stand-in for a model's tokenizer: runs of letters and digits of one script, each CJK sign, each other sign."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}&&[^\p{IsHan}]]+|\p{IsHan}|[^\s\p{L}\p{N}]"), F.lit(0))).cast("long")


def batch_size(longest: Column) -> Column:
    """How many texts are encoded at a time, by the tokens of the longest."""
    return F.when(longest > 4096, 4).when(longest > 2048, 8).when(longest > 1024, 16).when(longest > 512, 32).otherwise(64)


def trace_tokens(messages: DataFrame, count=token_count) -> DataFrame:
    """(trace, messages, tokens)."""
    return messages.groupBy("trace").agg(F.count("*").alias("messages"), F.sum(count(F.col("content"))).alias("tokens"))


def usage_totals(messages: DataFrame) -> DataFrame:
    """(trace, prompt, completion, total) of messages (trace, prompt, completion); a message without usage adds nothing."""
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return messages.groupBy("trace").agg(zero("prompt").alias("prompt"), zero("completion").alias("completion"), (zero("prompt") + zero("completion")).alias("total"))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row of runs (success, turns, tokens, success_rate, parallelism): counts, share of successes, means and extremes; nulls count as 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return runs.agg(
        F.count("*").alias("runs"), F.count_if("success").alias("succeeded"), F.coalesce(F.avg(F.coalesce(F.col("success"), F.lit(False)).cast("int")), F.lit(0.0)).alias("success_share"),
        F.avg(zero("turns")).alias("avg_turns"), F.avg(zero("tokens")).alias("avg_tokens"), F.max(zero("tokens")).alias("max_tokens"), F.min(zero("tokens")).alias("min_tokens"),
        F.avg(zero("success_rate")).alias("avg_success_rate"), F.avg(zero("parallelism")).alias("avg_parallelism"),
    )


def special_cases(steps: DataFrame) -> DataFrame:
    """Steps whose answer is whole (coverage 1 or more) though not all files were found (recall below 1); unevaluated ones are none."""
    return steps.where("coverage is not null and recall is not null and coverage >= 1 and recall < 1")


def counters(rows: DataFrame, what: str, most: int | None = None) -> DataFrame:
    """(what, n) by falling count, then name; the first `most`."""
    counted = rows.groupBy(what).agg(F.count("*").alias("n")).orderBy(F.desc("n"), what)
    return counted.limit(most) if most else counted


def counterfactual_summary(boundaries: DataFrame) -> DataFrame:
    """One row of boundaries (rollout, eligible, executed): rollouts, eligible, executed and skipped boundaries."""
    return boundaries.agg(F.count_distinct("rollout").alias("rollouts"), F.count_if("eligible").alias("eligible"), F.count_if(F.col("eligible") & F.col("executed")).alias("executed"), F.count_if(F.col("eligible") & ~F.col("executed")).alias("skipped"))


def export_summary(dialogs: DataFrame) -> DataFrame:
    """One row of dialogs (issues array): all, exported, skipped, skip_rate, and ok, false where nothing is exported."""
    clean = F.size("issues") == 0
    return dialogs.agg(F.count("*").alias("dialogs"), F.count_if(clean).alias("exported"), F.count_if(~clean).alias("skipped"), F.coalesce(F.try_divide(F.count_if(~clean), F.count("*")), F.lit(0.0)).alias("skip_rate"), (F.count_if(clean) > 0).alias("ok"))


def executes(rate: float, seed: int, *keys: str) -> Column:
    """Whether a boundary is worked out: a share `rate` of them, by a hash, so that reruns and any order of rows agree."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000)


def evidence_issues(item: Column) -> Column:
    """What is wrong with struct<sample, sq, item, kind, value, operation, inputs array>."""
    blank = lambda c: F.coalesce(F.trim(item[c].cast("string")), F.lit("")) == ""
    derived = F.coalesce(item["kind"] == "derived_value", F.lit(False))
    return F.array_compact(
        F.array(
            *[F.when(blank(c), f"missing {c}") for c in ("sample", "sq", "item", "kind", "value")], F.when(derived & blank("operation"), "missing operation"), F.when(~F.coalesce(item["kind"].isin(*EVIDENCE), F.lit(False)), "unknown kind"),
            F.when(derived & (F.coalesce(F.size(item["inputs"]), F.lit(0)) <= 0), "derived without inputs"), F.when((item["kind"] == "text_fact") & ~blank("value") & (F.length(item["value"]) < 2), "text too short"),
        )
    )


def dependency_issues(dependency: Column) -> Column:
    """What is wrong with struct<id, kind, needed_by, fields map>."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    needs = [F.when((dependency["kind"] == kind) & blank(F.try_element_at(dependency["fields"], F.lit(name))), f"missing {name}") for kind, names in DEPENDENCY_FIELDS.items() for name in names]
    return F.array_compact(F.array(F.when(blank(dependency["id"]), "missing id"), F.when(~F.coalesce(dependency["kind"].isin(*DEPENDENCY_FIELDS), F.lit(False)), "unknown kind"), F.when(blank(dependency["needed_by"].cast("string")), "missing needed_by"), *needs))


def audit_checks(evidence: DataFrame, dependencies: DataFrame, rewards: DataFrame, report: str | None) -> DataFrame:
    """(check, pass, bad) of an audit's outputs: evidence (sample, sq, kind, inputs), dependencies (boundary, needed_by), rewards (r_tool, r_answer, r_memory)."""
    spark = evidence.sparkSession
    found = evidence.agg(F.lit("evidence of sub-questions").alias("check"), (F.count_distinct("sample", "sq") > 0).alias("pass"), F.lit(0).cast("long").alias("bad"))
    past = dependencies.agg(F.lit("dependencies look ahead").alias("check"), (F.count_if(F.col("needed_by") <= F.col("boundary")) == 0).alias("pass"), F.count_if(F.col("needed_by") <= F.col("boundary")).alias("bad"))
    bare = F.count_if((F.col("kind") == "derived_value") & (F.coalesce(F.size("inputs"), F.lit(0)) <= 0))
    based = evidence.agg(F.lit("derived items have inputs").alias("check"), (bare == 0).alias("pass"), bare.alias("bad"))
    lacking = F.count_if(F.col("r_tool").isNull() | F.col("r_answer").isNull() | F.col("r_memory").isNull())
    whole = rewards.agg(F.lit("rewards are whole").alias("check"), (lacking == 0).alias("pass"), lacking.alias("bad"))
    written = spark.range(1).select(F.lit("report is written").alias("check"), F.lit(bool(report)).alias("pass"), F.lit(0 if report else 1).cast("long").alias("bad"))
    return found.unionAll(past).unionAll(based).unionAll(whole).unionAll(written)


def middle(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, lo, hi, mean, middle): middle is the element at n div 2 of the sorted values (from 0).

    Values are counted first; then only those in the one of 1024 ranges of a key's values that holds the middle are put
    in order, so no task sorts all values of a hot key unless they crowd into one range.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    sums = per.groupBy(*keys).agg(F.sum("c").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"))
    share = F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo"))
    ranged = per.join(sums, list(keys)).select(*keys, value, "c", F.floor(F.col("n") / 2).alias("half"), F.least(F.floor(F.coalesce(share, F.lit(0.0)) * 1024), F.lit(1023)).alias("range"))
    sizes = ranged.groupBy(*keys, "range", "half").agg(F.sum("c").alias("rc"))
    before = F.sum("rc").over(Window.partitionBy(*keys).orderBy("range")) - F.col("rc")
    hit = sizes.withColumn("before", before).where((F.col("before") <= F.col("half")) & (F.col("before") + F.col("rc") > F.col("half"))).select(*keys, "range", "before")
    run = F.col("before") + F.sum("c").over(Window.partitionBy(*keys).orderBy(value))
    at = ranged.join(hit, [*keys, "range"]).withColumn("run", run).where("run > half").groupBy(*keys).agg(F.min(value).alias("middle"))
    return sums.join(at, list(keys))


def file_scores(steps: DataFrame) -> DataFrame:
    """One row of steps (recall, precision, f1, is_missing): means over all steps, missing ones as told, and over those that aren't missing; 0 without any."""
    fine = ~F.coalesce(F.col("is_missing"), F.lit(False))
    mean = lambda c, test: F.coalesce(F.avg(F.when(test, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))), F.lit(0.0))
    names = ("recall", "precision", "f1")
    return steps.agg(*[mean(c, F.lit(True)).alias(f"strict_{c}") for c in names], *[mean(c, fine).alias(c) for c in names])


def dialog_audits(records: DataFrame, gold: DataFrame) -> DataFrame:
    """(sample, candidate, found, wanted, passes, issue) of records (sample, candidate, passes) and gold (sample, wanted).

    A dialog passes if all its sub-questions do and they are as many as the gold has; without gold it never does.
    """
    per = records.groupBy("sample", "candidate").agg(F.count("*").alias("found"), F.bool_and("passes").alias("all"))
    joined = per.join(gold.groupBy("sample").agg(F.max("wanted").alias("wanted")), "sample", "left").withColumn("wanted", F.coalesce("wanted", F.lit(0)))
    issue = F.when(F.col("wanted") <= 0, "no gold").when(F.col("found") != F.col("wanted"), "count differs")
    return joined.select("sample", "candidate", "found", "wanted", (F.col("all") & issue.isNull()).alias("passes"), issue.alias("issue"))


def tool_error_audit(steps: DataFrame, lost: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """(trace, errors, infrastructure, unrecovered) of steps (trace, step, tool, content, success) and the unrecovered ones (trace, step, tool)."""
    infra = F.coalesce(F.col("content").rlike("|".join(marks)), F.lit(False))
    own = steps.groupBy("trace").agg(F.count_if(~F.col("success")).alias("errors"), F.count_if(~F.col("success") & infra).alias("infrastructure"))
    return own.join(lost.groupBy("trace").agg(F.count("*").alias("unrecovered")), "trace", "left").withColumn("unrecovered", F.coalesce("unrecovered", F.lit(0)))


def recovery_tags(content: Column) -> Column:
    """Errors of code that a result names, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(r"\b(IndexError|NameError)\b"), F.lit(1))))


def complete(ids: Column, n: Column) -> Column:
    """Whether the distinct ids of an array are just 1 to n."""
    return F.when(n > 0, F.array_sort(F.array_distinct(ids)) == F.sequence(F.lit(1), n.cast("int"))).otherwise(F.size(ids) == 0)


def cache_figures(entries: DataFrame) -> DataFrame:
    """One row of a cache's entries (value): how many, and megabytes of their texts."""
    return entries.agg(F.count("*").alias("entries"), F.round(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)) / (1 << 20), 6).alias("megabytes"))
