"""Gold samples: which sample a trace answers, which message asks which question, evaluations and predicted files beside gold ones.

Texts that hold one another are found by equal grams, never by comparing all with all: a text is looked up
by its rarest gram of GRAM characters (shorter ones by themselves), which every text that holds it also has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import answer_issues, normal, strip

#: Characters of a gram.
GRAM = 8
#: Suffixes that derived files have.
VARIANTS = r"(_split|_merged|_flattened|_part\d+)+$"


def _text(c: str) -> Column:
    return F.coalesce(strip(F.col(c)), F.lit(""))


def contained(small: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b) of small (a, text) and large (b, text) where the first text, not empty, stands in the second."""
    inner = small.where("text != ''").select("a", F.col("text").alias("s"))
    outer = large.where("text != ''").select("b", F.col("text").alias("t"))
    lengths = inner.select(F.least(F.length("s"), F.lit(GRAM)).alias("g")).distinct()  # at most GRAM rows
    every = lambda text, g: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - g + 1), lambda i: F.substr(text, i, g)))
    held = outer.join(F.broadcast(lengths), F.length("t") >= F.col("g")).select("b", "t", "g", F.explode(every(F.col("t"), F.col("g"))).alias("gram"))
    asked = inner.withColumn("g", F.least(F.length("s"), F.lit(GRAM))).select("a", "s", "g", F.explode(every(F.col("s"), F.col("g"))).alias("gram"))
    often = held.groupBy("g", "gram").agg(F.count("*").alias("n"))
    rarest = asked.join(often, ["g", "gram"], "left").groupBy("a", "s", "g").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0").select("a", "s", "g", F.col("x.gram").alias("gram"))
    return rarest.join(held, ["g", "gram"]).where(F.contains("t", F.col("s"))).select("a", "b")


def _matches(traces: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal and containing (query, task) texts, each once, of traces (trace, query) and samples (pos, task)."""
    asked = traces.select(_text("query").alias("query")).distinct()
    tasks = samples.select(_text("task").alias("task")).distinct()
    same = asked.join(tasks, F.col("query") == F.col("task"))
    q, t = (lambda n: asked.select(F.col("query").alias(n), F.col("query").alias("text"))), (lambda n: tasks.select(F.col("task").alias(n), F.col("task").alias("text")))
    part = contained(q("a"), t("b")).select(F.col("a").alias("query"), F.col("b").alias("task")).unionByName(contained(t("a"), q("b")).select(F.col("b").alias("query"), F.col("a").alias("task")))
    return same, part.distinct()


def first_sample(traces: DataFrame, samples: DataFrame) -> DataFrame:
    """traces (trace, query) with the pos of the first sample (pos, task) whose task equals the query, holds it, or stands in it; null if none."""
    same, part = _matches(traces, samples)
    firsts = samples.groupBy(_text("task").alias("task")).agg(F.min("pos").alias("pos"))
    best = same.unionByName(part).join(firsts, "task").groupBy(F.col("query").alias("q")).agg(F.min("pos").alias("pos"))
    return traces.join(best, _text("query") == F.col("q"), "left").drop("q")


def best_sample(traces: DataFrame, samples: DataFrame) -> DataFrame:
    """traces (trace, query) with the pos of the first sample with an equal task, else of the longest task that holds or stands in the query (the first of equals). An empty query has none."""
    same, part = _matches(traces.where(_text("query") != ""), samples)
    firsts = samples.groupBy(_text("task").alias("task")).agg(F.min("pos").alias("pos"))
    ranked = same.withColumn("equal", F.lit(1)).unionByName(part.withColumn("equal", F.lit(0))).join(firsts, "task")
    best = ranked.groupBy(F.col("query").alias("q")).agg(F.max(F.struct("equal", F.when(F.col("equal") == 1, 0).otherwise(F.length("task")).alias("n"), (-F.col("pos")).alias("p")))["p"].alias("p"))
    return traces.join(best, _text("query") == F.col("q"), "left").select(*traces.columns, (-F.col("p")).alias("pos"))


def find_anchors(messages: DataFrame, items: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """items (trace, sq, item) with `at`, the user message that asks each, and `how`.

    messages: (trace, pos, role, content); asked: (trace, step, query), what an evaluation says was asked. Tried in turn:
    equal texts, equal normal forms, the item inside the message, an evaluated query of equal normal form to the message.
    Each takes the first message. A message that several items claim goes to the best way, then to the first item;
    the others keep how = 'claimed'. Items without text are left out.
    """
    said = messages.where("role = 'user'").select("trace", "pos", _text("content").alias("text")).withColumn("form", normal(F.col("text")))
    want = items.select("trace", "sq", _text("item").alias("item")).where("item != ''").withColumn("form", normal(F.col("item")))
    exact = want.join(said, (want["trace"] == said["trace"]) & (F.col("item") == F.col("text"))).select(want["trace"], "sq", F.lit(0).alias("rank"), "pos")
    alike = want.join(said.drop("text"), ["trace", "form"]).select("trace", "sq", F.lit(1).alias("rank"), "pos")
    # Within one trace, which is one run's and small.
    held = want.select("trace", "sq", "item").join(said.select("trace", "pos", "text"), "trace").where(F.contains("text", F.col("item"))).select("trace", "sq", F.lit(2).alias("rank"), "pos")
    ways = exact.unionByName(alike).unionByName(held)
    if asked is not None:
        met = asked.select("trace", "step", normal(_text("query")).alias("form")).where("form != ''").join(said.drop("text"), ["trace", "form"])
        # The first evaluated query that was said; its first message.
        first = met.groupBy("trace").agg(F.min(F.struct("step", "pos"))["pos"].alias("pos"))
        ways = ways.unionByName(want.select("trace", "sq").join(first, "trace").select("trace", "sq", F.lit(3).alias("rank"), "pos"))
    best = ways.groupBy("trace", "sq").agg(F.min(F.struct("rank", "pos")).alias("x")).select("trace", "sq", "x.rank", "x.pos")
    wins = F.row_number().over(Window.partitionBy("trace", "pos").orderBy("rank", "sq")) == 1
    names = F.element_at(F.array(*map(F.lit, ("exact", "normalized", "substring", "asked"))), F.col("rank") + 1)
    chosen = best.withColumn("wins", wins).select("trace", "sq", F.when(F.col("wins"), F.col("pos")).alias("at"), F.when(F.col("wins"), names).otherwise("claimed").alias("how"))
    return want.select("trace", "sq", "item").join(chosen, ["trace", "sq"], "left").withColumn("how", F.coalesce("how", F.lit("unmatched")))


def align_evaluations(records: DataFrame, evaluations: DataFrame, *metrics: str) -> DataFrame:
    """records (candidate, sq from 1, answer struct<answer, data_source>) with each metric of evaluations (candidate, arrays by position) and a format audit."""
    issues = answer_issues(F.col("answer"))
    text, sources = F.coalesce(strip(F.col("answer.answer")), F.lit("")), F.coalesce(F.col("answer.data_source"), F.array().cast("array<string>"))
    audit = F.struct(F.col("answer").isNotNull().alias("answer_json_valid"), (text != "").alias("has_answer"), ((F.size(sources) > 0) & F.forall(sources, lambda s: F.coalesce(strip(s), F.lit("")) != "")).alias("has_data_source"), issues.alias("format_issues"))
    joined = records.join(evaluations.select("candidate", *metrics), "candidate", "left")
    at = F.col("sq").cast("int") - 1
    return joined.select(*records.columns, *[F.when(at >= 0, F.get(m, at)).alias(m) for m in metrics], audit.alias("format_audit"))


def sample_id(*names: str) -> Column:
    """The first of the columns that is not empty."""
    return F.coalesce(*[F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names])


def file_stem(path: Column) -> Column:
    """A file's name without folder, extension and the suffixes of derived files."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"[^/\\]*$", 0), r"\.[A-Za-z0-9]+$", ""), VARIANTS, "")


def files_match(true: Column, predicted: Column) -> Column:
    """struct<covered, correct, recall, precision, f1> of two arrays of paths: equal stems, or one in the other."""
    stems = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), file_stem), lambda s: s != "")
    want, said = stems(true), stems(predicted)
    meets = lambda x, y: F.contains(x, y) | F.contains(y, x)
    covered = F.size(F.filter(want, lambda w: F.exists(said, lambda p: meets(w, p))))
    correct = F.size(F.filter(said, lambda p: F.exists(want, lambda w: meets(w, p))))
    recall, precision = F.coalesce(F.try_divide(covered, F.size(want)), F.lit(0.0)), F.coalesce(F.try_divide(correct, F.size(said)), F.lit(0.0))
    return F.struct(covered.alias("covered"), correct.alias("correct"), recall.alias("recall"), precision.alias("precision"), F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0)).alias("f1"))
