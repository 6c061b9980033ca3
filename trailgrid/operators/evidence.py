"""Evidence: whether values, sources and computed results hold, the ledger of what is verified, and answer rewards.

The ledger joins the items of one sub-question with its steps; both are a single run's and small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import amount, amounts_in, any_of, match_form, strip

#: Words that show an operation, by its name, and words of any computation.
OPERATIONS = {
    "同比增长率": ("同比", "增长", "增长率", "yoy"), "环比增长率": ("环比", "增长率"), "占比": ("占比", "比例", "比重", "ratio", "proportion"), "average": ("平均", "均值", "average", "mean"),
    "sum": ("求和", "总和", "合计", "sum", "total"), "difference": ("差", "差值", "差异", "difference"), "ratio": ("比率", "比值", "ratio"),
}
COMPUTING = ("同比", "环比", "增长率", "占比", "平均", "求和", "合计", "+", "-", "*", "/", "sum", "mean", "average", "ratio", "percentage", "percent")
CODE_TOOLS = ("python_exec", "python", "calculator", "code_exec", "execute_code", "calculate", "compute", "python_code_executor")
#: Words of an operation's name that say how to recompute it, in the order tried.
RECOMPUTE = (
    ("ratio", ("占比", "比例", "比重", "ratio", "proportion")), ("sum", ("求和", "合计", "sum", "total")), ("difference", ("差", "差异", "差值", "difference")),
    ("average", ("平均", "均值", "average", "mean")), ("growth", ("增长", "同比", "环比", "growth", "yoy")),
)


def needle(kind: Column, value: Column) -> Column:
    """What is looked for: struct<number, short, head>: a value's number unless it is a text fact; a form of under two characters as it is, of a longer one the start."""
    value = F.coalesce(value, F.lit(""))
    form = match_form(value)
    head = F.when(F.length(form) >= 8, F.left(form, F.lit(12))).otherwise(form)
    return F.struct(F.when(kind != "text_fact", amount(value)).alias("number"), F.when(F.length(form) < 2, F.lower(strip(value))).alias("short"), head.alias("head"))


def haystack(source: Column) -> Column:
    """What it is looked for in: struct<numbers, form, low> of a text."""
    source = F.coalesce(source, F.lit(""))
    return F.struct(amounts_in(source).alias("numbers"), match_form(source).alias("form"), F.lower(source).alias("low"))


def shows(hay: Column, sought: Column) -> Column:
    """Whether a source shows a value: by its number, or else by containment."""
    by_number = F.coalesce(F.exists(hay["numbers"], lambda v: F.abs(v - sought["number"]) < 1e-6), F.lit(False))
    return by_number | F.when(sought["short"].isNotNull(), (hay["low"] != "") & F.contains(hay["low"], sought["short"])).otherwise(F.contains(hay["form"], sought["head"]))


def value_match(kind: Column, value: Column, *sources: Column) -> Column:
    """Whether a value stands in a source: numbers by value, or else texts by containment (of long ones the first 12 characters do)."""
    sought = needle(kind, value)
    return any_of(*[shows(haystack(s), sought) for s in sources])


def source_match(allowed: Column, observed: Column) -> Column:
    """Whether an observed source and an allowed table contain one another; true where no table is asked for."""
    low = lambda a: F.transform(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), F.lower)
    want, seen = low(allowed), low(observed)
    return (F.size(want) == 0) | F.exists(seen, lambda o: F.exists(want, lambda a: F.contains(a, o) | F.contains(o, a)))


def operator_match(operation: Column, text: Column, tool: Column) -> Column:
    """Whether a text shows an operation. Without one, and for code tools that were given any text, true."""
    op, text, tool = F.lower(F.coalesce(operation, F.lit(""))), F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(tool, F.lit("")))
    shows = lambda words: any_of(*[F.contains(text, F.lit(w)) for w in words])
    known = shows(COMPUTING)
    for name, words in OPERATIONS.items():
        known = F.when(op == name, shows(words)).otherwise(known)
    return (op == "") | known | F.contains(text, op) | (tool.isin(*CODE_TOOLS) & (strip(text) != ""))


def result_match(value: Column, operation: Column, inputs: Column, code: Column) -> Column:
    """Whether a computed value follows from its inputs (array<double>) within 2 %, percent or ratio alike; where nothing
    can be recomputed, whether code printed it. Values that are no numbers pass."""
    t, op = amount(value), F.lower(F.coalesce(operation, F.lit("")))
    a, b, n = F.get(inputs, F.lit(0)), F.get(inputs, F.lit(1)), F.size(inputs)
    total = F.aggregate(inputs, F.lit(0.0), lambda s, x: s + x)
    tiny = lambda x: F.greatest(x, F.lit(1e-9))
    rates = F.flatten(F.transform(F.array((a - b) / tiny(F.abs(b)), (b - a) / tiny(F.abs(a))), lambda r: F.array(r, r * 100)))
    nearest = F.array_min(F.transform(rates, lambda r: F.struct(F.abs(r - t).alias("d"), r.alias("r"))))["r"]
    ways = {
        "ratio": F.when(n >= 2, a / tiny(b)).when(n == 1, a), "sum": F.when(n >= 1, total), "difference": F.when(n >= 2, a - b),
        "average": F.when(n >= 1, total / n), "growth": F.when(n >= 2, nearest).when(n == 1, a),
    }
    made = F.lit(None).cast("double")
    for way, words in reversed(RECOMPUTE):
        made = F.when(any_of(*[F.contains(op, F.lit(w)) for w in words]), ways[way]).otherwise(made)
    near = lambda c: F.abs(c - t) <= F.greatest(0.02 * F.greatest(F.abs(c), F.abs(t)), F.lit(1e-6))
    follows = near(made) | ((made > 0) & (made < 1) & near(made * 100)) | ((F.abs(made) > 1) & near(made / 100))
    printed = F.exists(amounts_in(code), lambda v: F.abs(v - t) < 1e-6)
    return F.when(t.isNull(), True).when(made.isNotNull(), follows).otherwise(printed)


def verified_at(items: DataFrame, steps: DataFrame, depth: int = 2) -> DataFrame:
    """items with `at`, the first step that verifies each; null if none does.

    items: (sq, item, pos, kind, value, weight, tables array, inputs array, operation); steps: (sq, step, text, code,
    sources array, tool, success). A derived item also needs its inputs verified before it: at an earlier step, or at
    the same one by an item that stands before. depth: how far derived items may rest on derived ones.
    """
    good = steps.where("success")
    # Texts are read once a step and values once an item, before they meet; pairs only compare what was found.
    sought = items.where("kind != 'derived_value'").select("sq", "item", "tables", needle(F.col("kind"), F.col("value")).alias("sought"))
    shown = good.select("sq", "step", "sources", F.array(haystack(F.col("text")), haystack(F.col("code"))).alias("hay"))
    raw = sought.join(shown, "sq").where(source_match(F.col("tables"), F.col("sources")) & F.exists("hay", lambda h: shows(h, F.col("sought"))))
    known = raw.groupBy("sq", "item").agg(F.min("step").alias("at"))
    places = items.select("sq", F.col("item").alias("input"), F.col("pos").alias("ipos"), amount(F.col("value")).alias("number"))
    derived = items.where("kind = 'derived_value'")
    seen = derived.join(good, "sq").where(source_match(F.col("tables"), F.col("sources")))
    for _ in range(depth):
        rests = derived.select("sq", "item", "pos", F.posexplode_outer("inputs").alias("k", "input")).join(places, ["sq", "input"], "left").join(known.withColumnRenamed("item", "input"), ["sq", "input"], "left")
        # An input that stands behind its item counts from the step after.
        ready = rests.groupBy("sq", "item").agg(
            F.max(F.col("at") + (F.col("ipos") > F.col("pos")).cast("int")).alias("from"), F.count_if(F.col("input").isNotNull() & F.col("at").isNull()).alias("open"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("k", "number")))), lambda x: x["number"]).alias("numbers"),
        ).where("open = 0")
        said = F.concat_ws(" ", "text", "code")
        holds = operator_match(F.col("operation"), said, F.col("tool")) & result_match(F.col("value"), F.col("operation"), F.col("numbers"), F.col("code"))
        later = seen.join(ready, ["sq", "item"]).where(F.col("step") >= F.coalesce("from", F.lit(0))).where(holds).groupBy("sq", "item").agg(F.min("step").alias("at"))
        known = known.unionByName(later).groupBy("sq", "item").agg(F.min("at").alias("at"))
    return items.join(known, ["sq", "item"], "left")


def coverage(verified: DataFrame) -> DataFrame:
    """(sq, step, coverage, gain) at each step that verifies something; shares of the weight of all items."""
    total = verified.groupBy("sq").agg(F.sum("weight").alias("all"))
    per = verified.where("at is not null").groupBy("sq", F.col("at").alias("step")).agg(F.sum("weight").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("sq").orderBy("step"))
    return per.join(total, "sq").select("sq", "step", (upto / F.col("all")).alias("coverage"), (F.col("w") / F.col("all")).alias("gain"))


def claim_parts(text: Column) -> Column:
    """What claims and points are compared by: struct<given, form, numbers>."""
    return F.struct((F.coalesce(text, F.lit("")) != "").alias("given"), match_form(text).alias("form"), F.array_distinct(amounts_in(text)).alias("numbers"))


def parts_confidence(claim: Column, point: Column) -> Column:
    """How surely a claim says what a point asks, of their parts."""
    c, p, x, y = claim["form"], point["form"], claim["numbers"], point["numbers"]
    common = F.size(F.array_intersect(x, y))
    return (
        F.when(~claim["given"] | (p == ""), 0.0).when(c == p, 1.0).when((F.length(c) >= 4) & F.contains(p, c), 0.9).when((F.length(p) >= 4) & F.contains(c, p), 0.8)
        .when((F.size(y) > 0) & (common >= F.size(y)), 0.95).when(common > 0, 0.7).when((F.length(p) >= 8) & F.contains(c, F.left(p, F.lit(12))), 0.6).otherwise(0.0)
    )


def claim_confidence(claim: Column, point: Column) -> Column:
    """How surely a claim says what a point asks: equal, one in the other, numbers shared, first 12 characters held; 0 if none."""
    return parts_confidence(claim_parts(claim), claim_parts(point))


def best_claims(points: DataFrame, claims: DataFrame, key: str = "sq") -> DataFrame:
    """points (key, point_no, point) with the number and confidence of the best claim (key, claim_no, claim), the first of equals.

    Texts are read once each, before points meet claims; pairs compare what was found and are folded where they are made.
    """
    asked = points.select(key, "point_no", claim_parts(F.col("point")).alias("p"))
    told = claims.select(key, "claim_no", claim_parts(F.col("claim")).alias("c"))
    scored = asked.join(told, key, "left").withColumn("confidence", F.when(F.col("c").isNotNull(), parts_confidence(F.col("c"), F.col("p"))).otherwise(0.0))
    best = F.max_by("claim_no", F.struct("confidence", -F.col("claim_no")))
    return scored.groupBy(key, "point_no").agg(F.max("confidence").alias("confidence"), F.when(F.max("confidence") > 0, best).alias("claim_no"))


def answer_reward(right: Column, grounded: Column, weight: Column, bad_format: Column, extras: Column) -> Column:
    """An aggregate over points: the weight of those right and grounded, less penalties, within -1 and 1."""
    score = F.sum(weight * (right & grounded).cast("int")) / F.greatest(F.sum(weight), F.lit(1e-8))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score - F.max(bad_format.cast("int")) - 0.5 * F.max(extras)))
