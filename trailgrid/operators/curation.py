"""Cleaning of recorded steps, checks of tool calls against their declared parameters, malformed calls, and export.

Steps are array<struct<type, plan, calls array<struct<id, name, arguments>>, observations array<struct<id, content>>, ...>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import any_of, same_answer, strip
from ..functions.checks import call_signature, unseen_numbers
from ..functions.code import presentation, presented_answers

#: Marks of an infrastructure error in a result; clauses of a plan that speak of one; openings that only follow one.
ERROR_MARKS = ("BFloat16", "ScalarType")
ERROR_CLAUSES = "(?i)BFloat16|ScalarType|Got unsupported|工具执行错误|出现了错误|出现错误"
RECOVERY_OPENINGS = (r"^换[一另]种(方式|方法)[：:，,]*\s*", r"^尝试[重另]新[执行]*[：:，,]*\s*", r"^重试[：:，,]*\s*", r"^改用其他方式[：:，,]*\s*")
#: Parameters that tell a tool whose name is missing, in the order tried.
TOOL_BY_PARAMETER = ((("command", "cwd"), "cmd_executor"), (("file_path", "n", "start"), "table_head_reader"), (("query", "folder_path"), "table_selector"))
_NO_TOOL = ("parameter", "function", "function_calls", "invoke", "tool_call", "tool")
_PARAMETERS = (r'<parameter\s+name\s*=\s*"([^"]*)"\s*>(.*?)</parameter\s*>', r'<param\s+name\s*=\s*"([^"]*)"\s*>(.*?)</param\s*>', r"<parameter\s*=\s*(\S+?)\s*>(.*?)</parameter\s*>", r"<parameter\s+(\w+)\s*>(.*?)</parameter\s*>")
#: Kinds of JSON values, by declared type: the forms in which Spark names them.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def clean_plan(plan: Column) -> Column:
    """A plan without the clauses that speak of infrastructure errors and without openings that only follow such."""

    def sentence(s: Column) -> Column:
        kept = F.filter(F.split(strip(s), r"(?<=[，,；;：:])\s*"), lambda c: (strip(c) != "") & ~c.rlike(ERROR_CLAUSES))
        out = strip(F.array_join(kept, ""))
        for opening in RECOVERY_OPENINGS:
            out = F.regexp_replace(out, opening, "")
        return out

    joined = strip(F.array_join(F.transform(F.split(plan, r"(?<=[。！？.!?])\s*"), sentence), ""))
    return F.regexp_replace(F.regexp_replace(joined, r"[，,]\s*[，,]", "，"), r"^[，,；;：:]\s*", "")


def without_failed_calls(steps: Column, marks: tuple[str, ...] = ERROR_MARKS) -> Column:
    """Steps without the calls whose observation holds a mark; a step that loses all its calls goes.

    The plan of a step that lost some, and of a clean tool step right after one that went, is cleaned. Observations
    without an id are never matched; null content counts as empty.
    """
    hit = lambda o: (F.coalesce(o["id"], F.lit("")) != "") & any_of(*[F.contains(F.coalesce(o["content"], F.lit("")), F.lit(m)) for m in marks])
    bad = lambda s: F.when(s["type"] == "tool_call", F.transform(F.filter(s["observations"], hit), lambda o: o["id"])).otherwise(F.array().cast("array<string>"))
    stays = lambda s: F.filter(s["calls"], lambda c: ~F.array_contains(bad(s), F.coalesce(c["id"], F.lit(""))))
    seen = F.transform(steps, lambda s: F.struct(s.alias("s"), F.coalesce(F.size(bad(s)) > 0, F.lit(False)).alias("bad"), stays(s).alias("calls")))
    gone = lambda x: x["bad"] & (F.size(x["calls"]) == 0)

    def mend(x: Column, i: Column) -> Column:
        s, before = x["s"], F.get(seen, i - 1)
        ids = F.transform(x["calls"], lambda c: F.coalesce(c["id"], F.lit("")))
        after_gap = (s["type"] == "tool_call") & F.coalesce(gone(before), F.lit(False))
        plan = F.when(x["bad"] | after_gap, clean_plan(s["plan"])).otherwise(s["plan"])
        observations = F.when(x["bad"], F.filter(s["observations"], lambda o: F.array_contains(ids, F.coalesce(o["id"], F.lit(""))))).otherwise(s["observations"])
        calls = F.when(x["bad"], x["calls"]).otherwise(s["calls"])
        return F.struct(gone(x).alias("gone"), s.withField("plan", plan).withField("calls", calls).withField("observations", observations).alias("s"))

    return F.transform(F.filter(F.transform(seen, mend), lambda x: ~x["gone"]), lambda x: x["s"])


def without_orphans(steps: Column) -> Column:
    """Steps without tool steps that have neither calls nor observations."""
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    return F.filter(steps, lambda s: ~((F.coalesce(s["type"], F.lit("")) == "tool_call") & empty(s["calls"]) & empty(s["observations"])))


def without_presentations(records: DataFrame, code_tool: str = "python_code_executor") -> DataFrame:
    """records (..., steps, final struct<answer, data_source array>) whose steps lose the calls that only print the final answer.

    A call goes if its code only presents, holds an answer, and that agrees with the final one leniently; a tool step
    without calls goes with it. Tool steps keep the observations of the calls that stay. A null final answer keeps all calls.
    """
    code = lambda c: F.when(c["name"] == code_tool, F.get_json_object(c["arguments"], "$.code"))
    codes = F.transform("steps", lambda s: F.when(s["type"] == "tool_call", F.transform(s["calls"], code)))
    told = records.withColumn("_told", presented_answers(codes))
    same = lambda a: a.isNotNull() & F.coalesce(same_answer(F.from_json(a, "answer string, data_source array<string>"), F.col("final"), False), F.lit(False))

    def keep(s: Column, i: Column) -> Column:
        answers = F.get("_told", i)
        calls = F.filter(s["calls"], lambda c, j: ~same(F.get(answers, j)))
        ids = F.transform(calls, lambda c: F.coalesce(c["id"], F.lit("")))
        seen = F.filter(s["observations"], lambda o: (F.coalesce(o["id"], F.lit("")) != "") & F.array_contains(ids, o["id"]))
        tool = F.coalesce(s["type"] == "tool_call", F.lit(False))
        return F.when(tool & (F.coalesce(F.size(calls), F.lit(0)) <= 0), None).when(tool, s.withField("calls", calls).withField("observations", seen)).otherwise(s)

    return told.withColumn("steps", F.filter(F.transform("steps", keep), lambda s: s.isNotNull())).drop("_told")


def call_issues(calls: DataFrame, observations: DataFrame | None, schema: dict[str, dict[str, dict]]) -> DataFrame:
    """(scope, call_id, issue) of tool calls (scope, step, pos, call_id, tool, arguments JSON) and their observations (scope, step, call_id).

    schema: tool to parameter to {type, required, enum}. Without observations calls need none. Issues: no tool, unknown
    tool, no id, repeated id, bad arguments, extra:p, missing:p, type:p, enum:p, no observation, observation without id,
    repeated observation, no call. A call without a known tool and an id is not looked at further.
    """
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    named = F.when(blank(F.col("tool")), "no tool").when(~F.col("tool").isin(*schema), "unknown tool").when(blank(F.col("call_id")), "no id")
    value, keys = F.try_parse_json("arguments"), F.json_object_keys("arguments")
    ok = keys.isNotNull() & value.isNotNull()
    found = []
    for tool, parameters in schema.items():
        mine = ok & (F.col("tool") == tool)
        found.append(F.when(mine, F.transform(F.array_except(keys, F.array(*map(F.lit, parameters)).cast("array<string>")), lambda k: F.concat(F.lit("extra:"), k))))
        tests = []
        for p, told in parameters.items():
            has, at = mine & F.array_contains(keys, p), f"$['{p}']"
            if told.get("required"):
                tests.append(F.when(mine & ~F.array_contains(keys, p), f"missing:{p}"))
            if (form := TYPES.get(told.get("type", "string"))) is not None:
                kind = F.schema_of_variant(F.try_variant_get(value, at, "variant"))
                tests.append(F.when(has & ~kind.rlike(f"^({form})$"), f"type:{p}"))
            if told.get("enum"):
                tests.append(F.when(has & ~F.coalesce(F.try_variant_get(value, at, "string").isin(*told["enum"]), F.lit(False)), f"enum:{p}"))
        if tests:
            found.append(F.when(mine, F.array_compact(F.array(*tests))))
    none = F.array().cast("array<string>")
    again = F.row_number().over(Window.partitionBy("scope", "usable", "call_id").orderBy("step", "pos")) > 1
    checked = calls.withColumn("named", named).withColumn("usable", F.col("named").isNull()).withColumn("again", F.col("usable") & again)
    checked = checked.withColumn(
        "issues", F.when(~F.col("usable"), F.array("named")).otherwise(F.concat(F.when(F.col("again"), F.array(F.lit("repeated id"))).otherwise(none), F.when(~F.coalesce(ok, F.lit(False)), F.array(F.lit("bad arguments"))).otherwise(none), *[F.coalesce(x, none) for x in found]))
    )
    out = checked.select("scope", "call_id", F.explode("issues").alias("issue"))
    if observations is None:
        return out
    # One aggregation over calls and observations together finds both kinds of strays.
    seen = observations.withColumn("n", F.row_number().over(Window.partitionBy("scope", "step", "call_id").orderBy(F.lit(1))))
    seen = seen.withColumn("issue", F.when(blank(F.col("call_id")), "observation without id").when(F.col("n") > 1, "repeated observation"))
    both = checked.where("usable").select("scope", "call_id", F.lit(1).alias("c"), F.lit(0).alias("o")).unionAll(seen.where("issue is null").select("scope", "call_id", F.lit(0), F.lit(1)))
    strays = both.groupBy("scope", "call_id").agg(F.max("c").alias("c"), F.max("o").alias("o")).where("c != o").select("scope", "call_id", F.when(F.col("c") == 1, "no observation").otherwise("no call").alias("issue"))
    return out.unionAll(seen.where("issue is not null").select("scope", "call_id", "issue")).unionAll(strays)


def loose_call(text: Column) -> Column:
    """struct<name, arguments map<string,string>> of what stands in a call's tags: JSON, or one of many tag layouts; null if no tool is told.

    A whole JSON object alone decides; otherwise the name comes from the first layout that gives one, the arguments
    from a JSON body or the first parameter layout that matches, the last of equal parameters counting. A call
    without a name takes it from its parameters. Values of JSON arguments are texts.
    """
    raw = strip(F.coalesce(text, F.lit("")))
    some = lambda x: F.nullif(strip(x), F.lit(""))
    part = lambda pattern, k=1: some(F.regexp_extract(raw, "(?s)" + pattern, k))
    as_map = lambda j: F.when(F.json_object_keys(j).isNotNull(), F.from_json(j, "map<string,string>"))
    body = F.coalesce(F.when(F.try_parse_json(raw).isNotNull(), raw), F.when(F.try_parse_json(part(r"^(\{.*\})")).isNotNull(), part(r"^(\{.*\})")))
    key = lambda *names: F.coalesce(*[some(F.get_json_object(body, f"$.{n}")) for n in names])
    none = F.create_map().cast("map<string,string>")

    hybrid, hybrid_body = part(r"<function\s+(\w+)\s*>(.*?)</function\s*>"), part(r"<function\s+(\w+)\s*>(.*?)</function\s*>", 2)
    tag, tag_body = part(r"<(\w+)\s*>(.*?)</\1\s*>"), part(r"<(\w+)\s*>(.*?)</\1\s*>", 2)
    tag = F.when(~F.lower(tag).isin(*_NO_TOOL[:5]), tag)
    spoken = part(r"<function\s*>\s*(\w+)")
    spoken = F.when(~F.lower(spoken).isin(*_NO_TOOL[:3]), spoken)
    first = part(r"<(\w+)\s*>")
    first = F.when(~F.lower(first).isin(*_NO_TOOL[:4], "tool"), first)
    pairs = F.array().cast("array<struct<key:string,value:string>>")
    for pattern in reversed(_PARAMETERS):
        found = [F.regexp_extract_all(raw, F.lit("(?s)" + pattern), F.lit(k)) for k in (1, 2)]
        both = F.zip_with(*found, lambda key, value: F.struct(strip(key).alias("key"), strip(value).alias("value")))
        pairs = F.when(F.size(found[0]) > 0, both).otherwise(pairs)
    back = F.reverse(pairs)
    names = F.transform(back, lambda x: x["key"])
    parameters = F.map_from_entries(F.reverse(F.filter(back, lambda x, i: F.array_position(names, x["key"]) == i + 1)))
    told = F.coalesce(tag, spoken, part(r"<tool\s*=\s*(\S+?)\s*>"), part(r'<tool\s+name\s*=\s*"([^"]*)"\s*>'), part(r'<invoke\s+name\s*=\s*"([^"]*)"'), part(r'<function\s+name\s*=\s*"([^"]*)"'), part(r"<name>(.*?)</name>"), first)
    for keys, tool in TOOL_BY_PARAMETER:
        told = F.coalesce(told, F.when(any_of(*[F.map_contains_key(parameters, k) for k in keys]), tool))
    call = lambda name, arguments: F.when(name.isNotNull(), F.struct(name.alias("name"), F.coalesce(arguments, none).alias("arguments")))
    tagged_json = F.try_parse_json(tag_body).isNotNull()
    return (
        F.when(body.isNotNull(), call(key("tool", "name"), as_map(key("params", "arguments"))))
        .when(hybrid.isNotNull(), call(hybrid, as_map(hybrid_body)))
        .when(tag.isNotNull() & tagged_json, call(tag, as_map(tag_body)))
        .otherwise(call(told, parameters))
    )


def dialogs(records: DataFrame) -> DataFrame:
    """(sample, turns): the sub-questions of a sample as one nested row, by id. records: (sample, sq, user, memory_before, steps, memory_after)."""
    turn = F.struct("sq", "user", "memory_before", "steps", "memory_after")
    return records.groupBy("sample").agg(F.array_sort(F.collect_list(turn), lambda a, b: F.when(a["sq"] < b["sq"], -1).when(a["sq"] > b["sq"], 1).otherwise(0)).alias("turns"))


def gate_failures(records: DataFrame) -> DataFrame:
    """records (sample, sq, user, steps, answer, tables array) with `failures`: what keeps a sub-question out of the export.

    Gates: a question, a last step that answers, an answer, a source table, and no observation with an error mark.
    """
    empty = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    marked = F.exists("steps", lambda s: F.exists(s["observations"], lambda o: any_of(*[F.contains(o["content"], F.lit(m)) for m in ERROR_MARKS])))
    last = F.coalesce(F.try_element_at("steps", F.lit(-1))["type"] == "final_answer", F.lit(False))
    tests = {"no question": empty("user"), "no final step": ~last, "no answer": empty("answer"), "no source": F.coalesce(F.size("tables"), F.lit(0)) <= 0, "marked error": F.coalesce(marked, F.lit(False))}
    return records.withColumn("failures", F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()])))


def decompose(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """messages (trace, pos, ...) with `sq`, the sub-question whose span they lie in; those before the first anchor go.

    anchors (trace, sq, at): the message that asks a sub-question, null if none does; anchors of a trace rise with sq.
    A span ends before the next matched anchor. One window over the messages, which the anchors only mark.
    """
    marks = anchors.where("at is not null").groupBy("trace", F.col("at").alias("pos")).agg(F.max("sq").alias("asked"))
    spans = Window.partitionBy("trace").orderBy("pos")
    marked = messages.join(marks, ["trace", "pos"], "left")
    return marked.withColumn("sq", F.last("asked", ignorenulls=True).over(spans)).drop("asked").where("sq is not null")


def unmatched(anchors: DataFrame) -> DataFrame:
    """(trace, sq) of sub-questions that no message asks, in traces where some message asks one."""
    any_found = F.max(F.col("at").isNotNull()).over(Window.partitionBy("trace"))
    return anchors.withColumn("found", any_found).where("found and at is null").select("trace", "sq")


def revalidate(records: DataFrame, code_tool: str = "python_code_executor") -> DataFrame:
    """(dialog, sq, issue) of cleaned records (dialog, sq, steps, answer, old_answer), whose observations also have name and success.

    Issues: empty steps, no final step, answer changed, unknown type, no calls, no observations, observation without id,
    call without observation, observation without call, not recovered (an IndexError or NameError that no later success
    of the same tool follows), repeated call, repeated observation (ids of a dialog), presentation call, numbers not
    observed (of the answer's numbers some stand in no observation). A null old
    answer is not compared. One row for each step or call with the issue.
    """
    ids = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<struct<id:string>>")), lambda x: F.coalesce(x["id"], F.lit(""))), lambda i: i != "")
    none, size = F.array().cast("array<string>"), lambda a: F.coalesce(F.size(a), F.lit(0))
    bare = lambda a: F.transform(a, lambda x: F.struct(x["id"].alias("id")))
    fails = lambda o: F.coalesce(o["content"].rlike("IndexError|NameError"), F.lit(False))
    works = lambda o: F.coalesce(o["success"], F.lit(False)) | F.coalesce(o["content"].rlike(r"\[SUCCESS\]|\[Success\]"), F.lit(False))

    def of_step(s: Column, i: Column) -> Column:
        later = F.slice("steps", i + 2, F.size("steps"))
        mended = lambda o: F.exists(later, lambda t: (t["type"] == "tool_call") & F.coalesce(F.exists(t["observations"], lambda p: works(p) & (F.coalesce(p["name"], F.lit("")) != "") & (p["name"] == o["name"])), F.lit(False)))
        lost = F.transform(F.filter(F.coalesce(s["observations"], F.array().cast(observation)), lambda o: fails(o) & ~F.coalesce(mended(o), F.lit(False))), lambda o: F.lit("not recovered"))
        blank = F.transform(F.filter(F.coalesce(s["observations"], F.array().cast(observation)), lambda o: F.coalesce(o["id"], F.lit("")) == ""), lambda o: F.lit("observation without id"))
        calls, seen = ids(bare(s["calls"])), ids(bare(s["observations"]))
        tests = F.array_compact(
            F.array(
                F.when(size(s["calls"]) <= 0, "no calls"), F.when(size(s["observations"]) <= 0, "no observations"),
                F.when(F.size(F.array_except(calls, seen)) > 0, "call without observation"), F.when(F.size(F.array_except(seen, calls)) > 0, "observation without call"),
            )
        )
        return F.when(s["type"] == "final_answer", none).when(F.coalesce(s["type"] == "tool_call", F.lit(False)), F.concat(tests, lost, blank)).otherwise(F.array(F.lit("unknown type")))

    observation = next(f.dataType for f in records.schema["steps"].dataType.elementType if f.name == "observations").simpleString()
    final = F.exists("steps", lambda s: F.coalesce(s["type"] == "final_answer", F.lit(False)))
    whole = F.array_compact(F.array(F.when(~final, "no final step"), F.when(F.col("old_answer").isNotNull() & ~F.col("answer").eqNullSafe(F.col("old_answer")), "answer changed")))
    own = F.when(size(F.col("steps")) <= 0, F.array(F.lit("empty steps"))).otherwise(F.concat(whole, F.flatten(F.transform("steps", of_step))))
    issues = records.select("dialog", "sq", F.explode(own).alias("issue"))
    steps = records.select("dialog", "sq", F.posexplode("steps").alias("step", "s")).where("s.type = 'tool_call'")
    calls = steps.select("dialog", "sq", "step", F.explode("s.calls").alias("c"))
    used = calls.select("dialog", "sq", "step", F.lit("repeated call").alias("issue"), F.col("c.id").alias("id")).unionAll(steps.select("dialog", "sq", "step", F.lit("repeated observation"), F.explode(F.transform("s.observations", lambda o: o["id"]))))
    again = used.where("coalesce(id, '') != ''").withColumn("n", F.row_number().over(Window.partitionBy("dialog", "issue", "id").orderBy("sq", "step"))).where("n > 1")
    seen = F.flatten(F.transform(F.coalesce("steps", F.array().cast(records.schema["steps"].dataType.simpleString())), lambda s: F.coalesce(F.transform(s["observations"], lambda o: F.coalesce(o["content"], F.lit(""))), none)))
    unseen = records.where(F.size(unseen_numbers(F.col("answer"), seen)) > 0).select("dialog", "sq", F.lit("numbers not observed").alias("issue"))
    shown = calls.where(F.col("c.name") == code_tool).where(presentation(F.get_json_object("c.arguments", "$.code"))["only_presents"])
    return issues.unionAll(again.select("dialog", "sq", "issue")).unionAll(unseen).unionAll(shown.select("dialog", "sq", F.lit("presentation call")))


def conflicting_calls(steps: Column) -> Column:
    """Ids that stand on calls of different name or arguments, or on different observations, sorted."""
    calls = F.flatten(F.transform(steps, lambda s: F.coalesce(s["calls"], F.array().cast("array<struct<id:string,name:string,arguments:string>>"))))
    seen = F.flatten(F.transform(steps, lambda s: F.coalesce(F.transform(s["observations"], lambda o: F.struct(o["id"].alias("id"), o["content"].alias("content"))), F.array().cast("array<struct<id:string,content:string>>"))))
    ids = F.array_distinct(F.filter(F.concat(F.transform(calls, lambda c: c["id"]), F.transform(seen, lambda o: o["id"])), lambda i: F.coalesce(i, F.lit("")) != ""))
    kinds = lambda a, i, body: F.size(F.array_distinct(F.transform(F.filter(a, lambda x: x["id"] == i), body)))
    differs = lambda i: (kinds(calls, i, lambda c: call_signature(c["name"], c["arguments"])) > 1) | (kinds(seen, i, lambda o: F.coalesce(o["content"], F.lit(""))) > 1)
    return F.array_sort(F.filter(ids, differs))


def unique_calls(steps: Column) -> Column:
    """Steps without calls whose id an earlier call has, nor their observations; a step that loses all its calls goes. Blank ids all stay."""
    ids = lambda s: F.transform(F.coalesce(s["calls"], F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: F.coalesce(c["id"], F.lit("")))

    def kept(s: Column, i: Column) -> Column:
        before = F.flatten(F.transform(F.slice(steps, F.lit(1), i), ids))
        fresh = lambda x, n: (F.coalesce(x["id"], F.lit("")) == "") | (~F.array_contains(before, x["id"]) & (F.array_position(ids(s), x["id"]) == n + 1))
        calls = F.filter(s["calls"], fresh)
        # An observation goes with its call; the first of an id stays with the first call.
        observed = F.filter(s["observations"], lambda o: (F.coalesce(o["id"], F.lit("")) == "") | ~F.array_contains(before, o["id"]))
        return s.withField("calls", calls).withField("observations", observed)

    had = F.transform(steps, lambda s: F.coalesce(F.size(s["calls"]), F.lit(0)) > 0)
    made = F.zip_with(F.transform(steps, kept), had, lambda s, h: F.struct(s.alias("s"), h.alias("h")))
    return F.transform(F.filter(made, lambda x: ~x["h"] | (F.size(x["s"]["calls"]) > 0)), lambda x: x["s"])


def renumbered(records: DataFrame) -> DataFrame:
    """records (dialog, sq, steps) with call ids call_<dialog>_<sq>_<number>, numbers running through a dialog from 0 with three digits or more; observations follow their calls."""
    size = lambda s: F.coalesce(F.size(s["calls"]), F.lit(0))
    total = F.aggregate("steps", F.lit(0), lambda n, s: n + size(s))
    counted = records.withColumn("_n", F.coalesce(total, F.lit(0)))
    base = F.sum("_n").over(Window.partitionBy("dialog").orderBy("sq")) - F.col("_n")
    name = lambda n: F.concat(F.lit("call_"), F.col("dialog").cast("string"), F.lit("_"), F.col("sq").cast("string"), F.lit("_"), F.format_string("%03d", n.cast("long")))

    def step(s: Column, i: Column) -> Column:
        start = F.col("_base") + F.aggregate(F.slice("steps", F.lit(1), i), F.lit(0), lambda n, x: n + size(x))
        old = F.transform(s["calls"], lambda c: F.coalesce(c["id"], F.lit("")))
        calls = F.transform(s["calls"], lambda c, k: c.withField("id", name(start + k)))
        seen = F.transform(s["observations"], lambda o: o.withField("id", F.when((F.coalesce(o["id"], F.lit("")) != "") & (F.array_position(old, o["id"]) > 0), name(start + F.array_position(old, o["id"]) - 1)).otherwise(o["id"])))
        return s.withField("calls", calls).withField("observations", seen)

    return counted.withColumn("_base", base).withColumn("steps", F.transform("steps", step)).drop("_n", "_base")


def cleaned(records: DataFrame, code_tool: str = "python_code_executor") -> DataFrame:
    """records (dialog, sq, steps, final) through all stages: conflicting ids told, repeated, failed and presentation calls removed, orphans dropped, calls numbered anew.

    Whoever wants the last stage calls `revalidate` on the result.
    """
    made = records.withColumn("conflicts", conflicting_calls(F.col("steps"))).withColumn("steps", unique_calls(F.col("steps")))
    made = without_presentations(made.withColumn("steps", without_failed_calls(F.col("steps"))), code_tool)
    return renumbered(made.withColumn("steps", without_orphans(F.col("steps"))))


def points_covered(best: DataFrame, least: float = 0.6) -> DataFrame:
    """(sq, points, covered, coverage) of points with their best claims (sq, confidence): a judge's stand-in that needs no model."""
    hit = F.count_if(F.col("confidence") >= least)
    return best.groupBy("sq").agg(F.count("*").alias("points"), hit.alias("covered"), (hit / F.count("*")).alias("coverage"))
