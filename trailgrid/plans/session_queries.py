"""Queries of sessions, checks of agent texts, grids, caches and plug-ins over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checks, claims, plugins
from ..functions.text import number
from ..operators import grid, retrieval, sessions
from ..sources import tables
from ..sources.tables import lines, read
from .registry import query


def _say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _messages(s, d):
    return read(s, d, "conversations").select(F.col("conv_id").alias("trace"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))


@query("valid_summaries", "select c_custkey from customer where c_custkey % 5 > 0 and c_acctbal >= c_nationkey * 100")
def valid_summaries(s, d):
    """Balances stand for times of change; files of every fifth customer are gone."""
    c = read(s, d, "customer")
    kept = sessions.valid_summaries(c.select(F.col("c_custkey").cast("string").alias("path"), F.col("c_acctbal").cast("double").alias("modified")), c.where("c_custkey % 5 > 0").select(F.col("c_custkey").cast("string").alias("path"), (F.col("c_nationkey") * 100.0).alias("modified")))
    return kept.select(F.col("path").cast("long").alias("c_custkey"))


@query("unexpired", "select event_id from events where ts >= (select max(ts) from events) - interval '36 hours'")
def unexpired(s, d):
    e = read(s, d, "events").withColumnRenamed("ts", "made")
    now = F.lit(e.agg(F.max("made")).first()[0])
    return sessions.unexpired(e, now, 1.5).select("event_id")


@query("snapshot_changes", "select o_orderkey, case when o_orderkey % 4 = 0 then 'new' when o_orderkey % 4 = 1 then 'gone' else 'changed' end as change from orders where o_orderkey % 4 <> 2 or o_custkey % 2 = 0")
def snapshot_changes(s, d):
    o, k = read(s, d, "orders"), F.col("o_orderkey")
    at = lambda df, add: df.select(k.cast("string").alias("path"), F.floor("o_totalprice").alias("size"), (F.col("o_custkey") + add).alias("modified"))
    after = at(o.where("o_orderkey % 4 <> 1"), F.when((k % 4 == 3) | (F.col("o_custkey") % 2 == 0), 1).otherwise(0))
    return sessions.snapshot_changes(at(o.where("o_orderkey % 4 <> 0"), F.lit(0)), after).select(F.col("path").cast("long").alias("o_orderkey"), "change")


@query("old_reasoning", "with l as (select *, max(turn) filter (where role = 'user' and coalesce(text, '') <> '' and not starts_with(text, '[Tool Execution Result')) over (partition by conv_id) as last from conversations) select conv_id, turn, case when turn > coalesce(last, -1) then role end as reasoning from l")
def old_reasoning(s, d):
    m = _messages(s, d).withColumns({"reasoning": F.col("role"), "signature": F.col("role")})
    return sessions.without_old_reasoning(m).select(F.col("trace").alias("conv_id"), F.col("pos").alias("turn"), "reasoning")


@query("carried_signatures", """with m as (select *, case when role = 'assistant' and turn % 4 = 1 then 's' || turn end as sig, row_number() over (partition by conv_id order by turn desc) <= 3 as kept from conversations),
 l as (select *, arg_max(sig, turn) filter (where not kept and sig is not null) over (partition by conv_id) as lost, bool_or(kept and sig is not null) over (partition by conv_id) as has, min(turn) filter (where kept and role = 'assistant') over (partition by conv_id) as first from m)
 select conv_id, turn, case when not has and turn = first then coalesce(lost, sig) else sig end as signature from l where kept""")
def carried_signatures(s, d):
    m = _messages(s, d).withColumn("signature", F.when((F.col("role") == "assistant") & (F.col("pos") % 4 == 1), _say("s", F.col("pos"))))
    m = m.withColumn("keep", F.row_number().over(W.partitionBy("trace").orderBy(F.desc("pos"))) <= 3)
    return sessions.carried_signature(m, F.col("keep")).select(F.col("trace").alias("conv_id"), F.col("pos").alias("turn"), "signature")


@query("accumulated_calls", """with c as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as turn from events), f as (select *, case when lag(event_type) over (partition by user_id order by turn) = event_type then 0 else 1 end as fresh from c), i as (select *, sum(fresh) over (partition by user_id order by turn) as entry from f)
 select user_id, entry::bigint as entry, count(*) as calls, arg_max(event_id, turn) as last from i group by 1, 2""")
def accumulated_calls(s, d):
    """Types of events stand for system prompts."""
    turn = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    calls = read(s, d, "events").select(F.col("user_id").alias("trace"), turn.alias("turn"), F.col("event_type").alias("system"), F.array("props").alias("messages"), F.col("event_id").alias("response"))
    return sessions.accumulated(calls).select(F.col("trace").alias("user_id"), "entry", "calls", F.col("response").alias("last"))


@query("turn_records", """with t as (select user_id, ts, event_type, sum((event_type = 'view')::int) over (partition by user_id order by ts, event_id) as turn from events)
 select user_id, turn::bigint as turn, count(*) filter (where event_type in ('click', 'error')) as steps, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as latency, bool_or(event_type = 'purchase') as success from t group by 1, 2""")
def turn_records(s, d):
    turn = F.sum((F.col("event_type") == "view").cast("long")).over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when(F.col("event_type").isin("click", "error"), "step").when(F.col("event_type") == "purchase", "answer").otherwise("question")
    e = read(s, d, "events").select(F.col("user_id").alias("trace"), turn.alias("turn"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))
    return sessions.turn_records(e).select(F.col("trace").alias("user_id"), "turn", "steps", "latency", "success")


@query("repair_ids", "select l_orderkey, l_linenumber, 'repair_call_2_' || printf('%03d', row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) - 1) as call_id, 'call_' || printf('%03d', row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber)) as new_id from lineitem")
def repair_ids(s, d):
    """Calls of a supplier; past 999 numbers have four digits."""
    calls = read(s, d, "lineitem").select(F.col("l_suppkey").alias("scope"), F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("pos"))
    return sessions.sequential_ids(sessions.repair_ids(calls, 2)).select(F.col("step").alias("l_orderkey"), F.col("pos").alias("l_linenumber"), "call_id", "new_id")


@query("failure_reasons", "select o_orderkey, case when o_totalprice >= 50000 and o_orderstatus <> 'P' then 'Unknown' else array_to_string(list_filter([case when o_totalprice < 50000 then '- cheap' end, case when o_orderstatus = 'P' then '- open' end], lambda x: x is not null), chr(10)) end as reasons from orders")
def failure_reasons(s, d):
    issues = F.array_compact(F.array(F.when(F.col("o_totalprice") < 50000, "cheap"), F.when(F.col("o_orderstatus") == "P", "open")))
    return sessions.failure_reasons(read(s, d, "orders").select(F.lit(1).alias("sample"), F.col("o_orderkey").alias("sq"), issues.alias("issues"))).select(F.col("sq").alias("o_orderkey"), "reasons")


@query("true_files", "select o_orderkey, case when o_orderkey % 3 = 0 then ['e' || o_custkey] when o_orderkey % 3 = 1 then ['m' || o_custkey] else [] end as files from orders")
def true_files(s, d):
    k = F.col("o_orderkey")
    found = F.when(k % 3 == 0, F.array(_say("e", F.col("o_custkey")))).otherwise(F.array().cast("array<string>"))
    named = F.array(F.struct(F.when(k % 3 < 2, _say("m", F.col("o_custkey"))).otherwise("").alias("name")))
    return read(s, d, "orders").select("o_orderkey", sessions.true_files(found, named).alias("files"))


@query("judged", "select l_orderkey, l_linenumber, l_quantity > 20 and l_discount < 0.08 and l_tax < 0.06 and l_linenumber <= 4 as passes from lineitem")
def judged(s, d):
    points = F.array(*[F.lit(i) for i in range(4)])
    covered = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i % F.when(F.col("l_linenumber") <= 4, 4).otherwise(3))
    missing = F.when(F.col("l_discount") < 0.08, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", sessions.judged(F.col("l_quantity") > 20, covered, missing, points, F.col("l_tax") < 0.06).alias("passes"))


@query("next_contexts", "select conv_id, case conv_id % 3 when 0 then 1 when 1 then 1 + (conv_id % 2) else 1 + count(*) end::bigint as messages from conversations group by conv_id")
def next_contexts(s, d):
    k, mode = F.col("conv_id"), F.element_at(F.array(*map(F.lit, ("reset", "summary", "continue"))), (F.col("conv_id") % 3 + 1).cast("int"))
    c = read(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("h"))
    return c.select("conv_id", F.size(sessions.next_context(mode, F.lit("s"), F.when(k % 2 == 1, "so far").otherwise(" "), F.col("h"))).cast("long").alias("messages"))


@query("latest_evaluations", "select c_custkey, max(o_orderdate) as made, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as price from customer left join orders on o_custkey = c_custkey group by 1")
def latest_evaluations(s, d):
    o = read(s, d, "orders").select(F.col("o_custkey").alias("trace"), F.struct("o_orderdate", "o_orderkey").alias("made"), F.col("o_totalprice").alias("price"))
    return sessions.with_evaluations(read(s, d, "customer").select(F.col("c_custkey").alias("trace")), o).select(F.col("trace").alias("c_custkey"), F.col("made.o_orderdate").alias("made"), "price")


@query("trainer_messages", """with c as (select conv_id, turn, case when role = 'user' then 'tool' else role end as role, case when role = 'assistant' and turn % 3 = 1 then concat_ws(chr(10), nullif(coalesce(text, ''), ''), '<tool_call>' || chr(10) || '{"name": "f' || turn || '", "arguments": {}}' || chr(10) || '</tool_call>') else coalesce(text, '') end as text from conversations), f as (select *, case when role = 'tool' and lag(role) over (partition by conv_id order by turn) = 'tool' then 0 else 1 end as fresh from c), i as (select *, sum(fresh) over (partition by conv_id order by turn) as k from f)
 select conv_id, min(turn) as turn, string_agg(text, chr(10) || chr(10) order by turn) as content from i group by conv_id, k""")
def trainer_messages(s, d):
    from ..sinks.files import call_text

    m = _messages(s, d).withColumn("role", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")))
    calls = F.when((F.col("role") == "assistant") & (F.col("pos") % 3 == 1), F.array(F.struct(_say("f", F.col("pos")).alias("name"), F.lit("{}").alias("arguments"))))
    return sessions.trainer_messages(m.withColumn("calls", calls), call_text).select(F.col("trace").alias("conv_id"), F.col("pos").alias("turn"), "content")


@query("reevaluated", """select o_orderkey, list_filter([case when o_orderkey % 5 = 0 then 'answer is empty' end, case when o_custkey % 4 = 0 then 'data_source is empty' end, case when o_orderkey % 7 = 0 then 'unrecovered errors' end, case when o_orderkey % 3 = 0 then 'no final step' end, case when o_orderkey % 3 = 2 then 'final step is not last' end, case when o_custkey % 4 = 0 or o_custkey % 3 = 0 then 'files not covered' end], lambda x: x is not null) as issues from orders""")
def reevaluated(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    step = lambda t: F.struct(F.lit(t).alias("type"))
    steps = F.when(k % 3 == 0, F.array(step("tool_call"))).when(k % 3 == 1, F.array(step("tool_call"), step("final_answer"))).otherwise(F.array(step("final_answer"), step("tool_call")))
    none = F.array().cast("array<string>")
    rows = read(s, d, "orders").select(
        F.lit(1).alias("sample"), k.alias("sq"), steps.alias("steps"), F.when(k % 5 == 0, "").otherwise("x").alias("answer"), F.when(c % 4 > 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("data_source"),
        F.when(k % 7 == 0, 1).otherwise(0).alias("unrecovered"), F.lit(0).alias("schema_issues"), F.when(c % 3 == 0, F.array(F.lit("c"))).otherwise(F.array(F.lit("a"))).alias("files"), F.array().cast("array<double>").alias("unseen"),
    )
    return sessions.call_reevaluation(rows).select(F.col("sq").alias("o_orderkey"), "issues")


@query("unseen_numbers", "select o_orderkey, case o_orderkey % 4 when 0 then [] when 1 then [(floor(o_totalprice) + 1)::double] when 2 then [-(o_custkey % 90 + 100)::double] else [7.0] end as unseen from orders")
def unseen_numbers(s, d):
    """Answers by k % 4: a price that was seen, one that was not, a fall whose rise was seen, a difference of two seen values (of which only the bare number counts as unseen).

    What is seen beside it has halves, so that no whole price or rate meets it by chance.
    """
    k, price, c = F.col("o_orderkey"), F.floor("o_totalprice"), F.col("o_custkey") % 90 + 100
    answer = F.when(k % 4 == 0, _say("共", price, "元，上年=100")).when(k % 4 == 1, _say("共", price + 1, "元")).when(k % 4 == 2, _say("下降", c, "%")).otherwise("相差 7 个百分点")
    half = lambda *asked: F.when((k % 4).isin(*asked), "").otherwise(".5")
    seen = F.array(_say("total ", price, half(0, 1)), _say("增长", c, half(2), "%"), _say("rates ", c + 1000, ".5 and ", c + 1007, ".5"))
    return read(s, d, "orders").select("o_orderkey", checks.unseen_numbers(answer, seen).alias("unseen"))


@query("speculations", "select o_orderkey, list_filter([case when o_orderkey % 2 = 0 then 0 end, case when o_custkey % 3 = 0 then 1 end, case when o_orderkey % 5 = 0 then 2 end], lambda x: x is not null) as guesses from orders")
def speculations(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    entries = F.array(F.when(k % 2 == 0, _say("订单", k, "可能与价格有关")).otherwise("可能"), F.when(c % 3 == 0, _say(c, "可能意味着增长")).otherwise(c.cast("string")), F.when(k % 5 == 0, "这表明成本导致下降").otherwise("导致"))
    return read(s, d, "orders").select("o_orderkey", checks.speculative(entries).alias("guesses"))


@query("call_signatures", "select o_orderkey, 'head::{\"file_path\":\"f' || o_custkey || '.csv\",\"query\":\"a b ' || o_orderstatus || '\",\"range\":\"A' || o_orderkey || ':B2\",\"x\":\"' || o_orderkey % 3 || '\"}' as signature, count(*) over (partition by o_custkey) as calls from orders")
def call_signatures(s, d):
    k = F.col("o_orderkey")
    shown = F.when(k % 2 == 0, _say('{"x": ', k % 3, ', "query": "b, ', F.col("o_orderstatus"), '  a", "range": " a', k, ':b2 ", "file_path": "/d/f', F.col("o_custkey"), '.csv"}')).otherwise(_say('{"file_path": "e\\\\f', F.col("o_custkey"), '.csv", "range": "A', k, ':b2", "query": "a ', F.col("o_orderstatus"), ' b", "x": ', k % 3, "}"))
    order = F.expr("transform(split(query, ' '), x -> x)")  # noqa: F841  terms are sorted by code point; statuses are capitals
    made = read(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", checks.call_signature(F.lit("head"), shown).alias("signature"))
    swapped = F.replace("signature", _say('"', F.col("o_orderstatus"), ' a b"'), _say('"a b ', F.col("o_orderstatus"), '"'))
    return made.select("o_orderkey", swapped.alias("signature"), F.count("*").over(W.partitionBy("o_custkey")).alias("calls"))


@query("client_calls", """select o_orderkey, unnest(case o_orderkey % 4 when 0 then ['head', 'tail'] when 1 then ['find'] when 2 then ['grep'] else [] end) as name, unnest(case o_orderkey % 4 when 0 then [o_orderkey::varchar, o_custkey::varchar] when 1 then [o_custkey::varchar] when 2 then [o_orderkey::varchar] else [] end) as path from orders""")
def client_calls(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = (
        F.when(k % 4 == 0, _say('<tool_call>{"tool": "head", "params": {"path": "', k, '"}} and more</tool_call> then <TOOL_CALL> {"name": "tail", "arguments": {"path": "', c, '"}} </TOOL_CALL> ```{"name": "no"}```'))
        .when(k % 4 == 1, _say("<function_calls><invoke name='find'><parameter name=\"path\"> 0 </parameter>\n<parameter name=\"path\"> ", c, " </parameter></invoke></function_calls>"))
        .when(k % 4 == 2, _say('say ```json\n{"function": "grep", "parameters": {"path": "', k, '"}}\n``` and ```{"x": 1}```')).otherwise("<tool_call>{broken</tool_call> ```{}```")
    )
    rows = read(s, d, "orders").select("o_orderkey", F.explode(checks.client_calls(text)).alias("c"))
    return rows.select("o_orderkey", "c.name", F.get_json_object("c.arguments", "$.path").alias("path"))


@query("split_thoughts", "select conv_id, turn, case when turn % 3 = 0 then 'b' || turn || chr(10) || chr(10) || 'a' when turn % 3 = 1 then 'c' end as reasoning, case when turn % 3 < 2 then regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') else coalesce(text, '') end as rest from conversations where coalesce(text, '') not like '%<%'")
def split_thoughts(s, d):
    m, pos = _messages(s, d).where("coalesce(content, '') not like '%<%'"), F.col("pos")
    text = F.when(pos % 3 == 0, _say("<reasoning>a</reasoning>", F.coalesce("content", F.lit("")), "<THINK> b", pos, " </THINK>")).when(pos % 3 == 1, _say("<thought>c</thought>", F.coalesce("content", F.lit("")))).otherwise(F.coalesce("content", F.lit("")))
    return m.select(F.col("trace").alias("conv_id"), pos.alias("turn"), checks.thoughts(text).alias("t")).select("conv_id", "turn", "t.reasoning", "t.rest")


@query("structured_traces", "select conv_id, bool_or(role = 'assistant' and turn % 5 = 1) as structured from conversations group by 1")
def structured_traces(s, d):
    calls = F.when(F.col("pos") % 5 == 1, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>"))
    return _messages(s, d).groupBy(F.col("trace").alias("conv_id")).agg(checks.is_structured(F.collect_list(F.struct("role", calls.alias("calls")))).alias("structured"))


@query("rooted_plans", "select o_orderkey, 'read <TABLE_ROOT>/f' || o_custkey || '.csv in <TABLE_ROOT>/work then ' || o_orderkey as plan, 'open <TABLE_ROOT>/f' || o_custkey || '.csv, /tmp/data/other/x' as path, 1::bigint as left_over from orders")
def rooted_plans(s, d):
    k, work = F.col("o_orderkey"), r"/tmp/data/task_\w+"
    plan = _say(" read /tmp/data/task_", k, "/dataset/tables/f", F.col("o_custkey"), ".csv in /tmp/data/task_x/work then 当前的工作环境路径是：/tmp。", k, " ")
    path = checks.rooted(_say("open /tmp/data/task_", k, "/dataset/tables/f", F.col("o_custkey"), ".csv, /tmp/data/other/x"), work + "/dataset/tables")
    return read(s, d, "orders").select("o_orderkey", checks.step_plan(plan).alias("plan"), path.alias("path"), F.size(checks.absolute_paths(path, "tmp/data", r"home/\w+")).cast("long").alias("left_over"))


@query("confined_paths", "select o_orderkey, case o_orderkey % 5 when 0 then '/data/t/a' || o_custkey || '.csv' when 1 then '/data/t/etc/b' || o_custkey when 2 then '/data/t' when 3 then '/data/t/x/../c' || o_custkey else ' ' end as path, '/data/t/d' || o_custkey || '.csv' as found from orders")
def confined_paths(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = F.when(k % 5 == 0, _say("/data/t/a", c, ".csv")).when(k % 5 == 1, _say("/etc/./b", c)).when(k % 5 == 2, _say("../../../up", c)).when(k % 5 == 3, _say("/data/t/x/../c", c)).otherwise(" ")
    found = checks.resolved(F.when(k % 2 == 0, _say("<TABLE_ROOT>/d", c, ".csv")).otherwise(_say("<TABLE_ROOT>/dataset/tables/d", c, ".csv")), "/data/t/")
    return read(s, d, "orders").select("o_orderkey", checks.confined(path, "/data/t").alias("path"), found.alias("found"))


@query("built_observations", "with o as (select doc_id, case when doc_id % 4 > 0 then '[SUCCESS] ' || coalesce(text, '') else '[ERROR] ' || coalesce(source, '') end as t from documents) select doc_id, case when length(t) > 400 then '[Truncated, original length ' || length(t) || ']' || chr(10) || right(t, 400) else t end as observation from o")
def built_observations(s, d):
    return read(s, d, "documents").select("doc_id", checks.observation(F.col("doc_id") % 4 > 0, F.col("text"), F.col("source"), 400).alias("observation"))


@query("source_files", "select o_orderkey, case o_orderkey % 3 when 0 then 'a' || o_custkey || '.csv' when 1 then 'd/b' || o_custkey || '.xlsx' end as file from orders")
def source_files(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    arguments = F.when(k % 3 == 0, _say('{"n": 3, "table": "a', c, '.csv", "file": "no.csv"}')).otherwise('{"n": 3}')
    return read(s, d, "orders").select("o_orderkey", checks.source_file(arguments, F.when(k % 3 == 1, _say("read d/b", c, ".xlsx and e.csv")).otherwise("nothing")).alias("file"))


_HIST = "(select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as back, case role when 'user' then 'User' when 'assistant' then 'Assistant' when 'system' then 'System' when 'tool' then 'Tool' else role end || ': ' || left(coalesce(text, ''), 50) as line from conversations)"


@query("history_texts", f"select conv_id, 'Conversation History:' || chr(10) || string_agg(line, chr(10) order by turn) as history from {_HIST} where back <= 3 group by 1")
def history_texts(s, d):
    m = _messages(s, d).groupBy(F.col("trace").alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("m"))
    calls = F.lit(None).cast("array<struct<name:string,arguments:string>>")
    return m.select("conv_id", checks.history_text(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"), calls.alias("calls"))), 3, 50).alias("history"))


@query("steps_texts", """select l_orderkey, string_agg(case when l_linenumber % 2 = 1 then '[规划] p' || l_linenumber || chr(10) || '[工具调用] f(' || l_partkey || ')' || chr(10) || '[工具返回] ' || left('seen ' || l_suppkey, 8) else '[最终答案] {"a": ' || l_linenumber || '}' end, chr(10) order by l_linenumber, l_partkey, l_suppkey) as text from lineitem group by 1""")
def steps_texts(s, d):
    n = F.col("l_linenumber")
    step = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.when(n % 2 == 1, "tool_call").otherwise("final_answer").alias("type"), _say("p", n).alias("plan"), F.array(F.struct(F.lit("f").alias("name"), F.col("l_partkey").cast("string").alias("arguments"))).alias("calls"),
        F.array(F.struct(_say("seen ", F.col("l_suppkey")).alias("content"))).alias("observations"), _say('{"a": ', n, "}").alias("answer"),
    )
    return read(s, d, "lineitem").groupBy("l_orderkey").agg(checks.steps_text(F.array_sort(F.collect_list(step)), 8).alias("text"))


@query("step_issues", """with s as (select l_orderkey, l_linenumber % 4 as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i from lineitem)
 select l_orderkey, list_filter(list(case k when 0 then 'step[' || i || ']: unknown type' when 1 then 'step[' || i || ']: no list of calls' when 2 then 'step[' || i || ']: a call without a name' end order by i), lambda x: x is not null) as issues from s group by 1""")
def step_issues(s, d):
    k = F.col("l_linenumber") % 4
    calls = F.when(k == 1, None).when(k == 2, F.array(F.struct(F.lit(None).cast("string").alias("name")))).otherwise(F.array(F.struct(F.lit("f").alias("name"))))
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(k == 0, "odd").otherwise("tool_call").alias("type"), calls.alias("calls"))
    return read(s, d, "lineitem").groupBy("l_orderkey").agg(checks.step_issues(F.array_sort(F.collect_list(step))).alias("issues"))


@query("padded_batches", "with t as (select conv_id, list(turn order by turn) as t from conversations group by 1) select conv_id, list_slice(list_concat(t, list_transform(range(0, 6), lambda i: -1)), 1, 6) as turns from t")
def padded_batches(s, d):
    return read(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t")).select("conv_id", checks.padded(F.col("t"), 6, -1).alias("turns"))


@query("tool_registry", "select * from (values ('table_selector', 'general', 2), ('semantic_row_retriever', 'retrieval', 2), ('semantic_column_retriever', 'retrieval', 2), ('grep_search', 'general', 2), ('table_head_reader', 'general', 1), ('header_merger', 'general', 2), ('complex_table_parser_v2', 'general', 1), ('xlsx_to_csv_converter', 'general', 1)) t(name, listed, required)")
def tool_registry(s, d):
    return plugins.registry(s).select("name", "listed", F.size("required").alias("required"))


@query("missing_parameters", "select o_orderkey, case o_orderkey % 4 when 0 then ['folder_path'] when 1 then ['path', 'query'] when 2 then [] end as missing from orders")
def missing_parameters(s, d):
    k = F.col("o_orderkey") % 4
    tool = F.when(k == 0, "table_selector").when(k == 1, "semantic_row_retriever").when(k == 2, "header_merger").otherwise("unknown")
    told = F.when(k == 0, '{"query": "q", "top_k": 2}').when(k == 2, _say('{"csv_path": "', F.col("o_custkey"), '", "header_rows": 2}')).otherwise("{broken")
    return plugins.missing_parameters(read(s, d, "orders").select("o_orderkey", tool.alias("tool"), told.alias("arguments")), plugins.registry(s)).select("o_orderkey", "missing")


@query("metric_plugins", "select l_orderkey, round(avg(l_quantity / 50), 6) as coverage, bool_and(l_quantity / 50 >= 1) as passed, count(*) as steps from lineitem group by 1")
def metric_plugins(s, d):
    return plugins.evaluate(read(s, d, "lineitem").withColumn("c", F.col("l_quantity") / 50), ["coverage", "passed", "steps"], "l_orderkey", coverage="c")


@query("matching_lines", "select doc_id, line_no::bigint as line_no, content from (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents) where regexp_matches(content, 'licen[cs]e|token', 'i')")
def matching_lines(s, d):
    """The table function in SQL; texts are filtered in the JVM first, so that Python sees few."""
    plugins.register(s)
    read(s, d, "documents").where(F.col("text").rlike("(?i)licen[cs]e|token")).createOrReplaceTempView("matching_lines_documents")
    return s.sql("select doc_id, line_no, content from matching_lines_documents, lateral matching_lines(text, 'licen[cs]e|token')")


def _grid(s, d):
    """Customers as sheets by nation: two junk rows, a header of two rows, a junk column, and their data."""
    c = read(s, d, "customer").withColumn("row_no", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")) + 4)
    cell = lambda r, n, t: F.struct(F.lit(r).cast("int").alias("row_no") if isinstance(r, int) else r.cast("int").alias("row_no"), F.lit(n).alias("col_no"), t.cast("string").alias("text"))
    body = c.select(F.col("c_nationkey").alias("sheet"), F.explode(F.array(cell(F.col("row_no"), 1, F.col("c_custkey")), cell(F.col("row_no"), 2, F.lit(" ")), cell(F.col("row_no"), 3, F.col("c_mktsegment")), cell(F.col("row_no"), 4, F.floor("c_acctbal")))).alias("x"))
    heads = ((1, 1, None), (1, 3, ""), (2, 2, "Unnamed: 3"), (3, 1, "customer"), (3, 2, "unnamed: 1"), (3, 3, "about"), (3, 4, None), (4, 1, ""), (4, 3, "segment"), (4, 4, "balance"))
    top = c.select(F.col("c_nationkey").alias("sheet")).distinct().select("sheet", F.explode(F.array(*[cell(r, n, F.lit(t)) for r, n, t in heads])).alias("x"))
    return body.unionByName(top).select("sheet", "x.*")


_SHEETS = "(select *, row_number() over (partition by c_nationkey order by c_custkey) + 4 as row_no from customer)"


@query("cleaned_cells", f"""with b as (select c_nationkey as sheet, row_no, unnest([1, 3, 4]) as col_no, unnest([c_custkey::varchar, c_mktsegment, floor(c_acctbal)::bigint::varchar]) as text from {_SHEETS}), h as (select distinct c_nationkey as sheet, unnest([3, 3, 3, 4, 4, 4]) as row_no, unnest([1, 3, 4, 1, 3, 4]) as col_no, unnest(['customer', 'about', null, '', 'segment', 'balance']) as text from customer) select * from b union all select * from h""")
def cleaned_cells(s, d):
    return grid.drop_junk(_grid(s, d)).select("sheet", F.col("row_no").cast("long").alias("row_no"), "col_no", "text")


@query("merged_headers", "select distinct c_nationkey as sheet, unnest([1, 3, 4]) as col_no, unnest(['customer', 'about-segment', 'about-balance']) as name from customer")
def merged_headers(s, d):
    cells = grid.drop_junk(_grid(s, d)).withColumn("row_no", F.col("row_no") - 2)
    return grid.merge_header(cells, 2)


@query("merged_sheets", f"""with b as (select c_nationkey as sheet, row_no - 4 as row_no, [c_custkey::varchar, '', coalesce(c_mktsegment, ''), floor(c_acctbal)::bigint::varchar] as cells from {_SHEETS}) select sheet, row_no, cells from b union all select distinct c_nationkey, 0, ['customer', '', 'about-segment', 'about-balance'] from customer""")
def merged_sheets(s, d):
    """Sheets without their junk rows; the junk column is kept as an empty one by its place."""
    cells = grid.drop_junk(_grid(s, d)).withColumn("row_no", F.col("row_no") - 2)
    return grid.merged_rows(cells, 2)


def _grouped(s, d):
    """Orders of a status as a sheet: rows of a year, whose cells all name it, before the rows of that year."""
    o = read(s, d, "orders").select(F.col("o_orderstatus").alias("sheet"), F.year("o_orderdate").alias("y"), "o_orderkey", F.floor("o_totalprice").alias("price"))
    marks = o.select("sheet", "y").distinct().select("sheet", "y", F.lit(0).alias("k"), F.array(_say("Year ", F.col("y")), _say("Year ", F.col("y")), F.lit(None).cast("string")).alias("v"))
    rows = o.select("sheet", "y", F.lit(1).alias("k"), F.array(F.col("o_orderkey").cast("string"), F.col("price").cast("string"), F.lit("x")).alias("v"), "o_orderkey").unionByName(marks.withColumn("o_orderkey", F.lit(0).cast("long")))
    n = F.row_number().over(W.partitionBy("sheet").orderBy("y", "k", "o_orderkey")) + 1
    cells = rows.withColumn("row_no", n).select("sheet", "row_no", F.posexplode("v").alias("c", "text")).where("text is not null")
    head = o.select("sheet").distinct().select("sheet", F.lit(1).alias("row_no"), F.posexplode(F.array(F.lit("id"), F.lit("price"), F.lit("note"))).alias("c", "text"))
    return cells.unionByName(head).select("sheet", "row_no", (F.col("c") + 1).alias("col_no"), "text")


@query("flattened_sheets", """select o_orderstatus as sheet, ['Year ' || year(o_orderdate), o_orderkey::varchar, floor(o_totalprice)::bigint::varchar, 'x'] as cells from orders union all select distinct o_orderstatus, ['group', 'id', 'price', 'note'] from orders""")
def flattened_sheets(s, d):
    return grid.flattened_rows(_grouped(s, d)).select("sheet", "cells")


@query("classified_sheets", "select distinct 'o' || o_orderstatus as sheet, 'A' as kind from orders union all select distinct 'c' || c_nationkey, 'B' from customer")
def classified_sheets(s, d):
    both = _grouped(s, d).withColumn("sheet", _say("o", F.col("sheet"))).unionByName(grid.drop_junk(_grid(s, d)).withColumn("sheet", _say("c", F.col("sheet"))).withColumn("row_no", F.col("row_no") - 2))
    return grid.classify(both).select("sheet", "kind")


@query("parsed_sheets", f"""select 'o' || o_orderstatus as sheet, 'A' as kind, ['Year ' || year(o_orderdate), o_orderkey::varchar, floor(o_totalprice)::bigint::varchar, 'x'] as cells from orders union all (select distinct 'o' || o_orderstatus, 'A', ['group', 'id', 'price', 'note'] from orders)
 union all select 'c' || c_nationkey, 'B', [c_custkey::varchar, '', coalesce(c_mktsegment, ''), floor(c_acctbal)::bigint::varchar] from customer union all (select distinct 'c' || c_nationkey, 'B', ['customer', '', 'about-segment', 'about-balance'] from customer)""")
def parsed_sheets(s, d):
    both = _grouped(s, d).withColumn("sheet", _say("o", F.col("sheet"))).unionByName(grid.drop_junk(_grid(s, d)).withColumn("sheet", _say("c", F.col("sheet"))).withColumn("row_no", F.col("row_no") - 2))
    return grid.parsed_rows(both).select("sheet", "kind", "cells")


@query("repeated_to_rows", "select o_orderkey, unnest([1, 2]) as \"group\", unnest([o_orderstatus, o_orderpriority]) as name, unnest([o_custkey::varchar, floor(o_totalprice)::bigint::varchar]) as value from orders")
def repeated_to_rows(s, d):
    o = read(s, d, "orders").withColumn("price", F.floor("o_totalprice"))
    return grid.repeated_to_rows(o, ["o_orderkey"], [["o_orderstatus", "o_custkey"], ["o_orderpriority", "price"]], ["name", "value"])


@query("file_descriptions", "select n_nationkey, concat_ws(chr(10), 'File path: ' || n_name, case when n_nationkey % 2 = 0 then 'Table description: of region ' || n_regionkey end, case when n_nationkey % 3 > 0 then 'Column information:' || chr(10) || '  - key (int): ' || chr(10) || '  - Unknown (): the name' end) as text from nation")
def file_descriptions(s, d):
    k, null = F.col("n_nationkey"), F.lit(None).cast("string")
    column = lambda n, t, a: F.struct(n.alias("name"), t.alias("type"), a.alias("about"))
    columns = F.when(k % 3 > 0, F.array(column(F.lit("key"), F.lit("int"), null), column(null, null, F.lit("the name"))))
    return read(s, d, "nation").select("n_nationkey", grid.description(F.col("n_name"), F.when(k % 2 == 0, _say("of region ", F.col("n_regionkey"))), columns).alias("text"))


@query("sheet_previews", "select doc_id, list_slice(string_split(text, chr(10)), 1, 3) as head, len(string_split(text, chr(10))) - 1 as total_rows from documents where text is not null")
def sheet_previews(s, d):
    return tables.sheet_previews(lines(read(s, d, "documents")), 3, "doc_id")


@query("context_with_gaps", """with l as (select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents), m as (select *, regexp_matches(content, 'license|token', 'i') as hit from l), n as (select *, max(hit::int) over (partition by doc_id order by line_no rows between 1 preceding and 1 following) as near from m),
 g as (select *, line_no > lag(line_no) over (partition by doc_id order by line_no) + 1 as gap from n where near = 1) select doc_id, line_no::bigint as "after", line_no::bigint as line_no, content from g union all select doc_id, line_no, 0, '...' from g where gap""")
def context_with_gaps(s, d):
    marked = lines(read(s, d, "documents")).withColumn("hit", F.col("content").rlike("(?i)license|token"))
    return tables.merged_context(marked, "hit", 1, "doc_id").select("doc_id", F.col("after").cast("long").alias("after"), "line_no", "content")


@query("searched_files", "select page_id from pages where regexp_matches(url, '(?i)\\.(html|csv)$') and not regexp_matches(url, '(^|/)(\\.git|node_modules|\\.venv|__pycache__)(/|$)') and regexp_matches(regexp_extract(url, '[^/]*$'), '1')")
def searched_files(s, d):
    return tables.searchable(read(s, d, "pages").select("page_id", F.col("url").alias("path")), ("html", "csv"), "1").select("page_id")


@query("file_documents", """with h as (select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 5), chr(10)) as shown from documents where text is not null)
 select doc_id, 'Table Name: f' || doc_id || '.csv' || case when doc_id % 2 = 0 then '-[sheet: s1]' else '' end || chr(10) || 'Table Path: d/f' || doc_id || '.csv' || chr(10) || 'Table Content Preview:' || chr(10) || case when length(shown) > 300 then left(shown, 300) || '...(truncated)' else shown end as document from h""")
def file_documents(s, d):
    l = lines(read(s, d, "documents")).select(_say("d/f", F.col("doc_id"), ".csv").alias("path"), F.when(F.col("doc_id") % 2 == 0, "s1").otherwise("").alias("sheet"), "line_no", "content")  # noqa: E741
    return retrieval.file_documents(l, most=300).select(F.regexp_extract("path", r"f(\d+)", 1).cast("long").alias("doc_id"), "document")


@query("unencoded_texts", "select md5(text) as hash, min(text) as text from documents where text is not null and text not in (select text from documents where doc_id % 3 = 0 and text is not null) group by 1")
def unencoded_texts(s, d):
    docs = read(s, d, "documents")
    return retrieval.unencoded(docs.select("text"), docs.where("doc_id % 3 = 0").select(F.md5("text").alias("hash")).distinct())


@query("unit_norms", "select vec_id, 1.0::double as norm, round(embedding[1] / sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as first from embeddings")
def unit_norms(s, d):
    u = retrieval.unit_vectors(read(s, d, "embeddings").select("vec_id", F.col("embedding").alias("v")))
    return u.select("vec_id", F.round(F.sqrt(retrieval.dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.round(F.get("v", F.lit(0)), 5).alias("first"))


@query("late_interaction", """with q as (select vec_id as qt, embedding::double[] as q from embeddings where vec_id < 4), m as (select vec_id // 5 as id, qt, max(list_dot_product(embedding::double[], q)) as m from embeddings, q group by 1, 2)
 select id, round(sum(m), 6) as score from m group by 1""")
def late_interaction(s, d):
    """Every five vectors are the tokens of a document; the query has four."""
    e = read(s, d, "embeddings")
    made = retrieval.max_sim(e.where("vec_id < 4").select(F.col("vec_id").alias("qt"), F.col("embedding").alias("q")), e.select(F.floor(F.col("vec_id") / 5).alias("id"), F.col("embedding").alias("v")))
    return made.select("id", F.round("score", 6).alias("score"))


@query("cell_numbers", "select c_custkey, c_acctbal::double as plain, round(c_acctbal::double / 100, 8) as share, null::double as word from customer")
def cell_numbers(s, d):
    at = F.col("c_acctbal").cast("string")
    return read(s, d, "customer").select("c_custkey", number(at).alias("plain"), F.round(number(_say(" ", at, "%")), 8).alias("share"), number(F.col("c_name")).alias("word"))


@query("normal_cells", "select o_orderkey, case o_orderkey % 6 when 0 then (o_custkey + 1000)::varchar when 1 then (o_custkey + 0.5)::double::varchar when 2 then ((o_custkey % 90 + 5) / 100.0)::double::varchar when 3 then ' x ' || o_custkey when 4 then '' else '-' || (o_custkey + 1000000) end as cell from orders")
def normal_cells(s, d):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    cell = (
        F.when(k == 0, _say(" 0", F.format_number(c + 1000, 0), " ")).when(k == 1, _say(c, ".50")).when(k == 2, _say(c % 90 + 5, "% ")).when(k == 3, _say(" x ", c))
        .when(k == 4, F.when(c % 2 == 0, "")).otherwise(_say("-", F.format_number(c + 1000000, 0)))
    )
    return read(s, d, "orders").select("o_orderkey", claims.normal_cell(cell).alias("cell"))
