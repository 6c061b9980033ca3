"""Queries of claims, dependencies, segments and curation over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import claims
from ..operators import curation, dependencies, segments
from ..sources.tables import read
from .registry import query


def _s(c):
    return c.cast("string") if not isinstance(c, str) else F.lit(c)


def _say(*parts):
    return F.concat(*[_s(p) for p in parts])


@query("signed_percents", """select o_orderkey, unnest([1, 2, 3, 4, 5]) as nth, unnest([-(o_orderkey % 100)::double, o_orderkey % 7 + 0.5, (o_orderkey % 9)::double, (o_orderkey % 5)::double, (o_orderkey % 3)::double]) as value,
 unnest(['change', 'change', 'magnitude', 'unknown', 'level']) as kind, unnest(['percent', 'percent', 'percent', 'percentage_point', 'percent']) as unit from orders""")
def signed_percents(s, d):
    k = F.col("o_orderkey")
    text = _say("库存同比下降", k % 100, "%，但产量增长约", k % 7, ".5％。降幅为", k % 9, "%，相差", k % 5, "个百分点；回落至", k % 3, " %，共12辆")
    rows = read(s, d, "orders").select("o_orderkey", F.posexplode(claims.signed_percents(text)).alias("nth", "c"))
    return rows.select("o_orderkey", (F.col("nth") + 1).alias("nth"), "c.value", "c.kind", "c.unit")


#: One expression of each family with its kind, in the order of families, and words that refer to nothing.
_POINTERS = (("该企业", "entity_ref"), ("后者", "ordinal_ref"), ("综上", "summary_ref"), ("这三个方案", "collective_ref"), ("渠道C", "named_ref"), ("好的我们已经有", "transition_ref"), ("前面计算的", "direct_ref"), ("相比以上", "comparison_ref"))


@query("references_back", f"""with p as (select * from (values {", ".join(f"({i}, '{w}', '{k}')" for i, (w, k) in enumerate(_POINTERS))}, (7, '以上', 'collective_ref')) t(i, what, kind))
 select o_orderkey, what, kind from orders join p on p.i = o_orderkey % 9 or (p.i = o_custkey % 9 and o_custkey % 9 <> o_orderkey % 9)""")
def references_back(s, d):
    """Texts with expressions of two families (one, if both are the same, however often it stands there), or of none; a comparison with what is above also points to that."""
    words = F.array(*[F.lit(w) for w, _ in _POINTERS], F.lit("无所指"))
    at = lambda c: F.get(words, (F.col(c) % 9).cast("int"))
    between = F.lit("；" + "—" * 14 + "；")
    text = F.concat(at("o_orderkey"), between, at("o_custkey"), between, at("o_orderkey"), F.lit("共12辆"))
    return read(s, d, "orders").select("o_orderkey", F.explode(claims.references(text)).alias("r")).select("o_orderkey", F.col("r.text").alias("what"), "r.kind")


@query("python_numbers", "select l_orderkey, l_linenumber, (l_extendedprice::double * [1e-9, 1e-7, 1.0, 1e4, 1e10, 1e13, -1e20][l_linenumber])::varchar as number from lineitem")
def python_numbers(s, d):
    factors = F.array(*map(F.lit, (1e-9, 1e-7, 1.0, 1e4, 1e10, 1e13, -1e20)))
    value = F.col("l_extendedprice").cast("double") * F.get(factors, F.col("l_linenumber").cast("int") - 1)
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", claims.python_number(value).alias("number"))


@query("evidence_items", """with p as (select o_custkey % 50 as sample, o_custkey as sq, o_orderkey as no, o_orderkey % 3 as k from orders),
 i as (select *, unnest(case k when 0 then ['2010', '1', no || '.5%'] when 1 then [no || '辆'] else ['plain words'] end) as value, generate_subscripts(case k when 0 then [1, 2, 3] else [1] end, 1) as pos from p)
 select sample, sq, 'sq' || sq || '_e' || row_number() over (partition by sample, sq order by no, pos) as item, case k when 0 then 'raw_value' when 1 then 'derived_value' else 'text_fact' end as kind, value, case k when 0 then '2010年1月' end as time,
 case when k = 2 then null when k = 1 then '辆' when pos = 3 then '%' when pos = 2 then '' else '' end as unit, case k when 0 then 0.6 when 1 then 0.45 else 0.3 end::double as confidence from i""")
def evidence_items(s, d):
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, _say("2010年1月产量为", k, ".5%")).when(k % 3 == 1, _say("需根据当月值计算，共", k, "辆")).otherwise("plain words")
    points = read(s, d, "orders").select((F.col("o_custkey") % 50).alias("sample"), F.col("o_custkey").alias("sq"), k.alias("point_no"), text.alias("point"), F.array().cast("array<string>").alias("tables"))
    return dependencies.evidence_items(points).select("sample", "sq", "item", "kind", "value", "time", "unit", "confidence")


_ITEMS = "(select o_custkey as sample, o_orderkey as item, case when o_orderstatus = 'F' then 'derived_value' else 'raw_value' end as kind, case when o_orderkey % 4 > 0 then o_orderpriority end as entity, case when o_orderkey % 3 > 0 then year(o_orderdate)::varchar end as time from orders)"


@query("evidence_links", f"""with i as (select * from {_ITEMS}), c as (select a.*, (select count(*) from i b where b.kind = 'raw_value' and b.sample = a.sample and b.entity = a.entity and b.time = a.time) as n1, (select count(*) from i b where b.kind = 'raw_value' and b.sample = a.sample and b.entity = a.entity) as n2,
 (select count(*) from i b where b.kind = 'raw_value' and b.sample = a.sample and b.time = a.time) as n3, (select count(*) from i b where b.kind = 'raw_value' and b.sample = a.sample) as n4 from i a where a.kind = 'derived_value')
 select sample, item, case when n1 > 0 then 1 when n2 > 0 then 2 when n3 > 0 then 3 when n4 > 0 then 4 end as tier, case when n1 > 0 then n1 when n2 > 0 then n2 when n3 > 0 then n3 else n4 end as inputs from c""")
def evidence_links(s, d):
    k = F.col("o_orderkey")
    items = read(s, d, "orders").select(F.col("o_custkey").alias("sample"), k.alias("item"), F.when(F.col("o_orderstatus") == "F", "derived_value").otherwise("raw_value").alias("kind"), F.when(k % 4 > 0, F.col("o_orderpriority")).alias("entity"), F.when(k % 3 > 0, F.year("o_orderdate").cast("string")).alias("time"))
    return dependencies.link_tiers(items).select("sample", "item", "tier", "inputs")


@query("future_needs", """with t as (select conv_id as sample, row_number() over (partition by conv_id order by turn) as pos, role, text from conversations), f as (select sample, pos, 'table_ref' as kind, role as what, null as ref_kind from t union all select sample, pos, 'reference', '综上所述', 'summary_ref' from t where role = 'assistant'),
 b as (select *, unnest([pos - 1, pos - 2]) as boundary from f)
 select b.sample, b.boundary, b.pos as needed_by, b.kind, b.what, count(t.pos) as sources, min(t.pos) as first_source, max(t.pos) as last_source from b join t on t.sample = b.sample and t.pos <= b.boundary and (b.kind = 'reference' or t.role = b.what) group by 1, 2, 3, 4, 5""")
def future_needs(s, d):
    pos = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    turns = read(s, d, "conversations").select(F.col("conv_id").alias("sample"), pos.cast("long").alias("pos"), F.when(F.col("role") == "assistant", "综上所述").alias("text"), F.array("role").alias("tables"), F.array().cast("array<string>").alias("values"))
    return dependencies.future_dependencies(turns).drop("ref_kind")


@query("training_segments", """with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as t, count(*) over (partition by user_id) as n, max(value) over (partition by user_id) as ans from events)
 select user_id as rollout, user_id || '_tool_' || t as segment, 'tool' as kind, t::int as step, round(sum(value * pow(0.5, t)) over (partition by user_id order by t rows between current row and unbounded following) / pow(0.5, t) + ans * pow(0.5, n - t) + 1e-9, 4) as value from e
 union all select user_id, user_id || '_answer', 'answer', -1, round(max(value) + 1e-9, 4) from events group by 1""")
def training_segments(s, d):
    """Every event of every user, one tool step each. The SQL's powers of a half reach a thousand events of a user; the query has no such limit. Values that end in 5 at the fifth place are rounded up on both sides."""
    runs = read(s, d, "events").groupBy(F.col("user_id").alias("rollout")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("x"), F.max("value").alias("answer_reward"))
    runs = runs.select("rollout", F.transform("x", lambda r: r["value"].cast("double")).alias("rewards"), F.lit("a").alias("answer"), F.col("answer_reward").cast("double").alias("answer_reward"), F.lit(None).cast("double").alias("memory_reward"))
    return segments.segments(runs, gamma=0.5).withColumn("value", F.round(F.col("value") + 1e-9, 4))


@query("token_advantages", """with w as (select conv_id, turn, role, unnest(regexp_extract_all(text, '[^ \\n]+')) as w, generate_subscripts(regexp_extract_all(text, '[^ \\n]+'), 1) as word_no from conversations), n as (select *, row_number() over (partition by conv_id order by turn, word_no) as nth from w)
 select conv_id, count(*) as tokens, sum(length(w)) as id_sum, sum(case when role = 'assistant' then turn else 0 end)::double as advantage_sum, count(*) filter (where role = 'assistant')::double as trained from n where nth <= 4096 group by conv_id""")
def token_advantages(s, d):
    """Word lengths stand for token ids; a conversation is cut at 4096 of them, as the reference does."""
    c = read(s, d, "conversations").select(F.col("conv_id").alias("rollout"), F.col("turn").alias("pos"), (F.col("role") == "assistant").alias("trainable"), "text", F.when(F.col("role") == "assistant", F.col("turn")).otherwise(0).cast("double").alias("advantage"))
    made = segments.token_arrays(c, F.transform(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0)), F.char_length))
    total = lambda c, zero: F.aggregate(c, F.lit(zero), lambda a, x: a + x)
    return made.select(F.col("rollout").alias("conv_id"), F.size("ids").cast("long").alias("tokens"), F.aggregate(F.col("ids").cast("array<long>"), F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), total(F.col("advantages"), 0.0).alias("advantage_sum"), total(F.col("trainable"), 0.0).alias("trained"))


@query("conversation_messages", """select rollout, pos, role, kind, trainable from (
 with o as (select o_orderkey, o_orderkey % 5 = 0 as invalid, l_linenumber, row_number() over (partition by o_orderkey order by l_linenumber) as k from orders join lineitem on o_orderkey = l_orderkey), m as (
 select distinct o_orderkey as rollout, unnest([0, 1]) as pos, unnest(['system', 'user']) as role, unnest(['system_prompt', 'user_question']) as kind, false as trainable from o
 union all select o_orderkey, unnest([2 * k, 2 * k + 1]), unnest(['assistant', 'user']), unnest(['tool_call', case when invalid then 'error_feedback' else 'tool_observation' end]), unnest([true, false]) from o
 union all select o_orderkey, 2 * max(k) + 2, 'assistant', 'answer', true from o group by 1) select * from m)""")
def conversation_messages(s, d):
    step = F.struct(F.col("l_linenumber").cast("int").alias("step"), F.lit("r").alias("response"), (F.col("l_orderkey") % 5 == 0).alias("invalid"), F.array(F.struct(F.lit("c").alias("content"), F.lit(True).alias("success"))).alias("observations"))
    runs = read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("rollout")).agg(F.array_sort(F.collect_list(step)).alias("steps")).select("rollout", "steps", F.lit("s").alias("system"), F.lit("q").alias("question"), F.lit("a").alias("answer"))
    runs = runs.join(read(s, d, "orders").select(F.col("o_orderkey").alias("rollout")), "rollout", "left_semi")
    return segments.conversation(runs).select("rollout", "pos", "role", "kind", "trainable")


@query("failed_calls", """with e as (select user_id, event_id, event_type = 'click' and value < 20 as gone, lag(event_type = 'click' and value < 20) over (partition by user_id order by ts, event_id) as gap, event_type in ('click', 'view') as tool from events)
 select user_id, count(*) as steps, count(*) filter (where tool and gap) as mended from e where not gone group by user_id""")
def failed_calls(s, d):
    """A click is a tool step with one call, which fails below 20; a view one with a call that never fails."""
    tool, id_ = F.col("event_type").isin("click", "view"), F.col("event_id").cast("string")
    content = F.when((F.col("event_type") == "click") & (F.col("value") < 20), "Got unsupported ScalarType BFloat16").otherwise("fine")
    none = lambda kind: F.array().cast(kind)
    step = F.struct(
        "ts", "event_id", F.when(tool, "tool_call").otherwise("other").alias("type"), F.lit("出现了错误：BFloat16。换一种方法：读取文件，列出目录").alias("plan"),
        F.when(tool, F.array(F.struct(id_.alias("id"), F.lit("t").alias("name"), F.lit("{}").alias("arguments")))).otherwise(none("array<struct<id:string,name:string,arguments:string>>")).alias("calls"),
        F.when(tool, F.array(F.struct(id_.alias("id"), content.alias("content")))).otherwise(none("array<struct<id:string,content:string>>")).alias("observations"),
    )
    runs = read(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", step.alias("s")))).alias("x"))
    kept = curation.without_orphans(curation.without_failed_calls(F.transform("x", lambda x: x["s"])))
    mended = F.filter("kept", lambda x: x["plan"] == "读取文件，列出目录")
    return runs.select("user_id", kept.alias("kept")).select("user_id", F.size("kept").cast("long").alias("steps"), F.size(mended).cast("long").alias("mended")).where("steps > 0")


_TOOLS = {"head": {"path": {"type": "string", "required": True}, "n": {"type": "integer"}, "mode": {"type": "string", "enum": ["a", "b"]}}, "run": {"command": {"type": "string", "required": True}}}


@query("call_issues", """with c as (select l_orderkey as scope, l_linenumber as step, l_orderkey || '_' || (l_linenumber % 5) as call_id, l_partkey % 8 as k, l_suppkey % 9 = 0 as unseen from lineitem),
 u as (select *, row_number() over (partition by scope, call_id order by step) as rn from c where k < 7)
 select scope, call_id, 'unknown tool' as issue from c where k = 7 union all select scope, call_id, 'repeated id' from u where rn > 1
 union all select scope, call_id, unnest(case k when 1 then ['missing:path', 'extra:file'] when 2 then ['type:n'] when 3 then ['enum:mode'] when 4 then ['bad arguments'] when 5 then ['type:command'] else [] end) from u
 union all select scope, call_id, 'repeated observation' from (select *, row_number() over (partition by scope, step, call_id) as n from c where not unseen) where n > 1
 union all select scope, call_id, 'no observation' from u group by 1, 2 having bool_and(unseen) and not exists (select 1 from c x where x.scope = u.scope and x.call_id = u.call_id and not x.unseen)
 union all select scope, call_id, 'no call' from (select distinct scope, call_id from c where not unseen) o where not exists (select 1 from u where u.scope = o.scope and u.call_id = o.call_id)""")
def call_issues(s, d):
    k = (F.col("l_partkey") % 8).cast("int")
    told = ('{"path": "a", "n": 3, "mode": "a"}', '{"file": "a"}', '{"path": "a", "n": 1.5}', '{"path": "a", "mode": "z"}', "{path", '{"command": 4}', '{"command": "ls"}', "{}")
    tools = ("head", "head", "head", "head", "head", "run", "run", "walk")
    at = lambda xs: F.get(F.array(*map(F.lit, xs)), k)
    c = read(s, d, "lineitem").select(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("step"), F.lit(0).alias("pos"), _say(F.col("l_orderkey"), "_", F.col("l_linenumber") % 5).alias("call_id"), at(tools).alias("tool"), at(told).alias("arguments"), (F.col("l_suppkey") % 9 == 0).alias("unseen"))
    return curation.call_issues(c.drop("unseen"), c.where("not unseen").select("scope", "step", "call_id"), _TOOLS)


@query("loose_calls", """select o_orderkey, case o_orderkey % 7 when 6 then null when 4 then 'cmd_executor' else 'head' end as name, case o_orderkey % 7 when 6 then null when 4 then null when 5 then null else o_orderkey::varchar end as path from orders""")
def loose_calls(s, d):
    k = F.col("o_orderkey")
    forms = (
        ('{"tool": "head", "params": {"path": "', '"}} and more'), ('<function head>{"path": "', '"}</function>'), ('<invoke name="head"><parameter name="path">', "</parameter></invoke>"),
        ("<tool=head><parameter=path> ", " </parameter>"), ("<parameter cwd>", "</parameter>"), ("<function>head>", ""), ("nothing ", ""),
    )
    text = F.lit(None).cast("string")
    for i, (a, b) in enumerate(forms):
        text = F.when(k % 7 == i, _say(a, k, b)).otherwise(text)
    call = curation.loose_call(text)
    return read(s, d, "orders").select("o_orderkey", call.alias("c")).select("o_orderkey", "c.name", F.col("c.arguments")["path"].alias("path"))


@query("dialog_export", "select conv_id, count(*) as turns, string_agg(turn::varchar, ',' order by turn) as ids from conversations group by conv_id")
def dialog_export(s, d):
    none = F.lit(None).cast("string")
    records = read(s, d, "conversations").select(F.col("conv_id").alias("sample"), F.col("turn").alias("sq"), F.col("text").alias("user"), none.alias("memory_before"), F.array().cast("array<string>").alias("steps"), none.alias("memory_after"))
    return curation.dialogs(records).select(F.col("sample").alias("conv_id"), F.size("turns").cast("long").alias("turns"), F.array_join(F.transform("turns", lambda t: t["sq"].cast("string")), ",").alias("ids"))


@query("decomposed", """with a as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as sq from conversations where role = 'user'), m as (select c.conv_id, c.turn, max(a.sq) as sq from conversations c join a on a.conv_id = c.conv_id and a.turn <= c.turn and a.sq % 3 <> 2 group by 1, 2)
 select conv_id, sq, count(*) as messages from m group by 1, 2""")
def decomposed(s, d):
    """Every third user turn asks nothing known."""
    c = read(s, d, "conversations").select(F.col("conv_id").alias("trace"), F.col("turn").alias("pos"), "role")
    sq = F.row_number().over(W.partitionBy("trace").orderBy("pos"))
    anchors = c.where("role = 'user'").withColumn("sq", sq).select("trace", "sq", F.when(F.col("sq") % 3 != 2, F.col("pos")).alias("at"))
    return curation.decompose(c, anchors).groupBy(F.col("trace").alias("conv_id"), "sq").agg(F.count("*").alias("messages"))


@query("revalidated", """with l as (select o_custkey as dialog, o_orderkey as sq, o_orderkey % 3 = 0 as open, l_partkey % 50 as id, l_suppkey % 2 as name, l_discount > 0 as seen, l_tax > 0.07 as blank, l_quantity < 10 as bad, row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as ln from orders join lineitem on l_orderkey = o_orderkey),
 i as (select distinct dialog, sq, 'no final step' as issue, 0 as ln from l where open union all select dialog, sq, 'no observations', ln from l where not seen union all select dialog, sq, 'observation without id', ln from l where seen and blank union all select dialog, sq, 'call without observation', ln from l where not seen or blank
 union all select dialog, sq, 'not recovered', ln from l where seen and bad and not exists (select 1 from l x where x.sq = l.sq and x.ln > l.ln and x.seen and not x.bad and x.name = l.name) union all select dialog, sq, 'presentation call', ln from l where name = 1 and id = 7
 union all (select dialog, sq, 'repeated call', ln from l qualify row_number() over (partition by dialog, id order by sq, ln) > 1) union all (select dialog, sq, 'repeated observation', ln from l where seen and not blank qualify row_number() over (partition by dialog, id order by sq, ln) > 1))
 select dialog, sq, issue, count(*) as n from i group by 1, 2, 3""")
def revalidated(s, d):
    """Lines of an order are its steps; orders of a customer are a dialog."""
    l = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"))).alias("x"))  # noqa: E741

    def step(x):
        id_, name, bad = (x["l_partkey"] % 50).cast("string"), F.when(x["l_suppkey"] % 2 == 1, "python_code_executor").otherwise("t"), x["l_quantity"] < 10
        code = F.when(id_ == "7", F.lit('{"code": "import json\\nprint(json.dumps({}))"}')).otherwise("{}")
        seen = F.array(F.struct(F.when(x["l_tax"] <= 0.07, id_).alias("id"), name.alias("name"), F.when(bad, "NameError").otherwise("fine").alias("content"), (~bad).alias("success")))
        return F.struct(F.lit("tool_call").alias("type"), F.array(F.struct(id_.alias("id"), name.alias("name"), code.alias("arguments"))).alias("calls"), F.when(x["l_discount"] > 0, seen).otherwise(F.array().cast("array<struct<id:string,name:string,content:string,success:boolean>>")).alias("observations"))

    last = F.struct(F.lit("final_answer").alias("type"), F.lit(None).cast("array<struct<id:string,name:string,arguments:string>>").alias("calls"), F.lit(None).cast("array<struct<id:string,name:string,content:string,success:boolean>>").alias("observations"))
    steps = F.transform("x", step)
    records = read(s, d, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("dialog"), F.col("o_orderkey").alias("sq"), F.when(F.col("o_orderkey") % 3 == 0, steps).otherwise(F.concat(steps, F.array(last))).alias("steps"), F.lit("a").alias("answer"), F.lit("a").alias("old_answer"))
    return curation.revalidate(records).groupBy("dialog", "sq", "issue").agg(F.count("*").alias("n"))


@query("cleaned_dialogs", """with c as (select *, row_number() over (partition by user_id, event_type, props order by ts, event_id) as rn, count(distinct event_type || '|' || value) over (partition by user_id, event_type, props) as kinds from (select *, dense_rank() over (partition by user_id order by event_type) as sq from events where event_type <> 'error')),
 k as (select user_id, sq, ts, event_id, props from c where rn = 1 and value >= 20), n as (select user_id, sq, event_id, 'call_' || user_id || '_' || sq || '_' || printf('%03d', row_number() over (partition by user_id order by sq, ts, event_id) - 1) as call_id from k)
 select n.user_id as dialog, n.sq, count(*) as steps, min(call_id) as first, max(call_id) as last from n group by 1, 2""")
def cleaned_dialogs(s, d):
    """Types of a user's events are sub-questions; each event is a step whose call has its properties for an id; calls below 20 fail."""
    sq = F.dense_rank().over(W.partitionBy("user_id").orderBy("event_type"))
    failed = F.col("value") < 20
    step = F.struct(
        "ts", "event_id", F.lit("tool_call").alias("type"), F.lit("p").alias("plan"), F.array(F.struct(F.col("props").alias("id"), F.lit("t").alias("name"), F.lit("{}").alias("arguments"))).alias("calls"),
        F.array(F.struct(F.col("props").alias("id"), F.when(failed, "unsupported ScalarType BFloat16").otherwise("fine").alias("content"))).alias("observations"),
    )
    records = read(s, d, "events").where("event_type <> 'error'").withColumn("sq", sq).groupBy(F.col("user_id").alias("dialog"), "sq").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    records = records.withColumn("final", F.lit(None).cast("struct<answer:string,data_source:array<string>>"))
    ids = F.transform("steps", lambda x: x["calls"][0]["id"])
    made = curation.cleaned(records).where(F.size("steps") > 0)
    return made.select("dialog", F.col("sq").cast("long").alias("sq"), F.size("steps").cast("long").alias("steps"), F.array_min(ids).alias("first"), F.array_max(ids).alias("last"))
