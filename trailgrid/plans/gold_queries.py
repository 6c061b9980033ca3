"""Queries of gold samples, evaluations, reports and audits over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import gold, reports, rewards
from ..sources.tables import read
from .registry import query

_ASKED = "(select conv_id, arg_min(text, turn) as query from conversations where role = 'user' group by 1)"
_TASKS = f"(select conv_id as pos, case conv_id % 4 when 0 then query when 1 then substr(query, 1, 30) when 2 then 'Please: ' || query || ' Thanks.' else substr(query, 5, 6) end as task from {_ASKED})"
_TRIM = "coalesce(regexp_replace({0}, '^\\s+|\\s+$', '', 'g'), '')"
_MET = f"(select a.conv_id, t.pos, length({_TRIM.format('t.task')}) as n, {_TRIM.format('t.task')} = {_TRIM.format('a.query')} as same from {_ASKED} a join {_TASKS} t on {_TRIM.format('t.task')} = {_TRIM.format('a.query')} or ({_TRIM.format('a.query')} <> '' and contains({_TRIM.format('t.task')}, {_TRIM.format('a.query')})) or ({_TRIM.format('t.task')} <> '' and contains({_TRIM.format('a.query')}, {_TRIM.format('t.task')})))"


def _asked(s, d):
    c = read(s, d, "conversations").where("role = 'user'")
    asked = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    k = F.col("conv_id") % 4
    task = F.when(k == 0, F.col("query")).when(k == 1, F.substring("query", 1, 30)).when(k == 2, F.concat(F.lit("Please: "), "query", F.lit(" Thanks."))).otherwise(F.substring("query", 5, 6))
    return asked.select(F.col("conv_id").alias("trace"), "query"), asked.select(F.col("conv_id").alias("pos"), task.alias("task"))


@query("gold_first_sample", f"select a.conv_id, min(m.pos) as pos from {_ASKED} a left join {_MET} m using (conv_id) group by 1")
def gold_first_sample(s, d):
    """The first questions of conversations against tasks made of all of them: equal, parts, and wholes with more around."""
    return gold.first_sample(*_asked(s, d)).select(F.col("trace").alias("conv_id"), "pos")


@query("gold_best_sample", f"select a.conv_id, arg_min(m.pos, (case when m.same then 0 else 1 end, case when m.same then 0 else -m.n end, m.pos)) as pos from {_ASKED} a left join {_MET} m on m.conv_id = a.conv_id and {_TRIM.format('a.query')} <> '' group by 1")
def gold_best_sample(s, d):
    return gold.best_sample(*_asked(s, d)).select(F.col("trace").alias("conv_id"), "pos")


@query("anchored_questions", """with u as (select conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') as text, row_number() over (partition by conv_id order by turn) as sq from conversations where role = 'user'),
 i as (select conv_id, sq, regexp_replace(case sq % 3 when 0 then 'unasked ' || sq when 1 then text else substr(text, 3, 25) end, '^\\s+|\\s+$', '', 'g') as item from u),
 m as (select i.conv_id, i.sq, min((case when u.text = i.item then 0 else 2 end, u.turn)) as x from i join u on u.conv_id = i.conv_id and contains(u.text, i.item) where i.item <> '' group by 1, 2),
 r as (select conv_id, sq, x[1] as rank, x[2] as turn, row_number() over (partition by conv_id, x[2] order by x[1], sq) as rn from m)
 select i.conv_id, i.sq, case when rn = 1 then r.turn end as turn, case when r.sq is null then 'unmatched' when rn > 1 then 'claimed' when rank = 0 then 'exact' else 'substring' end as how from i left join r on r.conv_id = i.conv_id and r.sq = i.sq where i.item <> ''""")
def anchored_questions(s, d):
    """Every third item is a user message, every third a part of one, and every third asks nothing that was said."""
    c = read(s, d, "conversations").select(F.col("conv_id").alias("trace"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    u = c.where("role = 'user'").withColumn("sq", F.row_number().over(W.partitionBy("trace").orderBy("pos")))
    text = F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "")
    item = F.when(F.col("sq") % 3 == 0, F.concat(F.lit("unasked "), F.col("sq").cast("string"))).when(F.col("sq") % 3 == 1, text).otherwise(F.substring(text, 3, 25))
    # Normal forms say what equal texts and parts do here, so their rank is folded into the others'.
    found = gold.find_anchors(c, u.select("trace", "sq", item.alias("item")))
    return found.select(F.col("trace").alias("conv_id"), "sq", F.col("at").alias("turn"), F.when(F.col("how") == "normalized", "substring").otherwise(F.col("how")).alias("how"))


@query("aligned_evaluations", """with l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as sq, l_discount, l_quantity from lineitem)
 select l_orderkey, sq, case when sq <= 3 then l_discount end as coverage, l_quantity >= 25 as has_answer, (l_quantity < 25)::bigint + (sq % 2 = 0)::bigint as issues from l""")
def aligned_evaluations(s, d):
    """Lines of an order are sub-questions; only the first three were evaluated."""
    sq = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    l = read(s, d, "lineitem").withColumn("sq", sq)  # noqa: E741
    steps = l.where("sq <= 3").groupBy(F.col("l_orderkey").alias("candidate")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sq", "l_discount"))), lambda x: x["l_discount"]).alias("coverage"))
    answer = F.struct(F.when(F.col("l_quantity") >= 25, "x").otherwise(" ").alias("answer"), F.when(F.col("sq") % 2 == 1, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("data_source"))
    made = gold.align_evaluations(l.select(F.col("l_orderkey").alias("candidate"), "sq", answer.alias("answer")), steps, "coverage")
    return made.select(F.col("candidate").alias("l_orderkey"), "sq", "coverage", F.col("format_audit.has_answer").alias("has_answer"), F.size("format_audit.format_issues").cast("long").alias("issues"))


@query("file_matches", """with p as (select l_orderkey, list_distinct(list('p' || l_partkey % 40)) as t, list_distinct(list('p' || l_suppkey % 40)) as m from lineitem group by 1),
 c as (select l_orderkey, len(list_filter(t, lambda a: len(list_filter(m, lambda b: contains(a, b) or contains(b, a))) > 0)) as covered, len(list_filter(m, lambda b: len(list_filter(t, lambda a: contains(a, b) or contains(b, a))) > 0)) as correct, len(t) as nt, len(m) as nm from p)
 select l_orderkey, covered, correct, round(covered / nt, 6) as recall, round(correct / nm, 6) as precision, round(coalesce(2 * (covered / nt) * (correct / nm) / nullif(covered / nt + correct / nm, 0), 0), 6) as f1 from c""")
def file_matches(s, d):
    name = lambda c, a, b: F.concat(F.lit(a), (F.col(c) % 40).cast("string"), F.lit(b))
    p = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(name("l_partkey", "a/b/p", ".xlsx")).alias("t"), F.collect_set(name("l_suppkey", "c/p", "_merged.csv")).alias("m"))
    made = p.select("l_orderkey", gold.files_match(F.col("t"), F.col("m")).alias("x")).select("l_orderkey", "x.*")
    return made.select("l_orderkey", F.col("covered").cast("long").alias("covered"), F.col("correct").cast("long").alias("correct"), *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query("sample_ids", "select doc_id, coalesce(nullif(lang, ''), nullif(source, ''), doc_id::varchar) as id from documents")
def sample_ids(s, d):
    return read(s, d, "documents").select("doc_id", gold.sample_id("lang", "source", "doc_id").alias("id"))


_TOKENS = "len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]'))"


@query("trace_tokens", f"select conv_id, count(*) as messages, sum({_TOKENS})::bigint as tokens from conversations group by 1")
def trace_tokens(s, d):
    return reports.trace_tokens(read(s, d, "conversations").select(F.col("conv_id").alias("trace"), F.col("text").alias("content"))).select(F.col("trace").alias("conv_id"), "messages", "tokens")


@query("run_summary", f"""with r as (select conv_id, bool_or(role = 'assistant') as success, count(*) filter (where role = 'user') as turns, sum({_TOKENS}) as tokens, avg((role = 'assistant')::int) as rate, max(turn) as par from conversations group by 1)
 select count(*) as runs, count(*) filter (where success) as succeeded, round(avg(success::int), 6) as success_share, round(avg(turns), 6) as avg_turns, round(avg(tokens), 4) as avg_tokens, max(tokens)::double as max_tokens, min(tokens)::double as min_tokens, round(avg(rate), 6) as avg_success_rate, round(avg(par), 6) as avg_parallelism from r""")
def run_summary(s, d):
    c, role = read(s, d, "conversations"), F.col("role")
    runs = c.groupBy("conv_id").agg(F.max(role == "assistant").alias("success"), F.count_if(role == "user").alias("turns"), F.sum(reports.token_count(F.col("text"))).alias("tokens"), F.avg((role == "assistant").cast("int")).alias("success_rate"), F.max("turn").alias("parallelism"))
    made = reports.run_summary(runs)
    places = {"success_share": 6, "avg_turns": 6, "avg_tokens": 4, "avg_success_rate": 6, "avg_parallelism": 6}
    return made.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in made.columns])


@query("special_cases", "select l_orderkey, l_linenumber from lineitem where l_quantity / 25.0 >= 1 and l_discount * 20 < 1 and l_tax > 0")
def special_cases(s, d):
    steps = read(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 25).alias("coverage"), F.when(F.col("l_tax") > 0, F.col("l_discount") * 20).alias("recall"))
    return reports.special_cases(steps).select("l_orderkey", "l_linenumber")


@query("warning_counts", "select props, count(*) as n from events group by 1 order by n desc, props limit 15")
def warning_counts(s, d):
    return reports.counters(read(s, d, "events"), "props", 15)


@query("usage_totals", "select conv_id, sum(length(text)) filter (where role <> 'assistant' and text is not null)::bigint as prompt, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as completion, coalesce(sum(length(text)), 0)::bigint as total from (select conv_id, role, text from conversations union all select conv_id, 'user', '' from conversations) group by 1")
def usage_totals(s, d):
    said, n = F.col("role") == "assistant", F.char_length("text")
    return reports.usage_totals(read(s, d, "conversations").select(F.col("conv_id").alias("trace"), F.when(~said, n).alias("prompt"), F.when(said, n).alias("completion"))).select(F.col("trace").alias("conv_id"), *[F.col(c).cast("long").alias(c) for c in ("prompt", "completion", "total")])


@query("counterfactual_summary", "select count(distinct user_id) as rollouts, count(*) filter (where event_type <> 'view') as eligible, count(*) filter (where event_type <> 'view' and value > 40) as executed, count(*) filter (where event_type <> 'view' and value <= 40) as skipped from events")
def counterfactual_summary(s, d):
    return reports.counterfactual_summary(read(s, d, "events").select(F.col("user_id").alias("rollout"), (F.col("event_type") != "view").alias("eligible"), (F.col("value") > 40).alias("executed")))


@query("export_summary", "select count(*) as dialogs, count(*) filter (where o_totalprice >= 50000 and o_orderstatus <> 'P') as exported, count(*) filter (where o_totalprice < 50000 or o_orderstatus = 'P') as skipped, round(avg((o_totalprice < 50000 or o_orderstatus = 'P')::int), 6) as skip_rate, count(*) filter (where o_totalprice >= 50000 and o_orderstatus <> 'P') > 0 as ok from orders")
def export_summary(s, d):
    issues = F.array_compact(F.array(F.when(F.col("o_totalprice") < 50000, "cheap"), F.when(F.col("o_orderstatus") == "P", "open")))
    return reports.export_summary(read(s, d, "orders").select(issues.alias("issues"))).withColumn("skip_rate", F.round("skip_rate", 6))


@query("evidence_issues", """with i as (select o_orderkey, ['raw_value', 'derived_value', 'text_fact', 'other'][o_custkey % 4 + 1] as kind, case when o_orderkey % 5 = 0 then ' ' else left(o_orderpriority, 1 + o_orderkey % 2) end as value, case when o_custkey % 3 > 0 then 'sum' end as op, o_totalprice > 100000 as has from orders)
 select o_orderkey, list_filter([case when trim(value) = '' then 'missing value' end, case when kind = 'derived_value' and op is null then 'missing operation' end, case when kind = 'other' then 'unknown kind' end, case when kind = 'derived_value' and not has then 'derived without inputs' end, case when kind = 'text_fact' and trim(value) <> '' and length(value) < 2 then 'text too short' end], lambda x: x is not null) as issues from i""")
def evidence_issues(s, d):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("raw_value", "derived_value", "text_fact", "other"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    item = F.struct(
        F.lit("s").alias("sample"), F.lit(1).alias("sq"), F.lit("e").alias("item"), kind.alias("kind"), F.when(k % 5 == 0, " ").otherwise(F.left("o_orderpriority", (1 + k % 2).cast("int"))).alias("value"),
        F.when(F.col("o_custkey") % 3 > 0, "sum").alias("operation"), F.when(F.col("o_totalprice") > 100000, F.array(F.lit("e0"))).alias("inputs"),
    )
    return read(s, d, "orders").select("o_orderkey", reports.evidence_issues(item).alias("issues"))


@query("dependency_issues", """with i as (select o_orderkey, ['numeric_fact', 'entity_set', 'constraint', 'other'][o_custkey % 4 + 1] as kind, o_orderkey % 3 = 0 as bare from orders)
 select o_orderkey, list_concat(list_concat(case when kind = 'other' then ['unknown kind'] else [] end, case when o_orderkey % 7 = 0 then ['missing needed_by'] else [] end), case when not bare then case kind when 'numeric_fact' then ['missing metric', 'missing value', 'missing unit'] else [] end when kind = 'numeric_fact' then ['missing entity', 'missing time', 'missing metric', 'missing value', 'missing unit'] when kind = 'entity_set' then ['missing entities'] when kind = 'constraint' then ['missing constraint_content'] else [] end) as issues from i""")
def dependency_issues(s, d):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("numeric_fact", "entity_set", "constraint", "other"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    held = F.create_map(*[F.lit(x) for pair in (("entity", "e"), ("time", "t"), ("entities", "a"), ("constraint_content", "c")) for x in pair])
    item = F.struct(F.lit("d").alias("id"), kind.alias("kind"), F.when(k % 7 > 0, "sq2").alias("needed_by"), F.when(k % 3 > 0, held).otherwise(F.create_map().cast("map<string,string>")).alias("fields"))
    return read(s, d, "orders").select("o_orderkey", reports.dependency_issues(item).alias("issues"))


@query("audit_checks", """select * from (select 'evidence of sub-questions' as check, count(*) > 0 as pass, 0::bigint as bad from orders union all select 'dependencies look ahead', count(*) filter (where l_tax > 0.07) = 0, count(*) filter (where l_tax > 0.07) from lineitem
 union all select 'derived items have inputs', count(*) filter (where o_orderstatus = 'F' and o_custkey % 9 = 0) = 0, count(*) filter (where o_orderstatus = 'F' and o_custkey % 9 = 0) from orders union all select 'rewards are whole', count(*) filter (where event_type = 'error') = 0, count(*) filter (where event_type = 'error') from events union all select 'report is written', true, 0)""")
def audit_checks(s, d):
    evidence = read(s, d, "orders").select(F.col("o_custkey").alias("sample"), F.col("o_orderkey").alias("sq"), F.when(F.col("o_orderstatus") == "F", "derived_value").otherwise("raw_value").alias("kind"), F.when(F.col("o_custkey") % 9 > 0, F.array(F.lit(1))).alias("inputs"))
    needs = read(s, d, "lineitem").select(F.col("l_linenumber").alias("boundary"), (F.col("l_linenumber") + F.when(F.col("l_tax") > 0.07, 0).otherwise(1)).alias("needed_by"))
    scores = read(s, d, "events").select(F.col("value").alias("r_tool"), F.when(F.col("event_type") != "error", 0.5).alias("r_answer"), F.lit(0.1).alias("r_memory"))
    return reports.audit_checks(evidence, needs, scores, "# Audit")


@query("batch_sizes", f"with t as (select source, max({_TOKENS}) as n from documents group by 1) select source, case when n > 4096 then 4 when n > 2048 then 8 when n > 1024 then 16 when n > 512 then 32 else 64 end as size from t")
def batch_sizes(s, d):
    t = read(s, d, "documents").groupBy("source").agg(F.max(reports.token_count(F.col("text"))).alias("n"))
    return t.select("source", reports.batch_size(F.col("n")).alias("size"))


@query("tool_rewards", "select event_id, round(value / 100 - 0.02 - 1.0 * (event_type = 'error')::int - 0.2 * (row_number() over (partition by user_id, props order by ts, event_id) > 1 and value < 50)::int, 6) as r_tool from events")
def tool_rewards(s, d):
    again = (F.row_number().over(W.partitionBy("user_id", "props").orderBy("ts", "event_id")) > 1) & (F.col("value") < 50)
    return read(s, d, "events").select("event_id", F.round(rewards.tool_reward(F.col("value") / 100, F.col("event_type") == "error", again), 6).alias("r_tool"))


@query("counterfactual_rewards", "select event_id, round(greatest(-1, least(1, value / 100 - 0.5 + 0.2 * case when (value - 30) / 20 > 0 and event_id % 10 < 8 then 0 else greatest(-1, least(1, (value - 30) / 20)) end)), 6) as r from events")
def counterfactual_rewards(s, d):
    return read(s, d, "events").select("event_id", F.round(rewards.counterfactual((F.col("value") - 30) / 20, F.col("event_id") % 10 / 10, F.col("value") / 100 - 0.5), 6).alias("r"))
