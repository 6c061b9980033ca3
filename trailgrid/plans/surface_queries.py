"""Queries of the general surface: readers and writers, previews, audits, windows, functions and streams, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import answers as an
from ..operators import curation, dependencies, reports, traces
from ..sinks import files as sinks
from ..sources import tables, texts
from ..sources.tables import lines, read
from ..streaming import windows
from .registry import query


def _say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _place(s, name):
    return f"{texts.shared_folder(s)}/{name}-{uuid.uuid4().hex}"


_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)"


@query("preview_texts", f"select doc_id, '[' || doc_id || '] Total rows: ' || count(*) || ', remaining rows not shown: ' || greatest(0, count(*) - 2) || chr(10) || repeat('─', 40) || chr(10) || string_agg(printf('%3d| %s', line_no, rtrim(content)), chr(10) order by line_no) filter (where line_no <= 2) as text from {_LINES} group by 1")
def preview_texts(s, d):
    return tables.preview_texts(lines(read(s, d, "documents")), "doc_id", 1, 2)


@query("grep_slice", f"select doc_id, line_no::bigint as line_no from {_LINES} where regexp_matches(content, 'reserved|token|house|eau|casa|haus', 'i') order by doc_id, line_no limit 10 offset 5")
def grep_slice(s, d):
    docs = read(s, d, "documents").where(F.col("text").rlike("(?i)reserved|token|house|eau|casa|haus"))
    hits = lines(docs).where(F.col("content").rlike("(?i)reserved|token|house|eau|casa|haus")).select("doc_id", F.col("line_no").cast("long").alias("line_no"))
    return tables.matches_page(hits, 5, 10, "doc_id", "line_no")


@query("json_round_trip", "select o_orderkey, o_custkey, o_orderpriority as \"with\", case when o_orderkey % 2 = 0 then o_totalprice end as price from orders")
def json_round_trip(s, d):
    """Rows written as JSON lines, nulls included, and read in an explicit schema; a folder that isn't there adds nothing."""
    at = _place(s, "json")
    o = read(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("with"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice").cast("double")).alias("price"))
    sinks.json_lines(o, at)
    schema = "o_orderkey bigint, o_custkey bigint, `with` string, price double"
    return texts.json_lines(s, at, schema).unionByName(texts.json_lines(s, at + "/none", schema))


@query("request_lines", "select conv_id, count(*) as messages, max(length(coalesce(text, ''))) as longest from conversations group by 1")
def request_lines(s, d):
    """Conversations written as requests for a model, and read back."""
    at = _place(s, "requests")
    message = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    c = read(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    sinks.requests(c, at, "m", "conv_id")
    back = texts.json_lines(s, at, "custom_id string, body struct<model:string,messages:array<struct<role:string,content:string>>>")
    return back.select(F.col("custom_id").cast("long").alias("conv_id"), F.size("body.messages").cast("long").alias("messages"), F.array_max(F.transform("body.messages", lambda m: F.char_length(m["content"]))).cast("long").alias("longest"))


@query("sheets_as_csv", "select 'n_' || n_regionkey as sheet, n_nationkey, n_name from nation")
def sheets_as_csv(s, d):
    """Sheets with characters that file systems refuse, written apart and read back."""
    at = _place(s, "sheets")
    sinks.tables_by_sheet(read(s, d, "nation").select(_say("n", ":", F.col("n_regionkey")).alias("sheet"), "n_nationkey", "n_name"), at)
    return s.read.option("header", True).option("basePath", at).schema("n_nationkey bigint, n_name string, sheet string").csv(at).select("sheet", "n_nationkey", "n_name")


@query("renamed_columns", "select n_nationkey as \"key-of\", n_name as name from nation")
def renamed_columns(s, d):
    at = _place(s, "header")
    sinks.with_header(read(s, d, "nation").select("n_nationkey", "n_name"), ["key-of", "name"], at)
    return s.read.option("header", True).csv(at).withColumn("key-of", F.col("key-of").cast("long"))


@query("file_scores", """select round(avg(l_discount::double * 10), 6) as strict_recall, round(avg(l_tax::double * 10), 6) as strict_precision, round(avg(case when l_linenumber > 2 then l_discount::double else 0 end), 6) as strict_f1,
 round(avg(l_discount::double * 10) filter (where l_quantity <= 40), 6) as recall, round(avg(l_tax::double * 10) filter (where l_quantity <= 40), 6) as precision, round(avg(case when l_linenumber > 2 then l_discount::double else 0 end) filter (where l_quantity <= 40), 6) as f1 from lineitem""")
def file_scores(s, d):
    steps = read(s, d, "lineitem").select((F.col("l_discount") * 10).alias("recall"), (F.col("l_tax") * 10).alias("precision"), F.when(F.col("l_linenumber") > 2, F.col("l_discount")).alias("f1"), F.when(F.col("l_quantity") > 40, True).alias("is_missing"))
    made = reports.file_scores(steps)
    return made.select(*[F.round(c, 6).alias(c) for c in made.columns])


@query("dialog_audits", """with r as (select o_custkey as sample, o_orderstatus as candidate, count(*) as found, bool_and(o_totalprice > 20000) as ok from orders group by 1, 2)
 select sample, candidate, found, case when sample % 5 > 0 then sample % 4 else 0 end as wanted, ok and case when sample % 5 > 0 then sample % 4 else 0 end > 0 and found = sample % 4 as passes, case when sample % 5 = 0 or sample % 4 = 0 then 'no gold' when found <> sample % 4 then 'count differs' end as issue from r""")
def dialog_audits(s, d):
    o = read(s, d, "orders")
    records = o.select(F.col("o_custkey").alias("sample"), F.col("o_orderstatus").alias("candidate"), (F.col("o_totalprice") > 20000).alias("passes"))
    gold = o.where("o_custkey % 5 > 0").select(F.col("o_custkey").alias("sample"), (F.col("o_custkey") % 4).alias("wanted"))
    return reports.dialog_audits(records, gold)


@query("tool_error_audit", """with e as (select *, event_type = 'error' as bad from events), l as (select e.user_id, count(*) as lost from e where bad and not exists (select 1 from events x where x.user_id = e.user_id and x.event_type <> 'error' and x.ts > e.ts and x.props = e.props) group by 1)
 select e.user_id, count(*) filter (where bad) as errors, count(*) filter (where bad and value < 30) as infrastructure, coalesce(max(lost), 0) as unrecovered from e left join l using (user_id) group by 1""")
def tool_error_audit(s, d):
    e = read(s, d, "events").select(F.col("user_id").alias("trace"), F.col("ts").alias("step"), F.lit("t").alias("tool"), F.array("props").alias("targets"), (F.col("event_type") != "error").alias("success"), F.when(F.col("value") < 30, "ScalarType").otherwise("x").alias("content"))
    return reports.tool_error_audit(e, traces.unrecovered(e), curation.ERROR_MARKS).withColumnRenamed("trace", "user_id")


@query("parallel_calls", "with m as (select l_orderkey, l_linenumber % 3 as calls from lineitem) select l_orderkey as trace, sum(calls)::bigint as tools, round(coalesce(sum(calls) / nullif(count(*) filter (where calls > 0), 0), 0), 6) as parallelism from m group by 1 having count(*) filter (where calls > 0) > 0")
def parallel_calls(s, d):
    """Lines of an order are messages with up to two calls."""
    call = F.struct(F.lit("f").alias("name"), F.lit("{}").alias("arguments"))
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    m = read(s, d, "lineitem").select(F.col("l_orderkey").alias("trace"), pos.alias("pos"), F.lit("assistant").alias("role"), F.lit("").alias("content"), F.array_repeat(call, (F.col("l_linenumber") % 3).cast("int")).alias("calls"))
    made = traces.tool_metrics(traces.actions(m)).where("tools > 0")
    return made.select("trace", "tools", F.round("parallelism", 6).alias("parallelism"))


@query("recovery_tags", "select event_id, list_filter([case when event_id % 3 = 0 then 'IndexError' end, case when event_id % 2 = 0 then 'NameError' end], lambda x: x is not null) as tags from events")
def recovery_tags(s, d):
    k = F.col("event_id")
    text = _say("at 1: ", F.when(k % 2 == 0, "NameError: x, NameError").otherwise("MyNameErrors"), " then ", F.when(k % 3 == 0, "IndexError").otherwise("none"))
    return read(s, d, "events").select("event_id", reports.recovery_tags(text).alias("tags"))


@query("complete_dialogs", "select l_orderkey, max(l_linenumber) = count(distinct l_linenumber) and min(l_linenumber) = 1 and count(distinct l_linenumber) = 3 as complete from lineitem group by 1")
def complete_dialogs(s, d):
    return read(s, d, "lineitem").groupBy("l_orderkey").agg(reports.complete(F.collect_list(F.col("l_linenumber").cast("int")), F.lit(3)).alias("complete"))


@query("cache_figures", "select count(*) as entries, round(sum(octet_length(encode(coalesce(text, '')))) / 1048576, 6) as megabytes from documents")
def cache_figures(s, d):
    return reports.cache_figures(read(s, d, "documents").select(F.col("text").alias("value")))


@query("answer_objects", """select o_orderkey, ['in a code block', null, 'no object', 'no JSON', 'empty', 'empty object'][o_orderkey % 6 + 1] as issue, case o_orderkey % 6 when 0 then o_custkey::varchar when 1 then 'p' || o_custkey when 2 then '{"_raw":[1]}' end as first from orders""")
def answer_objects(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = (
        F.when(k % 6 == 0, _say('Here:\n```json\n{"answer": "', c, '"}\n```')).when(k % 6 == 1, _say('{"score_points": [{"scorepoint": "p', c, '", "table": "t.csv"}, "q"]}')).when(k % 6 == 2, "[1]")
        .when(k % 6 == 3, "plain words").when(k % 6 == 4, " ").otherwise("{ }")
    )
    rows = read(s, d, "orders").select("o_orderkey", an.answer_object(text).alias("a"))
    return rows.select("o_orderkey", "a.issue", F.when(F.col("a.object").isNotNull(), F.get(an.claims_of(F.col("a.object")), F.lit(0))["text"]).alias("first"))


@query("answer_claims", "select o_orderkey, unnest(case o_orderkey % 3 when 0 then ['a' || o_custkey, 'v', 'plain'] when 1 then ['p' || o_custkey, 'q'] else ['{\"x\":' || o_custkey || '}'] end) as claim, unnest(case o_orderkey % 3 when 0 then ['', 't.csv', ''] when 1 then ['t.csv', ''] else [''] end) as file from orders")
def answer_claims(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(k % 3 == 0, _say('{"answer":"a', c, '","claims":[{"value":"v","data_source":"t.csv"},"plain"]}')).when(k % 3 == 1, _say('{"score_points":[{"scorepoint":"p', c, '","table":"t.csv"},"q"],"answer":"no"}')).otherwise(_say('{"x":', c, "}"))
    return read(s, d, "orders").select("o_orderkey", F.explode(an.claims_of(text)).alias("c")).select("o_orderkey", F.col("c.text").alias("claim"), "c.file")


@query("invalid_calls", "select o_orderkey, case when o_custkey % 7 = 0 then 'no name' when o_custkey % 5 = 0 then 'unknown tool' when o_orderkey % 3 = 0 then 'arguments are no object' end as why from orders")
def invalid_calls(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(c % 7 == 0, " ").when(c % 5 == 0, "walk").otherwise("head")
    told = F.when(k % 3 == 0, F.when(k % 2 == 0, "[1]").otherwise("{broken")).when(k % 3 == 1, '{"a": 1}')
    return read(s, d, "orders").select("o_orderkey", an.invalid_call(name, told, "head", "tail").alias("why"))


@query("enriched_items", """select o_custkey as sample, o_orderkey as sq, case when o_orderkey % 2 = 1 then 'raw_value' when o_orderkey % 4 = 0 then 'derived_value' else 'text_fact' end as kind, round(case when o_orderkey % 2 = 1 then 0.6 else 0.75 - 0.05 * ((o_custkey % 3 = 0)::int + 1) - 0.1 * (o_orderkey % 4 = 0 and o_custkey % 5 = 0)::int end::double, 6) as confidence from orders""")
def enriched_items(s, d):
    """A model told of even sub-questions."""
    k, c, null = F.col("o_orderkey"), F.col("o_custkey"), F.lit(None).cast("string")
    o = read(s, d, "orders")
    item = lambda kind, entity, operation: [c.alias("sample"), k.alias("sq"), kind.alias("kind"), F.lit("7").alias("value"), entity.alias("entity"), F.lit("t").alias("time"), F.lit("m").alias("metric"), null.alias("unit"), operation.alias("operation")]
    rule = o.select(*item(F.lit("raw_value"), null, null), F.lit(0.6).alias("confidence"))
    told = o.where("o_orderkey % 2 = 0").select(*item(F.when(k % 4 == 0, "derived_value").otherwise("odd"), F.when(c % 3 > 0, "e"), F.when(c % 5 > 0, "sum")))
    return dependencies.enriched(rule, told).select("sample", "sq", "kind", F.round("confidence", 6).alias("confidence"))


@query("theta_join", "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey < b.n_regionkey and a.n_nationkey > b.n_nationkey")
def theta_join(s, d):
    n = read(s, d, "nation")
    return n.alias("a").join(F.broadcast(n.alias("b")), (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") > F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))  # 25 rows


@query("cross_join", "select r_regionkey, s_suppkey from region, supplier")
def cross_join(s, d):
    return read(s, d, "supplier").select("s_suppkey").crossJoin(F.broadcast(read(s, d, "region").select("r_regionkey")))  # 5 rows


@query("range_join", "select o_orderkey, n_nationkey from orders join nation on o_totalprice >= n_nationkey * 20000 and o_totalprice < (n_nationkey + 1) * 20000")
def range_join(s, d):
    """Ranges of equal width as a join on their number: no pair outside a range is ever made."""
    n = read(s, d, "nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("at"))
    return read(s, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 20000).alias("at")).join(n, "at").select("o_orderkey", "n_nationkey")


@query("analytic_windows", """select o_orderkey, rank() over w as rnk, dense_rank() over w as dense, ntile(4) over o as quarter, round(percent_rank() over w, 6) as share, round(cume_dist() over w, 6) as dist, first_value(o_orderkey) over o as first, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as second,
 round(avg(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) + 1e-6, 2) as rolling, round(o_totalprice / lag(o_totalprice) over o - 1, 6) as change from orders window w as (partition by o_custkey order by o_orderpriority), o as (partition by o_custkey order by o_orderkey)""")
def analytic_windows(s, d):
    w, o = W.partitionBy("o_custkey").orderBy("o_orderpriority"), W.partitionBy("o_custkey").orderBy("o_orderkey")
    whole, price = o.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), F.col("o_totalprice")
    return read(s, d, "orders").select(
        "o_orderkey", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(o).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("share"), F.round(F.cume_dist().over(w), 6).alias("dist"),
        F.first("o_orderkey").over(o).alias("first"), F.nth_value("o_orderkey", 2).over(whole).alias("second"), F.round(F.avg(price).over(o.rowsBetween(-2, 0)) + 1e-6, 2).alias("rolling"), F.round(price / F.lag(price).over(o) - 1, 6).alias("change"),
    )


@query("text_functions", "select c_custkey, upper(c_name) as up, reverse(c_name) as back, lpad(c_custkey::varchar, 8, '0') as padded, replace(c_mktsegment, 'A', 'a') as swapped, length(c_name) as n, split_part(c_name, '#', 2) as part, md5(c_name) as digest from customer")
def text_functions(s, d):
    return read(s, d, "customer").select("c_custkey", F.upper("c_name").alias("up"), F.reverse("c_name").alias("back"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"), F.replace("c_mktsegment", F.lit("A"), F.lit("a")).alias("swapped"), F.char_length("c_name").cast("long").alias("n"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("part"), F.md5("c_name").alias("digest"))


@query("date_functions", "select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as m, dayofyear(o_orderdate) as doy, date_diff('day', date '1992-01-01', o_orderdate::date) as days, last_day(o_orderdate::date) as last, strftime(o_orderdate, '%Y/%m') as label from orders")
def date_functions(s, d):
    at = F.col("o_orderdate").cast("date")
    return read(s, d, "orders").select("o_orderkey", F.year(at).alias("y"), F.quarter(at).alias("q"), F.month(at).alias("m"), F.dayofyear(at).alias("doy"), F.datediff(at, F.lit("1992-01-01").cast("date")).alias("days"), F.last_day(at).alias("last"), F.date_format(at, "yyyy/MM").alias("label"))


@query("array_functions", "select l_orderkey, list_sort(list_distinct(list(l_linenumber))) as lines, len(list(l_linenumber)) as n, list_max(list(l_quantity)) as most, round(list_sum(list(l_quantity)), 2) as total, list_contains(list(l_linenumber), 3) as third from lineitem group by 1")
def array_functions(s, d):
    g = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"), F.collect_list("l_quantity").alias("q"))
    return g.select("l_orderkey", F.array_sort(F.array_distinct("a")).alias("lines"), F.size("a").cast("long").alias("n"), F.array_max("q").alias("most"), F.round(F.aggregate(F.transform("q", lambda x: x.cast("double")), F.lit(0.0), lambda t, x: t + x), 2).alias("total"), F.array_contains("a", 3).alias("third"))


@query("json_functions", "select event_id, json_extract_string(props, '$.k')::bigint as k, json_valid(props) as valid, '{\"u\":' || user_id || ',\"t\":\"' || event_type || '\"}' as made from events")
def json_functions(s, d):
    made = F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t")))
    return read(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.try_parse_json("props").isNotNull().alias("valid"), made.alias("made"))


@query("distinct_aggregates", "select l_returnflag, count(distinct l_suppkey) as suppliers, count(distinct (l_suppkey, l_partkey)) as pairs, round(sum(distinct l_quantity), 2) as quantities, max(l_tax) filter (where l_quantity > 10) as tax, round(corr(l_quantity::double, l_extendedprice::double), 6) as r from lineitem group by 1")
def distinct_aggregates(s, d):
    c = F.col
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_suppkey", "l_partkey").alias("pairs"), F.round(F.sum_distinct("l_quantity"), 2).alias("quantities"), F.max(F.when(c("l_quantity") > 10, c("l_tax"))).alias("tax"), F.round(F.corr(c("l_quantity").cast("double"), c("l_extendedprice").cast("double")), 6).alias("r"))


@query("resampled", "select date_trunc('hour', ts) as hour, count(*) as n, round(avg(value), 6) as mean, arg_min(value, (ts, event_id)) as opened, arg_max(value, (ts, event_id)) as closed from events group by 1")
def resampled(s, d):
    at = F.struct("ts", "event_id")
    return read(s, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min_by("value", at).alias("opened"), F.max_by("value", at).alias("closed"))


@query("stream_sliding", "select s as start, event_type, count(*) as n from (select *, unnest([time_bucket(interval '6 hours', ts), time_bucket(interval '6 hours', ts) - interval '6 hours']) as s from events) group by 1, 2")
def stream_sliding(s, d):
    made = windows.sliding(windows.events(s, d), "12 hours", "6 hours", None, "event_type").agg(F.count("*").alias("n"))
    return windows.run(made.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n"), ["start", "event_type"])


@query("stream_increments", "select event_type, count(*) as n from events group by 1")
def stream_increments(s, d):
    """Two runs over one folder: the second finds nothing new and adds nothing."""
    at = _place(s, "increments")
    for _ in range(2):
        rows = windows.run(windows.events(s, d).select("event_type", "event_id"), [], "append", at)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query("first_times", "select o_orderkey, case when o_orderkey % 3 > 0 then year(o_orderdate) || '年' || case when o_orderkey % 3 = 1 then month(o_orderdate) || '月上旬' else '' end end as time from orders")
def first_times(s, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 3 == 0, _say("no time in ", k)).when(k % 3 == 1, _say("于", F.year(at), "年", F.month(at), "月上旬，后于1999年")).otherwise(_say("在", F.year(at), "年，"))
    return read(s, d, "orders").select("o_orderkey", an.first_time(text).alias("time"))


@query("group_keys", "select l_orderkey, l_linenumber, 'task_' || l_orderkey || '_sq' || l_linenumber as rollout_group from lineitem")
def group_keys(s, d):
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", an.group_key(_say("task_", F.col("l_orderkey"), "_sq", F.col("l_linenumber"), "_k", F.col("l_partkey"))).alias("rollout_group"))


@query("same_answers", "select o_orderkey, o_orderkey % 4 = 0 and o_custkey % 2 = 0 as strict, o_orderkey % 4 < 3 and o_custkey % 2 = 0 as lenient from orders")
def same_answers(s, d):
    """Answers by k % 4: equal, equal but for spaces, of the same numbers in other words, and of other numbers; half of them name another source."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = _say("in ", c + 1000, " of ", k + 5000, " cases, 12%")
    other = F.when(k % 4 == 0, text).when(k % 4 == 1, F.concat(F.lit("  "), F.replace(text, F.lit(" "), F.lit("   ")))).when(k % 4 == 2, _say("12% of ", k + 5000, "; ", c + 1000)).otherwise(_say("about ", c + 7, " of ", k + 3, " or 99%"))
    answer = lambda t, f: F.struct(t.alias("answer"), F.array(F.lit("a"), f).alias("data_source"))
    a, b = answer(text, F.lit("b")), F.struct(other.alias("answer"), F.array(F.when(c % 2 == 0, "b").otherwise("c"), F.lit("a")).alias("data_source"))
    return read(s, d, "orders").select("o_orderkey", an.same_answer(a, b).alias("strict"), an.same_answer(a, b, False).alias("lenient"))


@query("aligned_steps", """with t as (select *, sum((role = 'user')::int) over (partition by conv_id order by turn) as q from conversations where role <> 'system'), p as (select conv_id, q, arg_min(text, turn) filter (where role = 'assistant') as answer, max(text) filter (where role = 'user') as asked from t where q > 0 group by 1, 2),
 n as (select conv_id, row_number() over (partition by conv_id order by q) as step_index, answer from p where asked <> ''), g as (select conv_id, unnest(range(1, count(*) + 2)) as step_index from n group by 1) select g.conv_id, g.step_index, coalesce(n.answer = '', true) as is_missing from g left join n on n.conv_id = g.conv_id and n.step_index = g.step_index""")
def aligned_steps(s, d):
    """Gold has one step more than a conversation has questions."""
    none = F.lit(None).cast("array<struct<name:string,arguments:string>>")
    m = read(s, d, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("trace"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"), none.alias("calls"))
    found = traces.pairs(traces.actions(m))
    gold = found.groupBy("trace").agg(F.count("*").alias("n")).select("trace", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") + 1)).alias("step_index"))
    return traces.align(gold, found.withColumn("step_index", F.col("step_index").cast("long"))).select(F.col("trace").alias("conv_id"), "step_index", "is_missing")
