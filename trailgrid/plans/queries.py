"""The queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as tx
from ..operators import reports, rewards
from ..sources.tables import lines, read, spread
from .registry import query

PATTERN = r"license|\btoken\b"
_LINES = "(select doc_id, source, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line_no from documents)"


def _hits(spark, d):
    # A text without a match has no line with one: most are dropped before they are cut into lines.
    docs = spread(read(spark, d, "documents").select("doc_id", "text", "source")).where(F.col("text").rlike("(?i)" + PATTERN))
    return lines(docs, "doc_id", "text", "source").where(F.col("content").rlike("(?i)" + PATTERN))


@query("grep_lines", f"select doc_id, line_no::bigint as line_no, content from {_LINES} where regexp_matches(content, '{PATTERN}', 'i')")
def grep_lines(s, d):
    return _hits(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "content")


@query("grep_hits_by_source", f"select source, count(*) as hits, count(distinct doc_id) as docs from {_LINES} where regexp_matches(content, '{PATTERN}', 'i') group by source")
def grep_hits_by_source(s, d):
    return _hits(s, d).groupBy("source").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"))


@query("grep_context", f"with l as (select *, max(case when regexp_matches(content, '{PATTERN}', 'i') then 1 else 0 end) over (partition by doc_id order by line_no rows between 2 preceding and 2 following) as near from {_LINES}) select doc_id, line_no::bigint as line_no, content from l where near = 1")
def grep_context(s, d):
    w = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(-2, 2)
    near = F.max(F.col("content").rlike("(?i)" + PATTERN).cast("int")).over(w)
    return lines(read(s, d, "documents")).withColumn("near", near).where("near = 1").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "content")


@query("grep_paged", f"with m as (select doc_id, source, line_no, content, count(*) over (partition by source) as n, row_number() over (partition by source order by doc_id, line_no) as rn from {_LINES} where regexp_matches(content, '{PATTERN}', 'i')), r as (select *, dense_rank() over (order by n desc, source) as k from m) select source, doc_id, line_no::bigint as line_no, content, n as hits from r where k <= 5 and rn <= 10")
def grep_paged(s, d):
    """Details of the five sources with most hits, ten each; sources are ranked after they are counted."""
    hits = _hits(s, d)
    top = hits.groupBy("source").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "source").limit(5)
    rn = F.row_number().over(W.partitionBy("source").orderBy("doc_id", "line_no"))
    return hits.join(F.broadcast(top), "source").withColumn("rn", rn).where("rn <= 10").select("source", "doc_id", F.col("line_no").cast("long").alias("line_no"), "content", "hits")


@query("head_lines", f"select doc_id, line_no::bigint as line_no, content from {_LINES} where line_no <= 5")
def head_lines(s, d):
    return lines(read(s, d, "documents")).where("line_no <= 5").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "content")


@query("tail_lines", f"select doc_id, line_no::bigint as line_no, content from (select *, max(line_no) over (partition by doc_id) as n from {_LINES}) where line_no > n - 5")
def tail_lines(s, d):
    parts = F.split("text", "\n")
    docs = read(s, d, "documents").select("doc_id", F.size(parts).alias("n"), F.posexplode(parts).alias("p", "content"))
    return docs.where("p >= n - 5").select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "content")


@query("preview", "select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), ' / ') as head, len(string_split(text, chr(10)))::bigint - 1 as total_rows from documents")
def preview(s, d):
    parts = F.split("text", "\n")
    return read(s, d, "documents").select("doc_id", F.array_join(F.slice(parts, 1, 3), " / ").alias("head"), (F.size(parts) - 1).cast("long").alias("total_rows"))


@query("first_wins_dedup", "select min(doc_id) as doc_id, count(*) as copies from documents group by text")
def first_wins_dedup(s, d):
    return read(s, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("text")


_TOK = "(select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) as term from documents)"


@query("tfidf_top_terms", f"select term, count(*) as tf, count(distinct doc_id) as df, round(ln((1 + (select count(*) from documents)) / (1.0 + count(distinct doc_id))) + 1, 6) as idf from {_TOK} group by term order by tf desc, term limit 512")
def tfidf_top_terms(s, d):
    docs = spread(read(s, d, "documents").select("text"))
    n = read(s, d, "documents").agg(F.count("*").alias("n"))
    # Each text gives its terms (k = 1) and its distinct terms (k = 0): one shuffle of counts by term, none by document.
    terms = docs.select(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]{2,})"), 1).alias("t"))
    both = terms.select(F.inline(F.array(F.struct(F.lit(1).alias("k"), F.col("t")), F.struct(F.lit(0).alias("k"), F.array_distinct("t").alias("t")))))
    per = both.select("k", F.explode("t").alias("term")).groupBy("term").agg(F.sum("k").alias("tf"), F.sum(1 - F.col("k")).alias("df"))
    top = per.orderBy(F.desc("tf"), "term").limit(512)
    return top.crossJoin(F.broadcast(n)).select("term", "tf", "df", F.round(F.ln((1 + F.col("n")) / (1.0 + F.col("df"))) + 1, 6).alias("idf"))


_DOT = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
_SQL_DOT = "list_dot_product(a.embedding::double[], b.embedding::double[])"


@query("vec_topk", f"select b.vec_id, round({_SQL_DOT}, 6) as score from (select embedding from embeddings where vec_id = 0) a, embeddings b order by {_SQL_DOT} desc, b.vec_id limit 10")
def vec_topk(s, d):
    e = read(s, d, "embeddings")
    one = e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))
    scored = e.crossJoin(F.broadcast(one)).select("vec_id", _DOT(F.col("embedding"), F.col("q")).alias("exact"))
    return scored.orderBy(F.desc("exact"), "vec_id").limit(10).select("vec_id", F.round("exact", 6).alias("score"))


@query("vec_label_centroid", "select label, i::bigint as i, round(avg(v), 6) as mean from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings) group by label, i")
def vec_label_centroid(s, d):
    e = read(s, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    return e.groupBy("label", (F.col("p") + 1).cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("qa_pairs", "with t as (select *, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as q from conversations where role <> 'system') select conv_id, q::bigint as step_index, max(case when role = 'user' then text end) as query, arg_min(text, turn) filter (where role = 'assistant') as answer from t where q > 0 group by conv_id, q")
def qa_pairs(s, d):
    q = F.sum((F.col("role") == "user").cast("long")).over(W.partitionBy("conv_id").orderBy("turn"))
    t = read(s, d, "conversations").where("role <> 'system'").withColumn("step_index", q).where("step_index > 0")
    said = F.col("role") == "assistant"
    return t.groupBy("conv_id", "step_index").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("query"), F.min_by(F.when(said, F.col("text")), F.when(said, F.col("turn"))).alias("answer"))


@query("message_ratio", "select conv_id, count(*) filter (where role = 'assistant')::double / nullif(count(*) filter (where role = 'user'), 0) as ratio from conversations group by conv_id")
def message_ratio(s, d):
    c = read(s, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("a"), F.count_if(F.col("role") == "user").alias("u"))
    return c.select("conv_id", (F.col("a") / F.nullif("u", F.lit(0))).alias("ratio"))


_Q = "(select d.source, l.quality from documents d left join labels l using (doc_id))"


@query("micro_macro_quality", f"select round(avg(coalesce(quality, 0)), 6) as micro_strict, round(avg(quality), 6) as micro, (select round(avg(m), 6) from (select avg(quality) m from {_Q} where quality is not null group by source)) as macro from {_Q}")
def micro_macro_quality(s, d):
    q = read(s, d, "documents").join(read(s, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("k"), F.coalesce(F.sum("quality"), F.lit(0)).alias("t"), F.avg("quality").alias("m"))
    return q.agg(F.round(F.sum("t") / F.sum("n"), 6).alias("micro_strict"), F.round(F.sum("t") / F.sum("k"), 6).alias("micro"), F.round(F.avg("m"), 6).alias("macro"))


@query("pass_at_1", "select round(avg(case when ok then 1.0 else 0.0 end), 6) as task_pass, round(sum(good)::double / sum(n), 6) as turn_coverage from (select l_orderkey, bool_and(l_quantity >= 10) as ok, count(*) filter (where l_quantity >= 10) as good, count(*) as n from lineitem group by l_orderkey)")
def pass_at_1(s, d):
    t = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") >= 10).alias("ok"), F.count_if(F.col("l_quantity") >= 10).alias("good"), F.count("*").alias("n"))
    return t.agg(F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("task_pass"), F.round(F.sum("good") / F.sum("n"), 6).alias("turn_coverage"))


@query("return_to_go", "with e as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) select event_id, round(sum(value * pow(0.9371, rn)) over (partition by user_id order by rn rows between current row and unbounded following) / pow(0.9371, rn), 4) as g from e")
def return_to_go(s, d):
    return rewards.returns(read(s, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value", gamma=0.9371).select("event_id", F.round("g", 4).alias("g"))


@query("group_zscore", "select event_id, round(case when count(*) over w <= 1 or stddev_pop(value) over w < 1e-8 then 0 else (value - avg(value) over w) / (stddev_pop(value) over w + 1e-8) end, 4) as z from events window w as (partition by event_type)")
def group_zscore(s, d):
    e = read(s, d, "events")
    stats = e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))  # few types: combined before the shuffle, no hot window
    z = F.when((F.col("n") <= 1) | (F.col("sd") < 1e-8), 0.0).otherwise((F.col("value") - F.col("m")) / (F.col("sd") + 1e-8))
    return e.join(stats, "event_type").select("event_id", F.round(z, 4).alias("z"))


_SIGNATURE = "event_type || '::{\"k\":\"' || json_extract_string(props, '$.k') || '\"}'"


@query("repeat_calls", f"select event_id, row_number() over (partition by user_id, {_SIGNATURE} order by ts, event_id) > 1 and value < 50 as repeated from events")
def repeat_calls(s, d):
    """Calls whose signature came before, without new evidence (values below 50)."""
    e = read(s, d, "events").withColumn("signature", checks.call_signature(F.col("event_type"), F.col("props")))
    again = F.row_number().over(W.partitionBy("user_id", "signature").orderBy("ts", "event_id")) > 1
    return e.select("event_id", (again & (F.col("value") < 50)).alias("repeated"))


@query("call_conflicts", f"select user_id, event_type, count(distinct {_SIGNATURE} || floor(value)::bigint % 2) as variants from events group by user_id, event_type having count(distinct {_SIGNATURE} || floor(value)::bigint % 2) > 1")
def call_conflicts(s, d):
    """Types stand for call ids; an id conflicts with another signature or another observation (odd and even values)."""
    e = read(s, d, "events").withColumn("seen", F.struct(checks.call_signature(F.col("event_type"), F.col("props")), (F.floor("value") % 2)))
    return e.groupBy("user_id", "event_type").agg(F.count_distinct("seen").alias("variants")).where("variants > 1")


@query("reindex_ids", "select event_id, 'call_' || user_id || '_' || printf('%03d', row_number() over (partition by user_id order by ts, event_id) - 1) as call_id from events")
def reindex_ids(s, d):
    """Numbers of three digits, or of more where a dialog has a thousand calls: none is cut."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(s, d, "events").select("event_id", F.concat(F.lit("call_"), F.col("user_id").cast("string"), F.lit("_"), F.format_string("%03d", n)).alias("call_id"))


@query("error_recovery", "select e.event_id, exists (select 1 from events l where l.user_id = e.user_id and l.event_type = 'purchase' and l.ts > e.ts) as recovered from events e where e.event_type = 'error'")
def error_recovery(s, d):
    e = read(s, d, "events")
    last = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return e.where("event_type = 'error'").join(last, "user_id", "left").select("event_id", F.coalesce(F.col("last") > F.col("ts"), F.lit(False)).alias("recovered"))


@query("coverage_ledger", "with f as (select user_id, event_type, min(ts) as first_ts from events group by 1, 2) select user_id, event_type, round(count(*) over (partition by user_id order by first_ts, event_type rows unbounded preceding) / 5.0, 6) as coverage from f")
def coverage_ledger(s, d):
    f = read(s, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("at"))
    w = W.partitionBy("user_id").orderBy("at", "event_type").rowsBetween(W.unboundedPreceding, 0)
    return f.select("user_id", "event_type", F.round(F.count("*").over(w) / 5.0, 6).alias("coverage"))


@query("memory_chain", "select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from events")
def memory_chain(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return read(s, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("before"))


@query("span_join", "with a as (select conv_id, turn as lo, lead(turn) over (partition by conv_id order by turn) as hi from conversations where role = 'user') select a.conv_id, a.lo, count(*) as messages from a join conversations c on c.conv_id = a.conv_id and c.turn >= a.lo and (a.hi is null or c.turn < a.hi) group by 1, 2")
def span_join(s, d):
    c = read(s, d, "conversations")
    own = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("lo", own).where("lo is not null").groupBy("conv_id", "lo").agg(F.count("*").alias("messages"))


@query("url_basename", "select page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) as base from pages")
def url_basename(s, d):
    return read(s, d, "pages").select("page_id", F.regexp_extract(F.regexp_replace("url", "[?#].*$", ""), "([^/]*)/*$", 1).alias("base"))


@query("html_links", "select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from pages")
def html_links(s, d):
    return read(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("num_extract", "select doc_id, len(list_distinct(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)', 1)))::bigint as n from documents")
def num_extract(s, d):
    return read(s, d, "documents").select("doc_id", F.size(tx.numbers_in(F.col("text"))).cast("long").alias("n"))


@query("num_stats", "select event_type, min(value) as lo, max(value) as hi, round(avg(value), 6) as mean, list_sort(list(value))[len(list(value)) // 2 + 1] as upper_median from events group by event_type")
def num_stats(s, d):
    """The upper median is an element of the values: those of the one range that holds it are put in order, no others."""
    made = reports.middle(read(s, d, "events"), "value", "event_type")
    return made.select("event_type", "lo", "hi", F.round("mean", 6).alias("mean"), F.col("middle").alias("upper_median"))


@query("join_inner", "select n.n_name, count(*) as customers, round(sum(c.c_acctbal), 2) as balance from customer c join nation n on c.c_nationkey = n.n_nationkey group by n.n_name")
def join_inner(s, d):
    return read(s, d, "customer").join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("join_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def join_semi(s, d):
    return read(s, d, "customer").join(read(s, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def join_anti(s, d):
    return read(s, d, "customer").join(read(s, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_full", "select coalesce(l.k, r.k) as k, l.a, r.b from (select c_nationkey as k, count(*) as a from customer where c_acctbal > 9000 group by 1) l full join (select s_nationkey as k, count(*) as b from supplier group by 1) r on l.k = r.k")
def join_full(s, d):
    left = read(s, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("a"))
    return left.join(read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("b")), "k", "full").select("k", "a", "b")


_RC = "from lineitem group by {} (l_returnflag, l_linestatus)"
for _name, _how in (("rollup", "rollup"), ("cube", "cube")):
    query(_name, f"select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty {_RC.format(_how)}")(
        lambda s, d, how=_how: getattr(read(s, d, "lineitem"), how)("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    )


@query("grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def grouping_sets(s, d):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return read(s, d, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.count("*").alias("n"))


@query("pivot", "select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type = 'view') as view from events group by user_id")
def pivot(s, d):
    return read(s, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.count(F.lit(1))).na.fill(0)


@query("unpivot", "select l_orderkey, l_linenumber, 'l_discount' as k, l_discount as v from lineitem union all select l_orderkey, l_linenumber, 'l_tax', l_tax from lineitem")
def unpivot(s, d):
    return read(s, d, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "k", "v")


@query("tumbling", "select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling(s, d):
    return read(s, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("session", "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '1 hour' then 0 else 1 end as fresh from events), n as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from g) select user_id, k::bigint as k, count(*) as n, min(ts) as start from n group by 1, 2")
def session(s, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 1 hour"), 0).otherwise(1)
    return read(s, d, "events").withColumn("fresh", fresh).withColumn("k", F.sum(F.col("fresh").cast("long")).over(w)).groupBy("user_id", "k").agg(F.count("*").alias("n"), F.min("ts").alias("start"))


@query("asof_events", "select e.event_id, (select max(p.ts) from events p where p.user_id = e.user_id and p.event_type = 'view' and p.ts <= e.ts) as seen from events e where e.event_type = 'purchase'")
def asof_events(s, d):
    w = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, 0)
    e = read(s, d, "events").where("event_type in ('view', 'purchase')").withColumn("seen", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w))
    return e.where("event_type = 'purchase'").select("event_id", "seen")


@query("set_ops", "(select o_custkey as k from orders where o_totalprice > 300000 intersect select c_custkey from customer where c_acctbal > 0) except select c_custkey from customer where c_mktsegment = 'BUILDING'")
def set_ops(s, d):
    c = read(s, d, "customer")
    big = read(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return big.intersect(c.where("c_acctbal > 0").select("c_custkey")).subtract(c.where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("rank_topk", "select o_custkey, o_orderkey, rn::bigint as rn from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 3")
def rank_topk(s, d):
    rn = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return read(s, d, "orders").withColumn("rn", rn.cast("long")).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@query("growth", "with m as (select date_trunc('month', o_orderdate) as month, sum(o_totalprice) as total from orders group by 1) select month, round(total / lag(total) over (order by month) - 1, 6) as growth from m")
def growth(s, d):
    m = read(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    return m.select("month", F.round(F.col("total") / F.lag("total").over(W.orderBy("month")) - 1, 6).alias("growth"))  # one row a month
