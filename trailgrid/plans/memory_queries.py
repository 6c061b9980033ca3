"""Queries of memories, their facts and rewards over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation, evidence, memory
from ..sources.tables import read
from .registry import query


def _say(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _orders(s, d):
    """Orders with a memory that tells of each: a fact, a plain one, a table or two, a constraint."""
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    fact = _say('{"text": "order ', k, ' of ', year, '", "entity": "c', F.col("o_custkey"), '", "time": "', year, '", "metric": "price", "value": "', F.floor("o_totalprice"), '"', F.when(k % 3 > 0, ', "provenance": "orders.csv"').otherwise(""), "}")
    facts = F.when(k % 2 == 0, _say("[", fact, ', "plain ', k, '"]')).otherwise(_say("[", fact, "]"))
    text = _say('{"key_facts": ', facts, ', "derived_results": "', F.col("o_orderpriority"), '", "tables": [{"name": "orders.csv", "description": "all orders"}, "t', k % 5, '.csv"], "constraints": [{"content": "only ', F.col("o_orderstatus"), '"}]}')
    return read(s, d, "orders").withColumn("memory", F.when(k % 11 == 0, "not json").otherwise(text))


_FACTS = """(select o_orderkey, unnest(case when o_orderkey % 11 = 0 then [] else [{'kind': 'fact', 'text': 'order ' || o_orderkey || ' of ' || year(o_orderdate), 'value': floor(o_totalprice)::bigint::varchar, 'provenance': case when o_orderkey % 3 > 0 then 'orders.csv' else '' end, 'named': ''}] end
 || case when o_orderkey % 11 > 0 and o_orderkey % 2 = 0 then [{'kind': 'fact', 'text': 'plain ' || o_orderkey, 'value': null, 'provenance': '', 'named': ''}] else [] end || case when o_orderkey % 11 = 0 then [] else [{'kind': 'fact', 'text': o_orderpriority, 'value': null, 'provenance': '', 'named': ''},
 {'kind': 'table', 'text': 'all orders', 'value': null, 'provenance': 'orders.csv', 'named': 'orders.csv'}, {'kind': 'table', 'text': 't' || o_orderkey % 5 || '.csv', 'value': null, 'provenance': 't' || o_orderkey % 5 || '.csv', 'named': 't' || o_orderkey % 5 || '.csv'}, {'kind': 'constraint', 'text': 'only ' || o_orderstatus, 'value': null, 'provenance': '', 'named': ''}] end) as f from orders)"""


@query("memory_facts", f"select o_orderkey, f.kind as kind, f.text as text, f.value as value, f.provenance as provenance, f.named as named from {_FACTS}")
def memory_facts(s, d):
    return _orders(s, d).select("o_orderkey", F.explode(memory.facts(F.col("memory"))).alias("f")).select("o_orderkey", "f.kind", "f.text", "f.value", "f.provenance", "f.named")


@query("remembered_items", """select o_orderkey, case when o_orderkey % 11 = 0 then false when o_orderkey % 4 = 0 then o_orderkey % 3 > 0 when o_orderkey % 4 = 1 then false when o_orderkey % 4 = 2 then true else false end as from_memory from orders""")
def remembered_items(s, d):
    """Asked by k % 4: the price by its fact (needs a source); a price that is told nowhere; the description of the orders' file; a fact of another file's."""
    o, k = _orders(s, d), F.col("o_orderkey")
    value = F.when(k % 4 == 0, F.floor("o_totalprice").cast("string")).when(k % 4 == 1, F.lit("123456789012")).when(k % 4 == 2, "all orders").otherwise("all orders")
    items = o.select(k.alias("sq"), k.alias("item"), F.when(k % 4 <= 1, "raw_value").otherwise("text_fact").alias("kind"), value.alias("value"), F.when(k % 4 == 3, F.array(F.lit("parts.csv"))).when(k % 4 == 2, F.array(F.lit("Orders.csv"))).otherwise(F.array().cast("array<string>")).alias("tables"))
    return memory.ledger_start(items, o.select(k.alias("sq"), "memory")).select(F.col("sq").alias("o_orderkey"), "from_memory")


@query("memory_status", """select o_orderkey, o_orderkey % 11 = 0 as unparseable, case when o_orderkey % 11 = 0 then 0 else 5 + (o_orderkey % 2 = 0)::int end::bigint as facts, (o_orderkey % 7 <> 0)::bigint as uncertain from orders""")
def memory_status(s, d):
    o = _orders(s, d)
    audit = memory.binding_audit(_say("of ", F.year("o_orderdate"), " and "), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 7 > 0, "elsewhere"))
    return o.select("o_orderkey", memory.unparseable(F.col("memory")).alias("unparseable"), F.size(memory.facts(F.col("memory"))).cast("long").alias("facts"), audit["uncertain"].cast("long").alias("uncertain"))


_CLAIMED = "case when o_orderkey % 4 = 0 then true when o_orderkey % 4 = 1 then false when o_orderkey % 4 = 2 then true else o_custkey % 2 = 0 end"


@query("grounded_claims", f"select o_orderkey, {_CLAIMED} as grounded from orders")
def grounded_claims(s, d):
    """Claims by k % 4: a text that was seen, one that was not, one of which two numbers were, and one whose file half of the results name."""
    k = F.col("o_orderkey")
    claim = F.when(k % 4 == 1, "the moon is made of cheese").when(k % 4 == 2, _say("in all ", k + 7000000, " and ", F.col("o_custkey") + 5000000, " ways")).otherwise(_say("Customer No ", F.col("o_custkey")))
    seen = F.array(F.struct(_say("customer no ", F.col("o_custkey"), " total ", k + 7000000, F.when(F.col("o_custkey") % 2 == 0, " in F.csv").otherwise(" in g.csv")).alias("content"), F.lit(None).cast("string").alias("file")))
    none = F.array().cast("array<string>")
    code = F.array(_say("printed ", F.col("o_custkey") + 5000000))
    return read(s, d, "orders").select("o_orderkey", memory.grounded(claim, F.when(k % 4 == 3, "f.csv"), seen, code, F.array().cast(memory.FACT), none).alias("grounded"))


@query("extra_claims", "select conv_id, count(*) filter (where length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) >= 8 and (n - 1) % 3 <> 0) as extras from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) group by 1")
def extra_claims(s, d):
    """Messages of a conversation are claims; every third from the first is matched."""
    c = read(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("claims"))
    matched = F.transform(F.sequence(F.lit(0), F.size("claims")), lambda i: i * 3)
    return c.select("conv_id", memory.extras(F.col("claims"), matched).cast("long").alias("extras"))


_YEARLY = "(select o_custkey as sq, o_orderkey as id, o_orderpriority as entity, year(o_orderdate)::varchar as time, o_orderstatus as metric, o_totalprice::double as number, o_orderkey % 2 = 0 as is_fact from orders)"


@query("contradictions", f"select distinct a.sq, a.id as fact, b.id as item from {_YEARLY} a join {_YEARLY} b on a.sq = b.sq and a.is_fact and not b.is_fact and (a.entity = b.entity)::int + (a.time = b.time)::int + (a.metric = b.metric)::int >= 2 and abs(a.number - b.number) / abs(b.number) > 0.05")
def contradictions(s, d):
    o = read(s, d, "orders").select(F.col("o_custkey").alias("sq"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("entity"), F.year("o_orderdate").cast("string").alias("time"), F.col("o_orderstatus").alias("metric"), F.col("o_totalprice").cast("double").alias("number"))
    return memory.contradicting(o.where("id % 2 = 0").withColumnRenamed("id", "fact"), o.where("id % 2 = 1").withColumnRenamed("id", "item"))


_NEEDS = """(select o_orderkey, unnest(['numeric_fact', 'entity_set', 'reference', 'constraint', 'table_ref']) as kind from orders)"""


@query("kept_dependencies", f"""select n.o_orderkey, n.kind, case n.kind when 'numeric_fact' then o_orderkey % 2 = 0 when 'entity_set' then o_orderkey % 3 = 0 when 'reference' then true when 'constraint' then o_orderkey % 5 = 0 else o_orderkey % 7 = 0 end as kept,
 case n.kind when 'numeric_fact' then o_orderkey % 4 = 0 when 'entity_set' then o_orderkey % 4 <= 1 when 'reference' then o_orderkey % 4 <> 3 when 'constraint' then o_orderkey % 4 <> 3 else o_orderkey % 4 <> 3 end as retained from {_NEEDS} n""")
def kept_dependencies(s, d):
    """What later turns need, against verified items that lack parts of it by k, and memories that hold all of it, its entities, its texts, or nothing."""
    k, name = F.col("o_orderkey"), F.col("o_custkey")
    entity = _say("cust-", name, "!")
    verified = F.array(F.struct(
        F.lit("e1").alias("item"), F.when(k % 3 == 0, entity).when(k % 2 == 0, _say("the ", entity)).otherwise("nobody").alias("entity"), F.lit("1995").alias("time"), F.lit("price").alias("metric"),
        F.when(k % 5 == 0, "since 1995 , only north").otherwise("12").alias("value"), F.array(F.when(k % 7 == 0, F.lit("d/Parts_1.csv")).otherwise("other")).alias("tables"),
    ))
    need = lambda kind, source, entities, **fields: F.struct(F.lit(kind).alias("kind"), source.alias("source"), F.create_map(*[x for n, v in fields.items() for x in (F.lit(n), v)]).cast("map<string,string>").alias("fields"), entities.alias("entities"))
    null, some = F.lit(None).cast("string"), F.array(entity)
    needs = F.array(
        need("numeric_fact", F.when(k % 2 == 0, "e1").otherwise("e9"), F.lit(None).cast("array<string>"), entity=entity, time=F.lit("1995"), metric=F.lit("price"), value=F.lit("7"), unit=F.lit("t")),
        need("entity_set", null, some, none=F.lit("")), need("reference", null, some, reference_text=F.lit("As Above"), target_sq=F.lit("sq1")), need("constraint", null, some, constraint_content=F.lit("Only North")), need("table_ref", null, some, table_name=F.lit("parts_")),
    )
    fact = lambda text, **f: F.struct(F.lit("fact").alias("kind"), text.alias("text"), *[f.get(n, F.lit(None).cast("string")).alias(n) for n in ("entity", "time", "metric", "value", "unit", "provenance", "named")])
    texts = F.lit("as above, only north of parts_")
    full = fact(texts, entity=entity, time=F.lit("in 1995"), metric=F.lit("price"), value=F.lit("7"), unit=F.lit("t"))
    held = F.when(k % 4 == 0, F.array(full)).when(k % 4 == 1, F.array(fact(texts, entity=entity))).when(k % 4 == 2, F.array(fact(texts))).otherwise(F.array().cast(memory.FACT)).cast(memory.FACT)
    rows = read(s, d, "orders").select("o_orderkey", F.explode(needs).alias("n"), verified.alias("v"), held.alias("h"))
    return rows.select("o_orderkey", "n.kind", memory.supported(F.col("n"), F.col("v")).alias("kept"), memory.retained(F.col("n"), F.col("h")).alias("retained"))


@query("memory_rewards", """with m as (select o_orderkey, o_orderkey % 11 = 0 as broken, o_orderkey % 5 = 1 as against, o_orderkey % 2 = 0 as seen, o_custkey, length('{"key_facts": [{"text": "price of ' || o_orderkey || '", "entity": "e", "time": "t", "value": "' || floor(o_totalprice)::bigint || '"}], "constraints": ["' || repeat('x', (o_custkey % 700)::int) || '"]}') as n from orders)
 select o_orderkey, case when broken then 'unparseable' when against then null end as severe, case when broken then -1 else round(greatest(-1, least(1, 0.5 * (seen::int + (o_custkey % 700 = 0)::int) / 2 + 0.4 - 0.1 * greatest(0, (n - 512) / 512.0))), 6) end as r_memory from m""")
def memory_rewards(s, d):
    """Memories of a fact and a long constraint: the fact was seen or not, the constraint never was; a later turn needs the entity. One contradiction of two facts is no majority. An empty constraint stands in any text."""
    k = F.col("o_orderkey")
    text = _say('{"key_facts": [{"text": "price of ', k, '", "entity": "e", "time": "t", "value": "', F.floor("o_totalprice"), '"}], "constraints": ["', F.repeat(F.lit("x"), (F.col("o_custkey") % 700).cast("int")), '"]}')
    none = F.array().cast("array<string>")
    rows = read(s, d, "orders").select(
        "o_orderkey", F.when(k % 11 == 0, "{broken").otherwise(text).alias("memory_after"), F.lit(None).cast("string").alias("memory_before"),
        F.array(F.struct(F.lit("e1").alias("item"), F.lit("e").alias("entity"), F.lit("t").alias("time"), F.lit("m").alias("metric"), F.when(k % 5 == 1, "1").otherwise(F.floor("o_totalprice").cast("string")).alias("value"), none.alias("tables"))).alias("verified"),
        F.array(F.struct(F.when(k % 2 == 0, _say("saw ", F.floor("o_totalprice"))).otherwise("saw nothing").alias("content"), F.lit(None).cast("string").alias("file"))).alias("observations"), none.alias("code"), none.alias("points"),
        F.array(F.struct(F.lit("entity_set").alias("kind"), F.lit(None).cast("string").alias("source"), F.create_map().cast("map<string,string>").alias("fields"), F.array(F.lit("e")).alias("entities"), F.lit(1.0).alias("weight"))).alias("dependencies"),
    )
    return memory.memory_rewards(rows).select("o_orderkey", "severe", F.round("r_memory", 6).alias("r_memory"))


@query("combined_rewards", "with t as (select l_orderkey as sq, avg(l_discount::double) as r from lineitem where l_quantity > 10 group by 1) select o_orderkey as sq, round((coalesce(t.r, 0) + o_custkey % 10 / 10.0 + o_orderkey % 7 / 7.0) / 3, 6) as reward from orders left join t on t.sq = o_orderkey")
def combined_rewards(s, d):
    o = read(s, d, "orders")
    steps = read(s, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("sq"), F.col("l_discount").cast("double").alias("r_tool"))
    made = memory.combined(steps, o.select(F.col("o_orderkey").alias("sq"), (F.col("o_custkey") % 10 / 10).alias("r_answer")), o.select(F.col("o_orderkey").alias("sq"), (F.col("o_orderkey") % 7 / 7).alias("r_memory")))
    return made.select("sq", F.round("reward", 6).alias("reward"))


@query("counterfactual_merge", """with m as (select event_id, event_type, case when event_id % 3 = 0 then value / 100 else value / 50 end as value from events)
 select event_id, round(value, 6) as value, round(case when count(*) over w <= 1 or stddev_pop(value) over w < 1e-8 then 0 else (value - avg(value) over w) / (stddev_pop(value) over w + 1e-8) end, 4) as z from m window w as (partition by event_type)""")
def counterfactual_merge(s, d):
    """Every third boundary was worked out anew, with half its reward."""
    e = read(s, d, "events").select(F.col("user_id").alias("rollout"), F.col("event_id").alias("boundary"), (F.col("value") / 50).alias("value"), "event_type")
    audits = e.where("boundary % 3 = 0").select("rollout", "boundary", (F.col("value") / 2).alias("final"))
    return memory.with_counterfactual(e, audits, "event_type").select(F.col("boundary").alias("event_id"), F.round("value", 6).alias("value"), F.round("z", 4).alias("z"))


@query("answer_rewards", "select l_orderkey as sq, round(greatest(-1, least(1, sum(l_quantity::double * (l_discount > 0.03 and l_tax > 0.01)::int) / greatest(sum(l_quantity::double), 1e-8) - max((l_returnflag = 'A')::int) - 0.5 * max(l_linenumber % 2))), 6) as reward from lineitem group by 1")
def answer_rewards(s, d):
    c = F.col
    made = evidence.answer_reward(c("l_discount") > 0.03, c("l_tax") > 0.01, c("l_quantity").cast("double"), c("l_returnflag") == "A", c("l_linenumber") % 2)
    return read(s, d, "lineitem").groupBy(c("l_orderkey").alias("sq")).agg(F.round(made, 6).alias("reward"))


@query("checked_values", "select o_orderkey, o_orderkey % 4 in (0, 1) as value_ok, o_orderkey % 3 <> 2 as source_ok, o_custkey % 3 > 0 as operator_ok, o_orderkey % 2 = 0 as result_ok from orders")
def checked_values(s, d):
    """A price by number and as text, one that is absent and a long text that is; sources that fit, are not asked for, or differ; operations that code shows; sums that follow, and ones thrice as large, which no key brings within the tolerance."""
    k, price = F.col("o_orderkey"), F.floor("o_totalprice")
    kind, value = F.when(k % 2 == 0, "raw_value").otherwise("text_fact"), F.when(k % 4 == 0, price.cast("string")).when(k % 4 == 1, _say("Order No. ", k)).when(k % 4 == 2, "987654321098").otherwise("a text of which nothing was ever seen")
    ok = evidence.value_match(kind, value, _say("order no. ", k, " costs ", price, "元"))
    source = evidence.source_match(F.when(k % 3 == 0, F.array(F.lit("Orders.xlsx"))).when(k % 3 == 2, F.array(F.lit("parts.csv"))), F.array(F.lit("d/orders.xlsx")))
    operator = evidence.operator_match(F.when(F.col("o_custkey") % 3 > 0, "sum").otherwise("占比"), F.lit("the total of all"), F.lit("reader"))
    result = evidence.result_match(F.when(k % 2 == 0, (price + k).cast("string")).otherwise(((price + k) * 3 + 1).cast("string")), F.lit("sum"), F.array(price.cast("double"), k.cast("double")), F.lit(""))
    return read(s, d, "orders").select("o_orderkey", ok.alias("value_ok"), source.alias("source_ok"), operator.alias("operator_ok"), result.alias("result_ok"))


@query("best_claims", """with p as (select l_orderkey as sq, l_linenumber as point_no, 'part ' || l_partkey as point from lineitem), c as (select l_orderkey as sq, l_linenumber as claim_no, 'Part ' || (l_partkey + l_linenumber % 2) || case when l_linenumber % 3 = 0 then ' was sold' else '' end as claim from lineitem),
 n as (select p.sq, p.point_no, c.claim_no, lower(replace(claim, ' ', '')) as c, lower(replace(point, ' ', '')) as q, regexp_extract(claim, '\\d+') = regexp_extract(point, '\\d+') as same from p join c using (sq)), s as (select *, case when c = q then 1.0 when length(c) >= 4 and contains(q, c) then 0.9 when length(q) >= 4 and contains(c, q) then 0.8 when same then 0.95 else 0.0 end::double as conf from n)
 select sq, point_no, max(conf) as confidence, case when max(conf) > 0 then arg_min(claim_no, (-conf, claim_no)) end as claim_no from s group by 1, 2""")
def best_claims(s, d):
    l = read(s, d, "lineitem")  # noqa: E741
    points = l.select(F.col("l_orderkey").alias("sq"), F.col("l_linenumber").alias("point_no"), _say("part ", F.col("l_partkey")).alias("point"))
    claims = l.select(F.col("l_orderkey").alias("sq"), F.col("l_linenumber").alias("claim_no"), _say("Part ", F.col("l_partkey") + F.col("l_linenumber") % 2, F.when(F.col("l_linenumber") % 3 == 0, " was sold").otherwise("")).alias("claim"))
    return evidence.best_claims(points, claims)


@query("memory_gates", "select o_orderkey, list_filter([case when o_orderkey % 5 = 0 then 'unparseable' end, case when o_orderkey % 5 = 1 then 'empty' end, case when o_orderkey % 5 > 1 and o_custkey % 2 = 0 then 'speculative' end], lambda x: x is not null) as issues from orders")
def memory_gates(s, d):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, _say('["', k, '"]')).when(k % 5 == 1, _say('{"goal": "', k, '"}')).otherwise(_say('{"derived_results": ["total ', k, '", "', F.when(F.col("o_custkey") % 2 == 0, "价格可能意味着增长").otherwise("增长"), '"]}'))
    return read(s, d, "orders").select("o_orderkey", memory.gate_issues(text).alias("issues"))


@query("judged_coverage", """with p as (select l_orderkey as sq, l_linenumber as point_no, l_partkey as a from lineitem), c as (select l_orderkey as sq, l_partkey + l_linenumber % 2 as b from lineitem), m as (select p.sq, point_no, a, max((a = b)::int) as hit from p join c using (sq) group by 1, 2, 3)
 select sq, count(*) as points, sum(hit)::bigint as covered, round(avg(hit), 6) as coverage from m group by 1""")
def judged_coverage(s, d):
    l = read(s, d, "lineitem")  # noqa: E741
    points = l.select(F.col("l_orderkey").alias("sq"), F.struct("l_linenumber", "l_partkey").alias("point_no"), _say("part ", F.col("l_partkey"), ".").alias("point")).distinct()
    claims = l.select(F.col("l_orderkey").alias("sq"), F.col("l_linenumber").alias("claim_no"), _say("Part ", F.col("l_partkey") + F.col("l_linenumber") % 2, ".").alias("claim"))
    made = curation.points_covered(evidence.best_claims(points, claims))
    return made.select("sq", "points", "covered", F.round("coverage", 6).alias("coverage"))
