"""Memories of a run: facts, what they verify, whether answers and memories rest on what was seen, and the rewards of both.

Facts, observations and verified items of a sub-question are arrays in one row: one run's, and small.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import amount, amounts_in, any_of, match_form, strip
from ..functions.checks import speculative
from .evidence import source_match, value_match
from .reports import DEPENDENCY_FIELDS
from .rewards import compression_penalty, memory_reward

#: One fact of a memory. kind tells the list that it stood in; named is the table it names.
FACT = "array<struct<kind:string,text:string,entity:string,time:string,metric:string,value:string,unit:string,provenance:string,named:string>>"


def _said(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def facts(memory: Column) -> Column:
    """The facts of a memory (JSON text) in the order of its lists; an empty array if it is no object.

    An entry is a text or an object; a list that holds one entry without brackets counts as that entry.
    """

    def entries(name: str) -> Column:
        held = F.get_json_object(memory, f"$.{name}")
        many = F.from_json(held, "array<string>")
        return F.filter(F.when(held.isNull(), F.array().cast("array<string>")).when(F.startswith(held, F.lit("[")), F.coalesce(many, F.array().cast("array<string>"))).otherwise(F.array(held)), lambda x: x.isNotNull())

    def fact(kind: str, x: Column) -> Column:
        is_object = F.startswith(strip(x), F.lit("{")) & F.try_parse_json(x).isNotNull()
        at = lambda *names: F.coalesce(*[F.when(is_object, F.nullif(F.get_json_object(x, f"$.{n}"), F.lit(""))) for n in names], F.lit(None).cast("string"))
        table = F.when(is_object, _said(at("name", "table_name", "file"))).otherwise(x) if kind == "table" else F.lit("")
        text = {"fact": ("text", "value", "content"), "table": ("description",), "constraint": ("content",)}[kind]
        own = (lambda n: at(n)) if kind == "fact" else (lambda n: F.lit(None).cast("string"))
        provenance = F.when(is_object, _said(at("provenance", "source"))).otherwise("") if kind == "fact" else table
        return F.struct(F.lit(kind).alias("kind"), F.coalesce(at(*text), x).alias("text"), *[own(n).alias(n) for n in ("entity", "time", "metric", "value", "unit")], provenance.alias("provenance"), table.alias("named"))

    lists = (("fact", "key_facts"), ("fact", "derived_results"), ("table", "tables"), ("constraint", "constraints"))
    made = F.concat(*[F.transform(entries(name), partial(fact, kind)) for kind, name in lists])
    return F.when(F.startswith(strip(_said(memory)), F.lit("{")) & F.try_parse_json(memory).isNotNull(), made.cast(FACT)).otherwise(F.array().cast(FACT))


def unparseable(memory: Column) -> Column:
    """Whether a memory is no JSON object, or an empty one."""
    return ~F.coalesce(F.startswith(strip(memory), F.lit("{")) & F.try_parse_json(memory).isNotNull() & ~strip(memory).rlike(r"^\{\s*\}$"), F.lit(False))


def binding_audit(context: Column, *fields: Column) -> Column:
    """struct<matched, uncertain>: matched is always true, as a field that the context lacks is only uncertain; how many are."""
    form = match_form(context)
    lacks = [F.when((match_form(f) != "") & ~F.contains(form, match_form(f)), 1).otherwise(0) for f in fields]
    return F.struct(F.lit(True).alias("matched"), sum(lacks[1:], lacks[0]).alias("uncertain"))


def remembered(kind: Column, value: Column, tables: Column, held: Column) -> Column:
    """Whether a fact of the array `held` says the value and has a source: one that fits the item's tables, where both are named."""
    named = lambda f: F.exists(tables, lambda t: F.contains(F.lower(f["provenance"]), F.lower(t)) | F.contains(F.lower(t), F.lower(f["provenance"])))
    has = lambda f: _said(f["provenance"]) != ""
    sourced = lambda f: F.when((F.coalesce(F.size(tables), F.lit(0)) > 0) & has(f), named(f)).otherwise(has(f) | (_said(f["named"]) != ""))
    return F.exists(held, lambda f: value_match(kind, value, F.concat_ws(" ", _said(f["text"]), _said(f["value"]))) & sourced(f))


def ledger_start(items: DataFrame, memories: DataFrame) -> DataFrame:
    """items (sq, item, kind, value, tables, ...) with from_memory: whether the memory (sq, memory) before the sub-question verifies each."""
    held = memories.select("sq", facts(F.col("memory")).alias("held"))
    said = remembered(F.col("kind"), F.col("value"), F.col("tables"), F.col("held"))
    return items.join(held, "sq", "left").withColumn("from_memory", F.coalesce(said, F.lit(False))).drop("held")


def memory_text(held: Column) -> Column:
    """All that facts say, for grounding."""
    return F.array_join(F.transform(held, lambda f: F.concat_ws(" ", *[F.nullif(f[n], F.lit("")) for n in ("entity", "time", "metric", "value", "unit", "text", "provenance")])), " ")


def grounded(claim: Column, table: Column, observations: Column, code: Column, held: Column, verified: Column) -> Column:
    """Whether a claim stands in what was seen, or two of its numbers do; and whether its table, if it names one, was seen.

    observations: array<struct<content, file>>; code, verified: array<string>; held: facts.
    """
    seen = F.array_join(F.transform(observations, lambda o: _said(o["content"])), " ")
    whole = value_match(F.lit("text_fact"), claim, F.concat_ws(" ", seen, memory_text(held), F.array_join(code, " "), F.array_join(verified, " ")))
    known = F.concat(amounts_in(seen), F.flatten(F.transform(code, amounts_in)), F.filter(F.transform(verified, amount), lambda v: v.isNotNull()))
    shared = F.size(F.filter(amounts_in(claim), lambda x: F.exists(known, lambda y: F.abs(x - y) < 1e-6)))
    named = F.exists(observations, lambda o: F.contains(F.lower(_said(o["content"])), F.lower(table)) | F.coalesce(source_match(F.array(table), F.array(o["file"])), F.lit(False)))
    return (whole | (shared >= 2)) & ((_said(table) == "") | named)


def extras(claims: Column, matched: Column) -> Column:
    """How many claims (array<string>) no point matched (their numbers from 0) and are of 8 characters or more."""
    told = F.transform(claims, lambda c, i: F.struct(strip(_said(c)).alias("c"), i.alias("i")))
    return F.size(F.filter(told, lambda x: ~F.array_contains(matched, x["i"]) & (F.length(x["c"]) >= 8)))


def faithful(fact: Column, before: Column, observations: Column, code: Column, points: Column) -> Column:
    """Whether a fact's value stands in what was known or seen, and its source does.

    before: facts; observations: array<struct<content, file>> (a null file: nothing is told of the source; an empty one
    fits any source); code: array<string>; points: array<string>, those answered right and grounded. A fact without a
    source needs none, nor does one whose earlier memory names no source.
    """
    text, value = _said(fact["text"]), _said(fact["value"])
    everything = F.concat_ws(" ", F.array_join(F.transform(before, lambda f: _said(f["text"])), " "), F.array_join(F.transform(observations, lambda o: _said(o["content"])), " "), F.array_join(code, " "), F.array_join(points, " "))
    says = value_match(F.when(value != "", "raw_value").otherwise("text_fact"), F.when(value != "", value).otherwise(text), everything)
    source = F.lower(_said(fact["provenance"]))
    either = lambda x: F.contains(source, x) | F.contains(x, source)
    traced = any_of(
        F.exists(before, lambda f: either(F.lower(_said(f["provenance"])))), F.exists(observations, lambda o: F.coalesce(either(F.lower(o["file"])), F.lit(False)) | F.contains(F.lower(_said(o["content"])), source)),
        (text != "") & F.exists(points, lambda p: F.contains(p, F.left(text, F.lit(20)))), (value != "") & F.exists(code, lambda c: F.contains(c, value)),
    )
    return says & F.when(source == "", True).otherwise(traced)


def conflicts(held: Column, verified: Column) -> Column:
    """Whether over half of the facts contradict a verified item: two of entity, time and metric are the same, values over 5 % apart."""
    same = lambda f, v, n: ((F.trim(_said(f[n])) != "") & (F.trim(_said(f[n])) == F.trim(_said(v[n])))).cast("int")
    apart = lambda f, v: (F.abs(amount(v["value"])) > 1e-8) & (F.abs(amount(f["value"]) - amount(v["value"])) / F.abs(amount(v["value"])) > 0.05)
    against = F.filter(held, lambda f: F.exists(verified, lambda v: (same(f, v, "entity") + same(f, v, "time") + same(f, v, "metric") >= 2) & F.coalesce(apart(f, v), F.lit(False))))
    return (F.size(held) > 0) & (F.size(against) * 2 > F.size(held))


def supported(dependency: Column, verified: Column) -> Column:
    """Whether verified items satisfy what a later turn needs: struct<kind, source, fields map, entities array>."""
    at = lambda n: _said(F.try_element_at(dependency["fields"], F.lit(n)))
    entities = F.coalesce(dependency["entities"], F.array().cast("array<string>"))
    by_kind = {
        "numeric_fact": F.when(_said(dependency["source"]) != "", F.exists(verified, lambda v: v["item"] == dependency["source"])).otherwise((at("entity") != "") & F.exists(verified, lambda v: F.contains(_said(v["entity"]), at("entity")))),
        "entity_set": F.exists(verified, lambda v: F.array_contains(entities, _said(v["entity"])) & (_said(v["entity"]) != "")), "reference": F.lit(True),
        "constraint": (at("constraint_content") != "") & F.exists(verified, lambda v: F.contains(match_form(v["value"]), match_form(at("constraint_content")))),
        "table_ref": (at("table_name") != "") & F.exists(verified, lambda v: F.exists(v["tables"], lambda t: F.contains(F.lower(t), F.lower(at("table_name"))) | F.contains(F.lower(at("table_name")), F.lower(t)))),
    }
    out = F.lit(False)
    for kind, test in by_kind.items():
        out = F.when(dependency["kind"] == kind, F.coalesce(test, F.lit(False))).otherwise(out)
    return out


def retained(dependency: Column, held: Column) -> Column:
    """Whether facts still hold all fields that a dependency of its kind needs; the turn that a reference names is not looked for."""
    whole = match_form(F.array_join(F.transform(held, lambda f: _said(f["text"])), " "))

    def keeps(name: str) -> Column:
        if name == "entities":
            wanted = F.coalesce(dependency["entities"], F.array().cast("array<string>"))
            return dependency["entities"].isNotNull() & F.forall(wanted, lambda e: F.exists(held, lambda f: F.contains(match_form(F.concat_ws(" ", _said(f["text"]), _said(f["entity"]))), match_form(e))))
        value = F.try_element_at(dependency["fields"], F.lit(name))
        if name == "target_sq":
            return value.isNotNull()
        form = match_form(value)
        by_field = F.lit(False)
        if name in ("entity", "time", "metric", "value", "unit"):
            by_field = F.exists(held, lambda f: (_said(f[name]) != "") & (F.contains(match_form(f[name]), form) | F.contains(form, match_form(f[name]))))
        return value.isNotNull() & (by_field | F.contains(whole, form))

    out = F.lit(False)
    for kind, names in DEPENDENCY_FIELDS.items():
        test = keeps(names[0])
        for n in names[1:]:
            test = test & keeps(n)
        out = F.when(dependency["kind"] == kind, F.coalesce(test, F.lit(False))).otherwise(out)
    return out


def memory_rewards(rows: DataFrame) -> DataFrame:
    """rows with keep, F, S, P, severe and r_memory. Columns: memory_after, memory_before (JSON texts), verified
    array<struct<item, entity, time, metric, value, tables>>, observations, code, points, dependencies
    array<struct<kind, source, fields, entities, weight>>.

    Severe failures give -1: an unparseable memory, an empty one where something must be kept, and contradictions.
    """
    made = rows.withColumns({"_after": facts(F.col("memory_after")), "_before": facts(F.col("memory_before"))})
    made = made.withColumn("_keep", F.filter("dependencies", lambda d: supported(d, F.col("verified"))))
    right = F.filter("_after", lambda f: faithful(f, F.col("_before"), F.col("observations"), F.col("code"), F.col("points")))
    weight = lambda a: F.aggregate(a, F.lit(0.0), lambda t, d: t + d["weight"])
    kept = F.filter("_keep", lambda d: retained(d, F.col("_after")))
    made = made.withColumns(
        {
            "keep": F.size("_keep"), "F": F.size(right) / F.greatest(F.size("_after").cast("double"), F.lit(1e-8)), "S": F.when(F.size("_keep") > 0, weight(kept) / F.greatest(weight(F.col("_keep")), F.lit(1e-8))),
            "P": compression_penalty(F.length(_said(F.col("memory_after")))),
            "severe": F.when((F.size("_after") == 0) & unparseable(F.col("memory_after")), "unparseable").when((F.size("_keep") > 0) & (F.size("_after") == 0), "empty").when(conflicts(F.col("_after"), F.col("verified")), "conflicts"),
        }
    )
    return made.withColumn("r_memory", F.when(F.col("severe").isNotNull(), -1.0).otherwise(memory_reward(F.col("F"), F.col("S"), F.col("P")))).drop("_after", "_before", "_keep")


def combined(tools: DataFrame, answers: DataFrame, memories: DataFrame) -> DataFrame:
    """(sq, r_tool, r_answer, r_memory, reward): mean tool reward of the steps (0 without any), and the mean of the three."""
    steps = tools.groupBy("sq").agg(F.avg("r_tool").alias("r_tool"))
    joined = answers.select("sq", "r_answer").join(memories.select("sq", "r_memory"), "sq").join(steps, "sq", "left").withColumn("r_tool", F.coalesce("r_tool", F.lit(0.0)))
    return joined.select("sq", "r_tool", "r_answer", "r_memory", ((F.col("r_tool") + F.col("r_answer") + F.col("r_memory")) / 3).alias("reward"))


def with_counterfactual(segments: DataFrame, audits: DataFrame, *keys: str, eps: float = 1e-8) -> DataFrame:
    """Memory segments (rollout, boundary, value, keys) whose value is replaced by that of their audit (rollout, boundary, final), where there is one, and z anew within the keys."""
    merged = segments.join(audits.select("rollout", "boundary", "final"), ["rollout", "boundary"], "left").withColumn("value", F.coalesce("final", "value")).drop("final")
    stats = merged.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    z = F.when((F.col("n") <= 1) | (F.col("std") < eps), 0.0).otherwise((F.col("value") - F.col("mean")) / (F.col("std") + eps))
    return merged.join(stats, list(keys)).withColumn("z", z).drop("n", "mean", "std")


def contradicting(held: DataFrame, verified: DataFrame, key: str = "sq") -> DataFrame:
    """(key, fact, item) of facts (key, fact, entity, time, metric, number) and verified items (key, item, ...) that agree on two of the three and are over 5 % apart.

    Joined on each pair of fields, so that a hot sub-question is spread over its entities, times and metrics.
    """
    out = None
    for a, b in (("entity", "time"), ("entity", "metric"), ("time", "metric")):
        named = lambda df: df.where(f"coalesce(trim({a}), '') <> '' and coalesce(trim({b}), '') <> '' and number is not null")  # noqa: E731, B023
        met = named(held).select(key, a, b, "fact", F.col("number").alias("x")).join(named(verified).select(key, a, b, "item", F.col("number").alias("y")), [key, a, b])
        hits = met.where((F.abs("y") > 1e-8) & (F.abs(F.col("x") - F.col("y")) / F.abs("y") > 0.05)).select(key, "fact", "item")
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def gate_issues(memory: Column, most: int = 4096) -> Column:
    """What keeps a generated memory from being used, without a model: it is no object, holds nothing, is too long, or guesses at causes."""
    held = facts(memory)
    derived = F.transform(F.filter(held, lambda f: f["kind"] == "fact"), lambda f: f["text"])
    return F.array_compact(F.array(F.when(unparseable(memory), "unparseable"), F.when(~unparseable(memory) & (F.size(held) == 0), "empty"), F.when(F.length(_said(memory)) > most, "too long"), F.when(F.size(speculative(derived)) > 0, "speculative")))
