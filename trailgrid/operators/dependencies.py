"""Evidence that the points of an answer ask for, what derived values rest on, and what later turns need of earlier ones.

Nothing here joins turns with turns: shared things are counted by windows over their own occurrences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import claims
from ..functions.answers import first_time


def evidence_items(points: DataFrame) -> DataFrame:
    """(sample, sq, item_no, item, kind, value, time, unit, operation, tables, confidence) of points (sample, sq, point_no, point, tables).

    Each value of a point is an item, derived if the point asks for a computation; a point without values is one text
    fact, so that none is lost. A null point counts as an empty one. Ids number the items of a sub-question.
    """
    point = F.coalesce("point", F.lit(""))
    asks, time = claims.computation(point), first_time(point)
    numeric = F.transform(claims.value_tokens(point), lambda v: F.struct(F.when(asks.isNotNull(), "derived_value").otherwise("raw_value").alias("kind"), v.alias("value"), F.regexp_replace(v, r"^[\d.,\s]+", "").alias("unit")))
    whole = F.array(F.struct(F.lit("text_fact").alias("kind"), point.alias("value"), F.lit(None).cast("string").alias("unit")))
    made = points.select("sample", "sq", "point_no", "tables", asks.alias("asks"), time.alias("when"), F.posexplode(F.when(F.size(numeric) > 0, numeric).otherwise(whole)).alias("k", "i"))
    text_fact = F.col("i.kind") == "text_fact"
    no = F.row_number().over(Window.partitionBy("sample", "sq").orderBy("point_no", "k"))
    made = made.withColumn("item_no", no)
    return made.select(
        "sample", "sq", "item_no", F.concat(F.lit("sq"), F.col("sq").cast("string"), F.lit("_e"), F.col("item_no").cast("string")).alias("item"), "i.kind", "i.value",
        F.when(~text_fact, F.col("when")).alias("time"), "i.unit", F.when(~text_fact, F.col("asks")).alias("operation"), "tables",
        F.when(text_fact, 0.3).when(F.col("when").isNull(), 0.45).otherwise(0.6).alias("confidence"),
    )


_TIERS = (("sample", "entity", "time"), ("sample", "entity"), ("sample", "time"), ("sample",))


def link_tiers(items: DataFrame) -> DataFrame:
    """Derived items (sample, item, entity, time) with the tier that links them to raw ones and the number of these.

    Tier 1: same entity and time; 2: same entity; 3: same time; 4: all of the sample. No raw value: tier null, 0 inputs.
    Counts by key are joined, never the raw items themselves; `links` gives those.
    """
    raw, made = items.where("kind = 'raw_value'"), items.where("kind = 'derived_value'")
    for k, keys in enumerate(_TIERS, 1):
        made = made.join(raw.where(" and ".join(f"{x} is not null" for x in keys)).groupBy(*keys).agg(F.count("*").alias(f"n{k}")), list(keys), "left")
    tier = F.coalesce(*[F.when(F.col(f"n{k}") > 0, k) for k in range(1, 5)])
    n = F.coalesce(*[F.col(f"n{k}") for k in range(1, 5)], F.lit(0))
    return made.select("sample", "item", "entity", "time", tier.alias("tier"), n.alias("inputs"))


def links(items: DataFrame) -> DataFrame:
    """(sample, item, input): each derived item beside the raw items of its tier. As many rows as there are links."""
    tiers, raw = link_tiers(items), items.where("kind = 'raw_value'").withColumnRenamed("item", "input")
    parts = [tiers.where(F.col("tier") == k).select("item", *keys).join(raw.select("input", *keys), list(keys)).select("sample", "item", "input") for k, keys in enumerate(_TIERS, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def future_dependencies(turns: DataFrame, reach: int = 2) -> DataFrame:
    """(sample, boundary, needed_by, kind, what, ref_kind, sources, first_source, last_source): what turns up to `reach` past a boundary need of turns before it.

    turns: (sample, pos from 1 without gaps, text, tables array, values array). A boundary lies after the turn of its
    number. Shared entities, tables and constraints are needed of each earlier turn that has them; a shared metric
    only of turns whose evidence values name it; an expression that points back, of every earlier turn. One row tells
    the number of source turns, the first and the last, so that output grows with the turns, not with their pairs.
    """
    none = F.lit(None).cast("string")
    put = lambda kind, texts: F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("what"), none.alias("ref_kind")))
    tables = F.array_distinct(F.filter(F.coalesce("tables", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    points = F.transform(claims.references(F.col("text")), lambda r: F.struct(F.lit("reference").alias("kind"), r["text"].alias("what"), r["kind"].alias("ref_kind")))
    things = F.concat(points, put("entity_set", claims.entities(F.col("text"))), put("numeric_fact", claims.metrics(F.col("text"))), put("table_ref", tables), put("constraint", claims.constraints(F.col("text"))))
    f = turns.select("sample", "pos", "values", F.explode(things).alias("f")).select("sample", "pos", "values", "f.*")
    gives = (F.col("kind") != "numeric_fact") | claims.any_in(F.col("what"), F.col("values"))
    by = Window.partitionBy("sample", "kind", "what").orderBy("pos")
    at = F.when(gives, F.col("pos"))
    seen = []
    for back in range(1, reach + 1):
        w = by.rangeBetween(Window.unboundedPreceding, -back)
        shared = F.struct(F.count(at).over(w).alias("sources"), F.min(at).over(w).alias("first_source"), F.max(at).over(w).alias("last_source"))
        i = F.col("pos") - back
        every = F.struct(F.greatest(i, F.lit(0)).cast("long").alias("sources"), F.lit(1).cast(turns.schema["pos"].dataType).alias("first_source"), i.cast(turns.schema["pos"].dataType).alias("last_source"))
        seen.append(F.struct(i.alias("boundary"), F.when(F.col("kind") == "reference", every).otherwise(shared).alias("s")))
    rows = f.withColumn("seen", F.array(*seen)).select("sample", F.col("pos").alias("needed_by"), "kind", "what", "ref_kind", F.explode("seen").alias("b"))
    return rows.select("sample", "b.boundary", "needed_by", "kind", "what", "ref_kind", "b.s.*").where("sources > 0")


def enriched(rule: DataFrame, told: DataFrame) -> DataFrame:
    """(sample, sq, kind, value, entity, time, metric, unit, operation, confidence): items that a model told of a sub-question, else those of the rules.

    rule and told: (sample, sq, kind, value, entity, time, metric, unit, operation[, confidence]). A told item starts at
    0.75, less 0.05 for each of entity, time, metric and unit that is missing, less 0.1 for a derived value without its
    operation; unknown kinds become text facts.
    """
    missing = lambda c: (F.coalesce(F.col(c), F.lit("")) == "").cast("int")
    kind = F.when(F.col("kind").isin("raw_value", "derived_value", "text_fact"), F.col("kind")).otherwise("text_fact")
    bare = ((kind == "derived_value") & (F.coalesce("operation", F.lit("")) == "")).cast("int")
    confidence = F.lit(0.75) - 0.05 * (missing("entity") + missing("time") + missing("metric") + missing("unit")) - 0.1 * bare
    columns = ["sample", "sq", "kind", "value", "entity", "time", "metric", "unit", "operation"]
    made = told.select(*[F.col(c) for c in columns], F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence")).withColumn("kind", kind)
    return made.unionByName(rule.select(*columns, "confidence").join(told.select("sample", "sq").distinct(), ["sample", "sq"], "left_anti"))
