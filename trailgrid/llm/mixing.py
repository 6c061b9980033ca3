"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the rate of copies of each of its documents. The whole part is
taken as it is; the fractions are rounded in pairs: words move from one document to the other at
random, without changing expectations or their sum, until one fraction is 0 or 1. Each chunk of
CHUNK documents folds to one unsettled document, and those are chunked again: a reduction tree of
depth log CHUNK of the largest source. The last document of a source takes the words that are left,
so that a source misses its target by rounding of one word only.

Defined cases: a null or wordless text has size 0 and nothing is taken; a null source is a source of
its own, last; equal rows (id, source, size) are rounded as one unit and share its words; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, unit, word_count

#: Documents that one task rounds together.
CHUNK = 64
#: Sources up to which the table of targets is broadcast.
FEW = 10_000
_DONE = "array<struct<key:{key},size:bigint,m:bigint,extra:double>>"
_OPEN = "struct<key:{key},size:bigint,m:bigint,p:double>"


def let(value: F.Column, body) -> F.Column:
    """body of value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def numbered(df: DataFrame, scratch: Scratch, name: str, *order: str) -> DataFrame:
    """df with `place`, its number from 0 in an order: ranges of rows are numbered apart and start where those before end, so no task sorts all."""
    ranged = scratch.keep(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    counts = dict(ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    before, upto = {}, 0
    for part in sorted(counts):
        before[part], upto = upto, upto + counts[part]
    start = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])[F.col("part").cast("long")] if before else F.lit(0).cast("long")
    return ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + start).drop("part")


def targets(units: DataFrame, share: float, cap: float, weights: tuple[float, ...], scratch: Scratch) -> DataFrame:
    """Per source: none, name, source_size, units, target, for any number of sources.

    All share by weight what sources at their ceiling leave; each round puts those above theirs there, until none is above.
    """
    per = units.groupBy("none", "name").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("units"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ceiling = F.lit(float(cap)) * F.col("source_size")
    ranked = scratch.keep(numbered(per, scratch, "sources", "none", "name").withColumn("w", weight).withColumn("ceiling", ceiling).drop("place"), "ranked")
    whole = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.sum("w").alias("w")).first()
    level = float(share) * whole["all"] / whole["w"] if whole["w"] else 0.0
    while True:
        over = F.col("ceiling") <= F.lit(level) * F.col("w")
        now = ranked.agg(F.coalesce(F.sum(F.when(over, F.col("ceiling"))), F.lit(0.0)).alias("full"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        later = (float(share) * whole["all"] - now["full"]) / now["w"] if now["w"] else math.inf
        if later <= level:
            break
        level = later
    target = F.least(F.col("ceiling"), F.lit(level) * F.col("w"))
    return ranked.select("none", "name", "source_size", "units", target.alias("target"))


def _step(state: F.Column, x: F.Column, key: str) -> F.Column:
    """One pair: x against the unsettled document of state."""
    done, was = state["done"], state["open"]
    opened = lambda d, p: F.struct(d["key"], d["size"], d["m"], p.alias("p")).cast(_OPEN.format(key=key))
    settled = lambda d, extra: F.array(F.struct(d["key"], d["size"], d["m"], F.lit(float(extra)))).cast(_DONE.format(key=key))
    state_of = lambda d, more, left: F.struct(F.concat(d, more).alias("done"), left.alias("open"))

    def pair(v: F.Column) -> F.Column:
        to_was, to_x, a, b = v["to_was"], v["to_x"], v["a"], v["b"]
        gain_was = v["r"] * (to_was + to_x) < to_x
        up = F.when(gain_was, to_was).otherwise(-to_x)
        p, q = was["p"] + up / a, x["p"] - up / b
        return (
            F.when(gain_was & (to_was >= v["room_was"]), state_of(done, settled(was, 1), opened(x, q)))
            .when(gain_was, state_of(done, settled(x, 0), opened(was, p)))
            .when(to_x >= v["room_x"], state_of(done, settled(x, 1), opened(was, p)))
            .otherwise(state_of(done, settled(was, 0), opened(x, q)))
        )

    a, b = (was["size"] * was["m"]).cast("double"), (x["size"] * x["m"]).cast("double")
    room_was, room_x = (1 - was["p"]) * a, (1 - x["p"]) * b
    values = F.struct(a.alias("a"), b.alias("b"), room_was.alias("room_was"), room_x.alias("room_x"), F.least(room_was, x["p"] * b).alias("to_was"), F.least(room_x, was["p"] * a).alias("to_x"), unit(x["h"], was["key"]).alias("r"))
    return F.when(was.isNull(), F.struct(done.alias("done"), opened(x, x["p"]).alias("open"))).otherwise(let(values, pair))


def _round(rows: DataFrame, seed: int, level: int, key: str) -> DataFrame:
    """rows (none, name, units at this level, key, size, m, p) to (none, name, done, open), a row a chunk."""
    h = F.xxhash64("key", "size", F.lit(seed), F.lit(level))
    chunk = F.pmod(h, F.ceil(F.col("units") / CHUNK)).alias("chunk")
    taken = rows.select("none", "name", chunk, F.struct(h.alias("h"), "key", "size", "m", "p").alias("x"))
    start = F.struct(F.array().cast(_DONE.format(key=key)).alias("done"), F.lit(None).cast(_OPEN.format(key=key)).alias("open"))
    folded = F.aggregate(F.array_sort("xs"), start, lambda s, x: _step(s, x, key))
    return taken.groupBy("none", "name", "chunk").agg(F.collect_list("x").alias("xs")).select("none", "name", folded.alias("f")).select("none", "name", "f.done", "f.open")


def plan(documents: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (5, 2, 1), seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(key, size, none, name, m, source_size, target, copies, words): each of the m rows of a unit is copied
    `copies` times, and `words` more words are taken from the unit's rows together."""
    scratch = Scratch(documents.sparkSession, "mixing")
    key = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("key"), F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"), word_count(F.col(text_col)).alias("size"))
    units = scratch.keep(rows.groupBy("key", "none", "name", "size").agg(F.count("*").alias("m")), "units")
    goals = scratch.keep(targets(units, share, cap, weights, scratch), "targets")
    few = goals.limit(FEW + 1).count() <= FEW
    goals = F.broadcast(goals) if few else goals
    most = goals.agg(F.coalesce(F.max("units"), F.lit(0))).first()[0]
    rated = units.join(goals, ["none", "name"]).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    whole = F.floor("rate").cast("long")
    now = rated.where("size > 0 and rate > floor(rate)").select("none", "name", "units", "key", "size", "m", (F.col("rate") - whole).alias("p"))
    settled, level = [], 0
    while True:
        out = scratch.keep(_round(now, seed, level, key), f"round{level}")
        settled.append(out.select("none", "name", F.explode("done").alias("d")).select("none", "name", "d.*"))
        rest = out.where("open is not null").select("none", "name", "open.*")
        most, level = -(-most // CHUNK), level + 1
        if most <= 1:
            break
        sizes = goals.select("none", "name", F.ceil(F.col("units") / float(CHUNK**level)).alias("units"))
        now = rest.join(F.broadcast(sizes) if few else sizes, ["none", "name"]).select("none", "name", "units", "key", "size", "m", "p")
    ends = rest.select("none", "name", "key", "size", "m", F.lit(0.0).alias("extra"), F.round(F.col("p") * F.col("size") * F.col("m")).cast("long").alias("words"))
    for s in settled:
        ends = ends.unionAll(s.select("none", "name", "key", "size", "m", "extra", F.lit(0).cast("long").alias("words")))
    still = rated.where("size = 0 or rate <= floor(rate)").select("none", "name", "key", "size", "m", F.lit(0.0).alias("extra"), F.lit(0).cast("long").alias("words"))
    known = goals.select("none", "name", "source_size", "target", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("base"))
    return ends.unionAll(still).join(F.broadcast(known) if few else known, ["none", "name"]).select("key", "size", "none", "name", "m", "source_size", "target", (F.col("base") + F.col("extra").cast("long")).alias("copies"), "words")


def mix(documents: DataFrame, **options) -> DataFrame:
    """Per document row: doc_id, source, size, source_size, target, copies, taken."""
    rows = plan(documents, **options).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1)))
    share = F.floor(F.col("words") / F.col("m")) + F.when(F.col("row") < F.col("words") % F.col("m"), 1).otherwise(0)
    return rows.select(F.col("key").alias("doc_id"), F.when(~F.col("none"), F.col("name")).alias("source"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies") + share).cast("long").alias("taken"))


def apply(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: each row as often as it is copied, then the first words of a document that is taken in part.

    Columns of documents may have any names. Null ids and repeated rows are mixed like others; rows of equal id,
    source and size share the words of a part. A wordless text is never taken.
    """
    columns = documents.columns
    made = plan(documents, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    made = made.select("key", "none", "name", "size", F.col("copies").cast("int").alias("copies"), F.floor(F.col("words") / F.col("m")).cast("int").alias("part"))
    given = documents.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("doc"), F.col(id_col).alias("i"), F.col(text_col).alias("txt"),
        F.col(source_col).isNull().alias("n"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("s"), word_count(F.col(text_col)).alias("z"),
    )
    on = F.col("i").eqNullSafe(F.col("key")) & (F.col("n") == F.col("none")) & (F.col("s") == F.col("name")) & (F.col("z") == F.col("size"))
    cuts = F.concat(F.array_repeat(F.lit(0), F.col("copies")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<int>")))
    rows = given.join(made, on).withColumn("cut", F.explode(cuts))
    first = F.array_join(F.slice(F.filter(F.split("txt", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.greatest(F.col("cut"), F.lit(1))), " ")
    text = F.when(F.col("cut") > 0, first).otherwise(F.col("txt"))
    return rows.select(*[(text if c == text_col else F.col(f"doc.c{i}")).alias(c) for i, c in enumerate(columns)])
