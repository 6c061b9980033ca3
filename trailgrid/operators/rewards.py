"""Returns, group scores and reward arithmetic of trajectories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def return_to_go(rewards: Column, answer: Column, gamma: float = 0.95, kappa: float = 1.0) -> Column:
    """Of an array of step rewards the discounted returns: each step's own, then what follows, then the answer's one step after the last."""
    zero = F.array().cast("array<double>")
    grown = F.aggregate(F.reverse(rewards), zero, lambda a, r: F.concat(a, F.array(r + gamma * F.coalesce(F.try_element_at(a, F.lit(-1)), kappa * answer))))
    return F.reverse(grown)


def returns(steps: DataFrame, key: str, order: list[str], reward: str, gamma: float = 0.95, block: int = 128) -> DataFrame:
    """steps with `g`, the discounted sum of a step's own reward and all that follow it within the key.

    A key's steps are cut into blocks of at most `block` rows, each folded by itself; what follows a block comes from one
    number a block. No row ever holds a key's whole history.
    """
    t = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    placed = steps.select(key, t.alias("_t"), F.struct(*steps.columns).alias("_x")).withColumn("_b", F.floor(F.col("_t") / block))
    rows = placed.groupBy(key, "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_x"))), lambda r: r["_x"]).alias("_xs"))
    worth = F.transform("_xs", lambda x: x[reward].cast("double"))
    sums = rows.select(key, "_b", F.size("_xs").alias("_n"), F.get(return_to_go(worth, F.lit(0.0), gamma), F.lit(0)).alias("_whole"))
    fold = F.aggregate(
        F.reverse(F.array_sort(F.collect_list(F.struct("_b", "_whole", "_n")))), F.struct(F.lit(0.0).alias("g"), F.array().cast("array<struct<_b:bigint,after:double>>").alias("done")),
        lambda a, x: F.struct((x["_whole"] + F.pow(F.lit(float(gamma)), x["_n"]) * a["g"]).alias("g"), F.concat(a["done"], F.array(F.struct(x["_b"].alias("_b"), a["g"].alias("after")))).alias("done")),
    )
    after = sums.groupBy(key).agg(fold.alias("f")).select(key, F.inline("f.done"))
    made = rows.join(after, [key, "_b"]).select(F.explode(F.arrays_zip(F.col("_xs").alias("x"), return_to_go(worth, F.col("after"), gamma).alias("g"))).alias("z"))
    return made.select("z.x.*", "z.g")


def group_zscore(df: DataFrame, value: str, *keys: str, eps: float = 1e-8) -> DataFrame:
    """df with `z`: 0 for groups of one or without spread, else over population deviation."""
    w = Window.partitionBy(*keys)
    n, mean, std = F.count(value).over(w), F.avg(value).over(w), F.stddev_pop(value).over(w)
    return df.withColumn("z", F.when((n <= 1) | (std < eps), 0.0).otherwise((F.col(value) - mean) / (std + eps)))


def tool_reward(gain: Column, invalid: Column, repeated: Column, eta: float = 1.0, call: float = 0.02, bad: float = 1.0, again: float = 0.2) -> Column:
    return eta * gain - call - bad * invalid.cast("int") - again * repeated.cast("int")


def counterfactual(delta: Column, faithful: Column, reward: Column, weight: float = 0.2, least: float = 0.8) -> Column:
    """Adds the clipped gain; a positive one counts only for faithful memories."""
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), delta))
    gated = F.when((clipped > 0) & (faithful < least), 0.0).otherwise(clipped)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), reward + weight * gated))


def compression_penalty(length: Column, budget: int = 512) -> Column:
    return F.greatest(F.lit(0.0), (length - budget) / F.lit(float(budget)))


def memory_reward(faithful: Column, support: Column, penalty: Column) -> Column:
    """Without a keep-set (null support) its term drops out."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * faithful + F.coalesce(0.4 * support, F.lit(0.0)) - 0.1 * penalty))
