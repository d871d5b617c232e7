"""Structural and training metrics over tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vocab
from quarry.functions.text import let


def with_balance(found: DataFrame, symbols: str = "ids", closes: dict | None = None) -> DataFrame:
    """found with balance (share of openings whose closing stands where it should) and strict."""
    own = vocab.balance(F.col(symbols), closes or vocab.CLOSES)
    return found.withColumn("__balance", own).withColumns({"balance": F.col("__balance.rate"), "strict": F.col("__balance.strict")}).drop("__balance")


def nesting(symbols: Column, change: Callable[[Column], Column]) -> Column:
    """(most, last): the greatest and the final depth of an array of symbols, each of which changes
    the depth by change(symbol); nulls for an empty array. Within the row, in one pass."""
    zero = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("most"))

    def step(s: Column, x: Column) -> Column:
        now = s["depth"] + change(x)
        return F.struct(now.alias("depth"), F.coalesce(F.greatest(s["most"], now), now).alias("most"))

    return F.aggregate(symbols, zero, step, lambda s: F.struct(s["most"].alias("most"), F.when(s["most"].isNotNull(), s["depth"]).alias("last")))


def first_subtree(symbols: Column, open_: str, close: str) -> Column:
    """The part of an array from its first `open_` to the `close` that brings it back to its level,
    or to the end without one; empty without an `open_`."""
    first = F.array_position(symbols, F.lit(open_)).cast("int")
    rest = F.slice(symbols, F.greatest(first, F.lit(1)), F.size(symbols))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x == open_, 1).when(x == close, -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), (depth == 0).alias("done")))

    n = F.aggregate(rest, zero, step, lambda s: s["n"])
    return F.when(first > 0, F.slice(rest, 1, n)).otherwise(F.slice(symbols, 1, 0))


def learning_rate(step: Column, lr: float = 3e-4, min_lr: float = 3e-5, warmup: int = 200, max_steps: int = 20_000) -> Column:
    """Linear warm-up, then a cosine down to min_lr, and min_lr from max_steps on."""
    progress = (step - warmup) / max(1, max_steps - warmup)
    cosine = F.lit(min_lr) + F.lit(0.5) * (1 + F.cos(F.lit(math.pi) * progress)) * F.lit(lr - min_lr)
    return F.when(step < warmup, F.lit(lr) * (step + 1) / warmup).when(step >= max_steps, F.lit(min_lr)).otherwise(cosine)


def interval_means(steps: DataFrame, step: str, value: str, every: int = 10) -> DataFrame:
    """interval, mean of value over each whole run of `every` steps, counted from 1; a run that
    isn't whole is not reported."""
    own = steps.groupBy(F.floor((F.col(step) - 1) / every).alias("interval")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return own.filter(F.col("n") == every).select("interval", "mean")


def interval_latency(steps: DataFrame, step: str, micros: str, every: int = 10) -> DataFrame:
    """interval, latency: seconds a step from the end of the interval before; an interval that has
    none before it is not reported. Intervals are few beside steps, and each is joined with the one
    of the number before."""
    own = steps.groupBy(F.floor((F.col(step) - 1) / every).alias("interval")).agg(F.count("*").alias("n"), F.max(micros).alias("t"))
    before = own.select((F.col("interval") + 1).alias("interval"), F.col("t").alias("prev"))
    return own.join(before, "interval").filter(F.col("n") == every).select("interval", ((F.col("t") - F.col("prev")) / 1e6 / every).alias("latency"))


def mean_of_first(losses: DataFrame, order: str, value: str, iters: int = 20) -> DataFrame:
    """mean of value over the first `iters` rows; 0 without any. The limit is the operation."""
    return losses.orderBy(order).limit(iters).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))


def top_k(logits: Column, k: int) -> Column:
    """(idx from 0, logit, rank) of the entries of an array that are at least its k-th largest, of
    which there may be fewer; ties at that place stay, and have one rank. Within the row."""

    def among(order: Column) -> Column:
        each = F.transform(logits, lambda x, i: F.struct(i.alias("idx"), x.alias("logit"), F.array_position(order, x).cast("int").alias("rank")))
        return F.filter(each, lambda e: e["rank"] <= k)

    return let(F.sort_array(logits, asc=False), among)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """The probabilities of an array of logits; temperatures below 1e-6 count as that."""
    scaled = F.transform(logits, lambda x: x.cast("double") / max(temperature, 1e-6))
    powers = let(scaled, lambda own: let(F.array_max(own), lambda top: F.transform(own, lambda x: F.exp(x - top))))
    return let(powers, lambda own: let(F.aggregate(own, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(own, lambda x: x / total)))


def draw(probabilities: Column, u: Column) -> Column:
    """The first index, from 0, at which the summed probabilities exceed u (0 to 1)."""
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("hit"))

    def step(s: Column, p: Column) -> Column:
        now = s["sum"] + p
        return F.struct(now.alias("sum"), (s["i"] + 1).alias("i"), F.coalesce(s["hit"], F.when(now > u, s["i"])).alias("hit"))

    return F.aggregate(probabilities, state, step, lambda s: F.coalesce(s["hit"], s["i"] - 1))


def next_token(logits: Column, u: Column, temperature: float = 1.0, k: int | None = None) -> Column:
    """A step of generation from a row's logits: scaled by the temperature, cut to the k largest (and
    their ties), made probabilities, and one index drawn by u (0 to 1)."""
    if k is None:
        return draw(softmax(logits, temperature), u)
    return let(top_k(logits, k), lambda kept: F.get(kept, draw(softmax(F.transform(kept, lambda e: e["logit"]), temperature), u))["idx"])


def cross_entropy(logits: Column, target: Column) -> Column:
    """The logarithm of the summed exponents less the target's logit (targets from 0)."""
    x = F.transform(logits, lambda v: v.cast("double"))

    def loss(own: Column) -> Column:
        return let(F.array_max(own), lambda top: top + F.log(F.aggregate(own, F.lit(0.0), lambda a, v: a + F.exp(v - top))) - F.element_at(own, target + 1))

    return let(x, loss)
