"""Learning-rate plans and step estimates as tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LrPlan:
    """Inputs of a learning-rate curve; all explicit, since programs differ in their defaults."""

    base: float = 2e-4
    total_steps: int = 100
    warmup_steps: int = 0
    kind: str = "cosine"  # or linear, constant
    floor: float = 0.0
    decay_factor: float = 1.0


def lr_curve(spark: SparkSession, plan: LrPlan) -> DataFrame:
    """``step, scale, lr``: linear warm-up without floor, then the decay over ``decay_factor`` of the remaining steps, rounded up.

    Warm-up leaves one step at least; a plan of one step has scale 1.
    """
    total = max(1, plan.total_steps)
    warm = max(0, min(plan.warmup_steps, total - 1))
    span = max(1, math.ceil((total - warm) * plan.decay_factor))
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("step").cast("double") - warm) / F.lit(float(span))))
    decayed = {"linear": 1 - at, "cosine": 0.5 * (1 + F.cos(F.lit(math.pi) * at))}.get(plan.kind, F.lit(1.0))
    scale = F.greatest(F.lit(float(plan.floor)), decayed)
    if warm:
        scale = F.when(F.col("step") < warm, (F.col("step") + 1).cast("double") / F.lit(float(warm))).otherwise(scale)
    return spark.range(total + 1).select(F.col("id").alias("step"), scale.alias("scale"), (scale * F.lit(plan.base)).alias("lr"))


def running_min(curve: DataFrame, warmup_steps: int) -> DataFrame:
    """The curve with ``applied``: after warm-up a rate never rises again. A plan's steps are few, so one window does."""
    after = F.col("step") >= warmup_steps
    low = F.min(F.when(after, F.col("lr"))).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return curve.withColumn("applied", F.when(after, low).otherwise(F.col("lr")))


def extend_only(totals: DataFrame, order: str = "event", total: str = "total", done: str = "done", width: int = 4096) -> DataFrame:
    """``planned``: estimates may only raise the planned total, and none does after the producer is done.

    ``order`` is a number; null sorts first. Maxima run inside ranges of ``width`` of it, and only the table of range
    maxima, thousands of times smaller than the rows, meets in one window.
    """
    at = F.struct(F.col(order).isNotNull().alias("k"), F.col(order).alias("o"))
    stop = totals.where(done).agg(F.min(at).alias("_stop"))
    rows = totals.crossJoin(F.broadcast(stop)).withColumn("_t", F.when(F.col("_stop").isNull() | (at <= F.col("_stop")), F.col(total)))
    rows = rows.withColumn("_r", F.floor(F.col(order) / width)).drop("_stop")
    upto = Window.orderBy(F.col("_r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_r").agg(F.max("_t").alias("_m")).select(F.col("_r").alias("_b"), F.max("_m").over(upto).alias("_before"))
    inside = F.max("_t").over(Window.partitionBy("_r").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("_in", inside).join(before, F.col("_r").eqNullSafe(F.col("_b")))
    return placed.withColumn("planned", F.greatest("_before", "_in")).drop("_t", "_r", "_b", "_in", "_before")


def min_change(plans: DataFrame, current: str = "current_steps", proposed: str = "proposed_steps", least: float = 0.05) -> DataFrame:
    """Adds ``relative_change`` and ``should_update``: a new plan counts if it differs by at least ``least`` of the current one."""
    change = F.abs(F.col(proposed) - F.col(current)) / F.greatest(F.lit(1), F.col(current))
    return plans.withColumns({"relative_change": change, "should_update": (F.col(proposed) != F.col(current)) & (change >= least)})


def step_estimate(plans: DataFrame) -> DataFrame:
    """``steps`` from ``samples, world, batch, accumulation, epochs, max_steps``: ceiling after ceiling; ``max_steps`` wins if it isn't null, 1 at least."""
    up = lambda a, b: F.ceil(a / F.greatest(F.lit(1), b)).cast("long")
    one = lambda c: F.greatest(F.lit(1), c)
    per_rank = up(one(F.col("samples")), F.col("world"))
    per_epoch = one(up(one(up(per_rank, F.col("batch"))), F.col("accumulation")))
    steps = one(F.ceil(per_epoch * F.col("epochs"))).cast("long")
    return plans.withColumns({"per_epoch": per_epoch, "steps": F.when(F.col("max_steps").isNotNull(), one(F.col("max_steps").cast("long"))).otherwise(steps)})


def projected(progress: DataFrame) -> DataFrame:
    """``projected, source`` of ``estimate, seen, tokenized, total``: the finished count, else the estimate scaled by the kept share, else the estimate.

    ``total`` is null until the producer has finished. A finished count of 0 leaves the estimate; so does a share while nothing is seen or
    kept, or one that rounds to 0 (halves to even). No result is below 1.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.bround(F.col("estimate") * (F.col("tokenized") / F.col("seen"))).cast("long")
    live = F.col("total").isNull() & (known("seen") > 0) & (known("tokenized") > 0) & (F.col("estimate") > 0)
    live = live & F.when(live, share > 0).otherwise(False)
    return progress.withColumns({
        "projected": F.greatest(F.lit(1), F.when(known("total") > 0, F.col("total")).when(live, share).otherwise(F.col("estimate"))).cast("long"),
        "source": F.when(known("total") > 0, "meta").when(live, "progress").otherwise("estimate")})


def token_throughput(steps: DataFrame) -> DataFrame:
    """Nominal tokens a step and so far, from ``seq, batch, accumulation, world, step``."""
    each = F.col("seq").cast("long") * F.col("batch") * F.col("accumulation") * F.col("world")
    return steps.withColumns({"tokens_per_step": each, "tokens_so_far": each * F.col("step")})


def epoch_steps(batches: DataFrame) -> DataFrame:
    """Optimiser steps of an epoch: an incomplete last group steps only when not distributed."""
    ratio = F.col("batches") / F.col("accumulation")
    return batches.withColumn("epoch_steps", F.when(F.col("world") > 1, F.floor(ratio)).otherwise(F.ceil(ratio)).cast("long"))
