"""Monte-Carlo runs of the decay model: one task a (configuration, seed)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = "config string, seed long, calls_per_day int, days int, top_k int, p_useful double, cycle_days double, speed double, strength int, boost int, theta0 double, theta1 double"
RESULT = "config string, seed long, strength int, boost int, created long, deleted long, alive long, t0 long, t1 long, t2 long, mean_lifetime double, p90_lifetime double, recalls long"


def run_one(c) -> tuple:
    """Counts of one run.  A day makes ``calls_per_day`` memories; every call recalls ``top_k`` living ones, each useful with
    probability ``p_useful``: useful ones gain strength and score, useless ones of the middle tier lose a point; the lowest tier loses a
    point a cycle without use; memories without strength are forgotten."""
    import numpy as np

    rng = np.random.default_rng(int(c.seed))
    strength, score = np.zeros(0), np.zeros(0)
    born, ref = np.zeros(0), np.zeros(0)
    made = recalls = 0
    lives: list = []
    for day in range(int(c.days)):
        n = int(c.calls_per_day)
        strength, score = np.append(strength, np.full(n, float(c.strength))), np.append(score, np.zeros(n))
        born, ref = np.append(born, np.full(n, day)), np.append(ref, np.full(n, day))
        made += n
        hit = rng.integers(0, len(strength), n * int(c.top_k))
        recalls += len(hit)
        useful = rng.random(len(hit)) < c.p_useful
        good, bad = np.bincount(hit[useful], minlength=len(strength)), np.bincount(hit[~useful], minlength=len(strength))
        middle = (score >= c.theta0) & (score < c.theta1)
        strength = strength + good * int(c.boost) - np.where(middle, bad, 0) * (1.0 / max(1, int(c.top_k)))
        score = score + good * c.speed
        ref = np.where(good > 0, day, ref)
        low = score < c.theta0
        steps = np.where(low, np.floor((day - ref) / c.cycle_days), 0)
        strength = strength - steps
        ref = ref + steps * c.cycle_days
        gone = strength <= 0
        lives.append(day - born[gone])
        keep = ~gone
        strength, score, born, ref = strength[keep], score[keep], born[keep], ref[keep]
    ended = np.sort(np.concatenate(lives)) if lives else np.zeros(0)
    tiers = np.digitize(score, [c.theta0, c.theta1])
    return (
        c.config, int(c.seed), int(c.strength), int(c.boost), made, len(ended), len(strength), int((tiers == 0).sum()), int((tiers == 1).sum()), int((tiers == 2).sum()),
        float(ended.mean()) if len(ended) else None, p90_exclusive(list(ended)), recalls,
    )


def p90_exclusive(values: list) -> float | None:
    """The ninth decile by the exclusive method: rank 0.9 (n + 1), interpolated, within the extremes' line."""
    n = len(values)
    if n < 2:
        return float(values[0]) if n else None
    v = sorted(values)
    j = min(max(int(0.9 * (n + 1)), 1), n - 1)
    d = 0.9 * (n + 1) - j
    return float(v[j - 1] + (v[j] - v[j - 1]) * d)


def p90_column(values: Column) -> Column:
    """The same of an array column."""
    v, n = F.array_sort(values), F.size(values)
    j = F.least(F.greatest(F.floor((n + 1) * F.lit(9) / F.lit(10)), F.lit(1)), n - 1).cast("int")
    d = (n + 1) * F.lit(9) / F.lit(10) - j
    return F.when(n < 2, F.get(v, F.lit(0)).cast("double")).otherwise(F.get(v, j - 1) + (F.get(v, j) - F.get(v, j - 1)) * d)


def simulate(configs: DataFrame) -> DataFrame:
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([run_one(c) for c in g.itertuples(index=False)])

    return configs.groupBy("config", "seed").applyInPandas(run, RESULT)


def grid(spark: SparkSession, strengths: list[int], boosts: list[int], repeats: int, **given) -> DataFrame:
    """Configurations of a grid of starting strength and boost."""
    base = {"calls_per_day": 50, "days": 120, "top_k": 10, "p_useful": 0.05, "cycle_days": 3.0, "speed": 2.5, "theta0": 3.0, "theta1": 10.0} | given
    rows = [(f"s{s}b{b}", r, base["calls_per_day"], base["days"], base["top_k"], base["p_useful"], base["cycle_days"], base["speed"], s, b, base["theta0"], base["theta1"]) for s in strengths for b in boosts for r in range(repeats)]
    return spark.createDataFrame(rows, CONFIG)


def grid_average(results: DataFrame) -> DataFrame:
    """(strength, boost, deletion_ratio, survive_ratio, mean_lifetime) over the repeats."""
    ratio = F.col("deleted") / F.col("created")
    return results.groupBy("strength", "boost").agg(F.avg(ratio).alias("deletion_ratio"), F.avg(1 - ratio).alias("survive_ratio"), F.avg("mean_lifetime").alias("mean_lifetime"), F.avg("p90_lifetime").alias("p90_lifetime"))
