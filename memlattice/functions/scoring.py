"""Scores, decay and the soul state's mappings, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class DecayConfig:
    """Tier bounds of the useful score and the natural-decay cycle."""

    theta0: float = 3.0
    theta1: float = 10.0
    cycle_days: float = 3.0
    consolidate_speed: float = 2.5
    forget_speed: float = 1.0
    base_forget_speed: float = 1.0
    reinforce: int = 1
    useless_step: int = 1
    extra: dict = field(default_factory=dict)

    @classmethod
    def clamped(cls, **given) -> DecayConfig:
        """From untrusted settings: bounds in order, speeds and cycle positive."""
        own = {k: v for k, v in given.items() if k in cls.__dataclass_fields__ and k != "extra"}
        c = cls(**own)
        t0 = max(0.0, float(c.theta0))
        return cls(t0, max(t0, float(c.theta1)), max(1.0, float(c.cycle_days)), max(0.01, float(c.consolidate_speed)), max(0.01, float(c.forget_speed)), max(0.01, float(c.base_forget_speed)), max(0, int(c.reinforce)), max(0, int(c.useless_step)))

    @property
    def cycle_seconds(self) -> float:
        days = max(1, round(max(1.0, self.cycle_days) / (max(0.01, self.forget_speed) * max(0.01, self.base_forget_speed))))
        return days * 86400.0


def cycle_days(cycle: Column, forget: Column, base: Column) -> Column:
    """Days of a decay cycle; halves round to even."""
    low = lambda c: F.greatest(c, F.lit(0.01))
    return F.greatest(F.lit(1.0), F.bround(F.greatest(cycle, F.lit(1.0)) / (low(forget) * low(base)))).cast("long")


def tier(useful_score: Column, c: DecayConfig = DecayConfig()) -> Column:
    return F.when(useful_score >= c.theta1, 2).when(useful_score >= c.theta0, 1).otherwise(0)


def decay_reference(last_decay_at: Column, last_recalled_at: Column, created_at: Column) -> Column:
    zero = F.lit(0.0)
    return F.when(F.coalesce(last_decay_at, zero) > 0, last_decay_at).otherwise(F.greatest(F.coalesce(last_recalled_at, zero), F.coalesce(created_at, zero)))


def decay_steps(now: Column, reference: Column, cycle_seconds: float) -> Column:
    """Whole cycles since the reference (truncated, none if it is ahead)."""
    return F.greatest(F.lit(0), ((now - reference) / F.lit(cycle_seconds)).cast("long"))


def time_decay(similarity: Column, age_days: Column, is_active: Column) -> Column:
    """Similarity of passive memories falls with age."""
    return F.when(is_active, similarity).otherwise(similarity / (1.0 + 0.05 * F.greatest(age_days, F.lit(0.0))))


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25_term(n: Column, df: Column, length: Column, average: Column) -> Column:
    """Score of one term that a document holds; index terms are distinct, so its frequency is one."""
    return idf(n, df) * (K1 + 1.0) / (1.0 + K1 * (1.0 - B + B * length / average))


def rrf(rank_text: Column, rank_vector: Column) -> Column:
    return 1.0 / (RRF_K + rank_text) + 1.0 / (RRF_K + rank_vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, 1.0).otherwise(n)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the normalised vectors; a zero vector has cosine 0 with all."""
    return dot(a, b) / (norm(a) * norm(b))


# Fixed values of the soul state: order of the dimensions and (min, mid, max) of each.
SOUL = {"RecallDepth": (1.0, 7.0, 20.0), "ImpressionDepth": (1.0, 3.0, 10.0), "ExpressionDesire": (0.0, 0.5, 1.0), "Creativity": (0.0, 0.7, 1.0)}
REFLECT, RESONATE, ENERGY_LIMIT = 1.0, 0.3, 20.0


def elastic_step(energy: Column, direction: Column, mid: float, strength: Column) -> Column:
    """Energy after one adjustment: the push weakens away from ``mid``, which also pulls."""
    push = direction * strength * F.exp(-0.1 * F.abs(energy - mid))
    return F.greatest(F.lit(-ENERGY_LIMIT), F.least(F.lit(ENERGY_LIMIT), energy + push + (mid - energy) * 0.1))


def soul_value(energy: Column, dimension: str) -> Column:
    """The bounded parameter that an unbounded energy stands for."""
    low, mid, high = SOUL[dimension]
    side = F.when(energy >= 0, high - mid).otherwise(mid - low)
    v = F.greatest(F.lit(low), F.least(F.lit(high), mid + side * F.tanh(0.3 * energy)))
    return F.bround(v) if dimension.endswith("Depth") else F.bround(v, 2)


def soul_share(value: Column, dimension: str) -> Column:
    low, _, high = SOUL[dimension]
    return F.lit(0.5) if high <= low else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))


def resonance_code(averages: dict[str, Column], current: dict[str, Column]) -> Column:
    """A digit a dimension: 1 where the snapshots' average is above the current energy."""
    return F.concat(*[F.when(F.coalesce(averages[d], F.lit(0.0)) > current[d], "1").otherwise("0") for d in SOUL])
