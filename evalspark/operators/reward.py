"""Rewards of completions, advantages inside groups, and the terms of preference and policy losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.joins import on_groups

# Components of a call's reward and their default weights.
WEIGHTS = {"tool_exists": 0.1, "tool_name": 0.2, "schema": 0.1, "execution": 0.6}
EPSILON, FLAT = 1e-4, 1e-6


def step_reward(reference_kind: Column, predicted_kind: Column, exists: Column, same_names: Column, schema: Column, same_effect: Column, weights: dict[str, float] | None = None) -> Column:
    """The gated reward: names count once all tools exist, the effect once all arguments fit; the same effect earns the names.

    What didn't parse is worth 0, a reply is worth 1 exactly where a reply was due.
    """
    w = WEIGHTS if weights is None else weights
    if set(w) != set(WEIGHTS) or min(w.values()) < 0 or sum(w.values()) <= 0:
        raise ValueError(f"weights must be non-negative for exactly {sorted(WEIGHTS)}")
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    fits = one(exists) * one(schema)
    effect = fits * one(same_effect)
    named = one(exists) * F.greatest(one(same_names), effect)
    total = (w["tool_exists"] * one(exists) + w["tool_name"] * named + w["schema"] * fits + w["execution"] * effect) / sum(w.values())
    both = (reference_kind == "tool_call") & (predicted_kind == "tool_call")
    return F.when(predicted_kind.isNull(), 0.0).when(both, F.round(total, 6)).when((reference_kind == "reply") & (predicted_kind == "reply"), 1.0).otherwise(0.0)


def group_advantages(rows: DataFrame, by: list[str], reward: str) -> DataFrame:
    """`rows` with advantage = (reward - mean) / (population sd + 1e-4); null in groups whose rewards are all equal.

    The group's moments are an aggregate joined back, so a large group isn't gathered in one task.
    """
    moments = rows.groupBy(*by).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_sd"))
    joined = on_groups(rows, moments, by)
    return joined.select(*rows.columns, F.when(F.col("_sd") >= FLAT, (F.col(reward) - F.col("_mean")) / (F.col("_sd") + EPSILON)).alias("advantage"))


def preference_terms(beta: float, pc: Column, pr: Column, rc: Column, rr: Column) -> tuple[Column, Column, Column]:
    """(loss, weight, z): -log sigmoid(z) without overflow, and beta * sigmoid(-z), the size of both gradients."""
    z = F.lit(beta) * ((pc - rc) - (pr - rr))
    return F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))), F.lit(beta * 0.5) * (1 - F.tanh(z / 2)), z


def policy_loss(policy: Column, reference: Column, advantage: Column, kl_weight: float) -> Column:
    """-advantage * mean(policy) + kl_weight * mean(exp(d) - d - 1) over the arrays, d = reference - policy."""
    n = F.size(policy).cast("double")
    mean = F.try_divide(F.aggregate(policy, F.lit(0.0), lambda x, p: x + p), n)
    k3 = F.try_divide(F.aggregate(F.zip_with(policy, reference, lambda p, r: F.exp(r - p) - (r - p) - 1), F.lit(0.0), lambda x, k: x + k), n)
    return -advantage * mean + F.lit(kl_weight) * k3


def learning_rate(step: Column, total: int, warm_up: float = 0.1) -> Column:
    """The factor at a step: linear over the first tenth, then down to 0."""
    warm = max(1, round(warm_up * total))
    return F.when(step < warm, (step + 1) / warm).otherwise(F.greatest(F.lit(0.0), (total - step) / max(1, total - warm)))


def batch_loss(rows: DataFrame, ordinal: str, loss: str, tokens: str, size: int) -> DataFrame:
    """(batch, loss): the sum of losses over the sum of target tokens of each `size` rows."""
    agg = rows.groupBy(F.floor(F.col(ordinal) / size).alias("batch")).agg(F.sum(loss).alias("l"), F.sum(tokens).alias("n"))
    return agg.select("batch", F.try_divide(F.col("l").cast("double"), F.col("n").cast("double")).alias("loss"))


def target_count(labels: Column, ignored: int = -100) -> Column:
    """Targets after the shift by one place."""
    return F.size(F.filter(F.slice(labels, 2, 1 << 30), lambda x: x != ignored))


def collapsed(before: Column, after: Column, teacher: Column, drift: float) -> Column:
    """Whether a call rate ran away from the teacher's, or fell below half of what it and the teacher had."""
    return (F.abs(after - teacher) - F.abs(before - teacher) > drift) | (after < 0.5 * F.least(before, teacher))


def cut(text: Column, limit: int, mark: str = " …") -> Column:
    """The first `limit` characters, with a mark if there were more."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def calls_per_minute(tokens_per_minute: Column, average: Column, requests_per_minute: Column) -> Column:
    """The tighter of two limits; null is no limit."""
    return F.least(F.try_divide(tokens_per_minute.cast("double"), average.cast("double")), requests_per_minute.cast("double"))


def episodes_per_day(requests_per_day: Column, steps_per_episode: int = 8) -> Column:
    """What a daily request cap permits; null is no cap."""
    return requests_per_day.cast("double") / steps_per_episode


def worst_case(max_turns: Column) -> Column:
    """The most requests an episode can need: two a turn, one judgement and its repetition."""
    return max_turns * 2 + 2


def affordable(wanted: Column, remaining: Column, cost: Column) -> Column:
    """Whole episodes that a quota still pays for; a null quota pays for all."""
    return F.least(wanted, F.when(cost > 0, F.floor(remaining / cost)))
