"""Confidence of steps, the routing rule, and what a threshold would have cost and caught."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.running import running_totals
from evalspark.operators.steps import token_number


def signal(kind: Column, name_confidence: Column, step_confidence: Column, which: str) -> Column:
    """The number held against the threshold; null (always escalated) for what didn't parse."""
    if which == "name_only":
        return F.when(kind == "reply", F.lit(1.0)).when(kind == "tool_call", name_confidence)
    return F.when(kind != "unparsed", step_confidence)


def route(present: Column, confidence: Column, threshold: float) -> Column:
    """Why a turn is routed as it is: overflow, unmeasured and low_confidence escalate, confident doesn't."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError(f"threshold {threshold} lies outside [0, 1]")
    return F.when(~present, "overflow").when(confidence.isNull(), "unmeasured").when(confidence < threshold, "low_confidence").otherwise("confident")


def sweep(steps: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """(by, threshold, n_steps, accuracy_before, escalation_rate, accuracy_after, mistakes_caught, wasted_escalations).

    `steps` has signal (null if unmeasured) and right. An escalated step counts as right afterwards. All
    thresholds are counted in one pass, without a join.
    """
    escalated = lambda t: F.col("signal").isNull() | (F.col("signal") < t)
    counts = [c for i, t in enumerate(thresholds) for c in (F.count_if(escalated(t)).alias(f"e{i}"), F.count_if(escalated(t) & ~F.col("right")).alias(f"c{i}"))]
    agg = steps.groupBy(*by).agg(F.count("*").alias("n_steps"), F.count_if(~F.col("right")).alias("n_wrong"), *counts)
    points = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"e{i}").alias("e"), F.col(f"c{i}").alias("c")) for i, t in enumerate(thresholds))))
    rows = agg.select(*by, "n_steps", "n_wrong", points.alias("p")).select(*by, "n_steps", "n_wrong", "p.*")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    n, wrong, e, c = (F.col(x) for x in ("n_steps", "n_wrong", "e", "c"))
    return rows.select(*by, "threshold", "n_steps", ratio(n - wrong, n).alias("accuracy_before"), ratio(e, n).alias("escalation_rate"), ratio(n - wrong + c, n).alias("accuracy_after"), ratio(c, wrong).alias("mistakes_caught"), ratio(e - c, e).alias("wasted_escalations"))


def auroc(steps: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_right, n_wrong, auroc): the chance that a wrong step has the lower signal, ties half; null with one class only.

    Mann-Whitney over counts of equal signals, whose running totals are taken by ranges; no pairs, and no task
    that orders a whole group. Unmeasured steps don't count.
    """
    measured = steps.where(F.col("signal").isNotNull())
    equal = measured.groupBy(*by, "signal").agg(F.count_if(F.col("right")).alias("r"), F.count_if(~F.col("right")).alias("w"))
    summed = running_totals(equal, by, "signal", ["w"])
    wins = summed.select(*by, "r", "w", (F.col("r") * (2 * (F.col("w_upto") - F.col("w")) + F.col("w"))).alias("twice"))
    agg = wins.groupBy(*by).agg(F.sum("r").alias("n_right"), F.sum("w").alias("n_wrong"), F.sum("twice").alias("twice"))
    return agg.select(*by, "n_right", "n_wrong", F.try_divide(F.col("twice").cast("double"), (2 * F.col("n_right") * F.col("n_wrong")).cast("double")).alias("auroc"))


def span_mean(logprobs: Column, starts: Column, ends: Column, a: Column, b: Column) -> Column:
    """The mean log-probability of the tokens [start, end) that overlap [a, b); null if none does."""
    zipped = F.filter(F.arrays_zip(logprobs.alias("p"), starts.alias("s"), ends.alias("e")), lambda t: (t["s"] < b) & (t["e"] > a))
    return F.try_divide(F.aggregate(zipped, F.lit(0.0), lambda x, t: x + t["p"]), F.size(zipped).cast("double"))


def call_probability(alternatives: Column, token: int) -> Column:
    """(p, bounded) of the call token among (id, lp) alternatives; if it isn't there, the smallest is an upper bound."""
    own = F.filter(alternatives, lambda x: x["id"] == token)
    there = F.size(own) > 0
    lowest = F.array_min(F.transform(alternatives, lambda x: x["lp"]))
    return F.when(F.size(alternatives) > 0, F.struct(F.exp(F.when(there, own[0]["lp"]).otherwise(lowest)).alias("p"), (~there).alias("bounded")))


def as_long(values: Column, other: Column, said: str) -> Column:
    """`values`, refused if the other array isn't as long."""
    return F.when(F.size(values) == F.size(other), values).otherwise(F.raise_error(F.concat_ws(" ", F.lit(said), F.size(values).cast("string"), F.size(other).cast("string"))).cast("array<int>"))


def emitted_logprobs(ids: Column, tables: Column) -> Column:
    """The log-probability of each emitted token, looked up by its id in the position's table; unequal lengths are an error."""
    zipped = F.arrays_zip(as_long(ids, tables, "unequal numbers of tokens and tables:").alias("i"), tables.alias("t"))
    return F.transform(zipped, lambda x: F.try_element_at(x["t"], x["i"]))


def step_confidence(kind: Column, called: Column, spans: Column, logprobs: Column, starts: Column, ends: Column, alternatives: Column, call_token: int) -> Column:
    """The confidence of a generated turn: (kind, name_confidence, name_tokens, p_call, bounded, step_confidence).

    kind and called are the completion's as parsed, spans (name, start, end) where its names stand, tokens have a
    log-probability, a start and an end, alternatives are the (id, lp) at the first place, null or empty if they
    weren't recorded. A call is as sure as its least sure name and as the call itself; a reply is as sure as no
    call. What didn't parse, names that don't stand where they were parsed and names without a token are unparsed.
    """
    tokens = F.arrays_zip(logprobs.alias("p"), starts.alias("s"), ends.alias("e"))
    over = lambda span: F.filter(tokens, lambda t: (t["s"] < span["end"]) & (t["e"] > span["start"]))
    mean = lambda span: F.try_divide(F.aggregate(over(span), F.lit(0.0), lambda x, t: x + t["p"]), F.size(over(span)).cast("double"))
    means = F.transform(spans, mean)
    there = (F.size(spans) > 0) & (F.transform(spans, lambda s: s["name"]) == called) & ~F.exists(means, lambda m: m.isNull())
    sure = F.when((kind == "reply") | ((kind == "tool_call") & there), kind).otherwise("unparsed")
    parsed = sure != "unparsed"
    call = call_probability(alternatives, call_token)
    names = F.when(sure == "tool_call", F.exp(F.array_min(means)))
    counted = F.when(sure == "tool_call", F.aggregate(F.transform(spans, lambda s: F.size(over(s))), F.lit(0), lambda x, n: x + n)).otherwise(0)
    p = F.when(parsed, call["p"])
    step = F.when(sure == "reply", 1 - p).when((sure == "tool_call") & p.isNotNull(), F.least(p, names))
    return F.struct(sure.alias("kind"), names.alias("name_confidence"), counted.alias("name_tokens"), p.alias("p_call"), F.coalesce(parsed & call["bounded"], F.lit(False)).alias("bounded"), step.alias("step_confidence"))


RESPONSE = "struct<choices:array<struct<text:string,logprobs:struct<tokens:array<string>,token_logprobs:array<double>,top_logprobs:array<map<string,double>>>>>>"


def response_scores(body: Column) -> Column:
    """(text, token_ids, token_logprobs, first) of a served response; another number of choices or unequal lengths are an error."""
    choices = F.from_json(body, RESPONSE)["choices"]
    said = F.concat(F.lit("one completion expected, not "), F.coalesce(F.size(choices), F.lit(0)).cast("string"))
    choice = F.when(F.size(choices) == 1, choices[0]).otherwise(F.raise_error(said).cast(RESPONSE[len("struct<choices:array<") : -2]))
    scored = choice["logprobs"]
    none = F.array().cast("array<string>")
    tokens, values = F.coalesce(scored["tokens"], none), F.coalesce(scored["token_logprobs"], F.array().cast("array<double>"))
    ids = F.transform(tokens, token_number)
    first = F.transform(F.map_entries(F.coalesce(F.get(scored["top_logprobs"], 0), F.create_map().cast("map<string,double>"))), lambda e: F.struct(token_number(e["key"]).alias("id"), e["value"].alias("lp")))
    return F.struct(F.coalesce(choice["text"], F.lit("")).alias("text"), as_long(ids, values, "unequal numbers of tokens and log-probabilities:").alias("token_ids"), values.alias("token_logprobs"), first.alias("first"))


def measured(scored: DataFrame, confidences: DataFrame, key: str) -> DataFrame:
    """Scored steps that have a confidence; those without are left out silently, as a run may measure a part only."""
    return scored.join(confidences, key)


def routed(threshold: float, present: Column, confidence: Column, completion: Column) -> Column:
    """What is kept of a routed turn, escalated or not, so that the decision can be checked afterwards."""
    reason = route(present, confidence, threshold)
    return F.struct((reason != "confident").alias("escalated"), reason.alias("route_reason"), F.lit(threshold).alias("threshold"), confidence.alias("step_confidence"), completion.alias("student_completion"))


def best_alternatives(alternatives: Column, k: int) -> Column:
    """The k most probable of (id, lp), ties by id."""
    turned = F.array_sort(F.transform(alternatives, lambda x: F.struct((-x["lp"]).alias("n"), x["id"].alias("id"))))
    return F.transform(F.slice(turned, 1, k), lambda x: F.struct(x["id"].alias("id"), (-x["n"]).alias("lp")))
