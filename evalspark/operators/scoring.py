"""Scores of predicted actions against reference actions, and what went wrong where they differ.

An action has a kind (tool_call, reply or null for a completion that didn't parse) and an array of calls
(name, strict, normal), the last two canonical texts of the arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.catalogs import CONNECTORS, name_words

CALL, REPLY = "tool_call", "reply"
# Fixed names, in the order of the report: five ways a call can be wrong, and two that lie outside.
BUCKETS = ["hallucinated_tool", "wrong_tool_neighbor", "wrong_tool_unrelated", "right_tool_wrong_args", "premature_termination"]
OUTSIDE = ["malformed_output", "call_instead_of_reply"]


def names_of(calls: Column) -> Column:
    return F.coalesce(F.transform(calls, lambda c: c["name"]), F.array().cast("array<string>"))


def score(df: DataFrame, catalog: list[str]) -> DataFrame:
    """`df` with the score of each row's predicted action; columns reference_kind, reference_calls, predicted_kind, predicted_calls.

    A prediction that didn't parse agrees with nothing and has no hallucinated tool.
    """
    kind, predicted = F.col("reference_kind"), F.col("predicted_kind")
    ref, pred = names_of(F.col("reference_calls")), names_of(F.col("predicted_calls"))
    both = F.coalesce((kind == CALL) & (predicted == CALL), F.lit(False))
    same = lambda field: F.transform("reference_calls", lambda c: F.struct(c["name"], c[field])) == F.transform("predicted_calls", lambda c: F.struct(c["name"], c[field]))
    agree = lambda condition: both & F.coalesce(condition, F.lit(False))
    known = F.array(*map(F.lit, catalog))
    return df.select(
        "*", F.coalesce(predicted == kind, F.lit(False)).alias("kind_match"), agree(ref == pred).alias("name_match"),
        agree(same("normal")).alias("normalized_match"), agree(same("strict")).alias("strict_match"),
        (F.coalesce(predicted == CALL, F.lit(False)) & F.exists(pred, lambda n: F.coalesce(~F.array_contains(known, n), F.lit(True)))).alias("hallucinated_tool"),
        ref.alias("reference_tools"), F.when(predicted.isNotNull(), pred).otherwise(F.array().cast("array<string>")).alias("predicted_tools"),
    )


RATES = {
    "step_agreement": (lambda: F.col("reference_kind") == CALL, "normalized_match"),
    "step_agreement_strict": (lambda: F.col("reference_kind") == CALL, "strict_match"),
    "tool_name_accuracy": (lambda: F.col("reference_kind") == CALL, "name_match"),
    "decision_type_accuracy": (lambda: F.lit(True), "kind_match"),
    "reply_step_decision_accuracy": (lambda: F.col("reference_kind") == REPLY, "kind_match"),
    "hallucinated_tool_rate": (lambda: F.col("predicted_kind") == CALL, "hallucinated_tool"),
}


def summarize(scored: DataFrame, by: list[str]) -> DataFrame:
    """The headline rates of each group in one pass; a rate without rows is null."""
    of = lambda rows, hit: F.try_divide(F.count_if(rows & hit).cast("double"), F.count_if(rows).cast("double"))
    rates = [of(rows(), F.col(hit)).alias(name) for name, (rows, hit) in RATES.items()]
    unparsed = F.try_divide(F.count_if(F.col("predicted_kind").isNull()).cast("double"), F.count("*").cast("double")).alias("parse_error_rate")
    return scored.groupBy(*by).agg(F.count("*").alias("n_steps"), F.count_if(F.col("reference_kind") == CALL).alias("n_tool_call_steps"), F.count_if(F.col("reference_kind") == REPLY).alias("n_reply_steps"), *rates, unparsed)


def macro_micro(scored: DataFrame, by: list[str], episode: list[str]) -> DataFrame:
    """Agreement over steps, and the mean over episodes of each episode's own; episodes without call steps have none."""
    hit = F.count_if((F.col("reference_kind") == CALL) & F.col("normalized_match")).alias("hits")
    per = scored.groupBy(*by, *episode).agg(F.count_if(F.col("reference_kind") == CALL).alias("calls"), hit)
    ratio = F.try_divide(F.col("hits").cast("double"), F.col("calls").cast("double"))
    return per.groupBy(*by).agg(F.try_divide(F.sum("hits").cast("double"), F.sum("calls").cast("double")).alias("micro"), F.avg(ratio).alias("macro"), F.count(ratio).alias("n_episodes"))


def neighbours(a: Column, b: Column) -> Column:
    """Whether two tool names share a word that isn't a connector."""
    shared = F.array_except(F.array_intersect(name_words(a), name_words(b)), F.array(*map(F.lit, CONNECTORS)))
    return F.size(shared) > 0


def bucket() -> Column:
    """What went wrong in a scored step; null where nothing did."""
    unparsed = F.col("predicted_kind").isNull()
    near = F.exists("predicted_tools", lambda p: F.exists("reference_tools", lambda r: neighbours(p, r)))
    of_reply = F.when(F.col("kind_match"), F.lit(None)).when(unparsed, "malformed_output").otherwise("call_instead_of_reply")
    of_call = (
        F.when(F.col("normalized_match"), F.lit(None)).when(unparsed, "malformed_output")
        .when(F.col("predicted_kind") == REPLY, "premature_termination").when(F.col("hallucinated_tool"), "hallucinated_tool")
        .when(F.col("name_match"), "right_tool_wrong_args").when(near, "wrong_tool_neighbor").otherwise("wrong_tool_unrelated")
    )
    return F.when(F.col("reference_kind") == REPLY, of_reply).otherwise(of_call)


def bucket_table(classified: DataFrame, by: list[str], column: str = "bucket") -> DataFrame:
    """(by, bucket, n, share) for all buckets, those without steps too; share is of the wrong call steps, null outside."""
    counts = [F.count_if(F.col(column) == b).alias(b) for b in BUCKETS + OUTSIDE]
    agg = classified.groupBy(*by).agg(*counts)
    wrong = sum((F.col(b) for b in BUCKETS), F.col("malformed_output"))
    rows = F.array(*(F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n"), (F.try_divide(F.col(b).cast("double"), wrong.cast("double")) if b in BUCKETS else F.lit(None).cast("double")).alias("share")) for b in BUCKETS + OUTSIDE))
    return agg.select(*by, F.inline(rows))
