"""Preference pairs: verdicts, drop rules, first-wins duplicates, balance and review order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.joins import on_groups
from evalspark.operators.catalogs import READ_ONLY
from evalspark.operators.sampling import hash_place
from evalspark.operators.scoring import BUCKETS, OUTSIDE

IM_END = "<|im_end|>"
# A fixed pattern: a reply that speaks of the customer in the third person, but not of "the user id" or "the user account".
REASONING = r"(?iU)\bthe user(?:['’]s)?\b(?!\s*(?:id|account)\b)"


def teacher_reasoning(text: Column) -> Column:
    return F.coalesce(text.rlike(REASONING), F.lit(False))


def as_target(text: Column) -> Column:
    """A completion up to its first end mark, with the mark."""
    return F.concat(F.substring_index(text, IM_END, 1), F.lit(IM_END))


def same_outcome(predicted: Column, reference: Column) -> Column:
    """Whether two arrays of calls (name, key) do the same: the same changes in the same order, and the same things read.

    The rule for logs without an environment to replay in; `canon.same_effect` takes one that there is.
    """
    changes = lambda calls: F.transform(F.filter(calls, lambda c: ~c["name"].rlike(READ_ONLY)), lambda c: c["key"])
    reads = lambda calls: F.array_sort(F.array_distinct(F.transform(F.filter(calls, lambda c: c["name"].rlike(READ_ONLY)), lambda c: c["key"])))
    return F.coalesce((F.size(predicted) > 0) & (F.size(reference) > 0) & (changes(predicted) == changes(reference)) & (reads(predicted) == reads(reference)), F.lit(False))


def ordering_only(predicted_calls: Column, later_keys: Column) -> Column:
    """Whether every predicted call only reads and is made later anyway; calls have name and key (name and normal arguments)."""
    return F.coalesce((F.size(predicted_calls) > 0) & F.forall(predicted_calls, lambda c: c["name"].rlike(READ_ONLY) & F.array_contains(later_keys, c["key"])), F.lit(False))


def verdict(bucket: Column, equivalent: Column, cut_off: Column, reasoning: Column, ordering: Column) -> Column:
    """What a completion amounts to: agreement, the same effect, or a pair unless a drop rule applies, in this order."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(bucket.isNull(), "agree").when(yes(equivalent), "equivalent").when(yes(cut_off), "teacher_cut_off").when(yes(reasoning), "teacher_reasoning").when(yes(ordering), "ordering_only").otherwise("pair")


def first_pairs(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """`rows` with duplicate: false for the first row of each key by `order`, true for later ones.

    The key's first order is an aggregate joined back; a key that fills a third of the rows is no one task's window.
    """
    first = rows.groupBy(*key).agg(F.min(order).alias("_first"))
    return on_groups(rows, first, key).select(*rows.columns, (F.col(order) != F.col("_first")).alias("duplicate"))


def pair_report(judged: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, n_pairs, call_disagreements, equivalent_share, pairs_<bucket>) of rows with outcome, bucket and both kinds.

    A call disagreement is a call where a call was due that isn't the same one; the share is of those that had the
    same effect nevertheless, at 4 places, null without any.
    """
    calls = (F.col("reference_kind") == "tool_call") & F.coalesce(F.col("predicted_kind") == "tool_call", F.lit(False)) & (F.col("outcome") != "agree")
    pair = F.col("outcome") == "pair"
    agg = judged.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(pair).alias("n_pairs"), F.count_if(calls).alias("call_disagreements"), F.count_if(F.col("outcome") == "equivalent").alias("_same"),
        *(F.count_if(pair & (F.col("bucket") == b)).alias(f"pairs_{b}") for b in BUCKETS + OUTSIDE),
    )
    share = F.round(F.try_divide(F.col("_same").cast("double"), F.col("call_disagreements").cast("double")), 4)
    return agg.withColumn("equivalent_share", share).drop("_same")


def outcome_counts(judged: DataFrame, by: list[str]) -> DataFrame:
    """(by, outcome, n)."""
    return judged.groupBy(*by, "outcome").agg(F.count("*").alias("n"))


def balanced(rows: DataFrame, group: str, one: object, two: object, key: str, seed: int = 0) -> DataFrame:
    """The rows with the larger of two groups cut down to the smaller in hash order; other groups untouched.

    The hash places of each group are counted into 4096 buckets; only the bucket in which the border falls is ordered.
    """
    sizes = rows.agg(F.count_if(F.col(group) == one).alias("a"), F.count_if(F.col(group) == two).alias("b"))
    placed = rows.withColumn("_place", hash_place(F.col(key), seed)).withColumn("_bucket", F.substring("_place", 1, 3))
    counts = placed.where(F.col(group).isin(one, two)).groupBy(group, "_bucket").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(group).orderBy("_bucket"))
    counts = counts.join(F.broadcast(sizes)).select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), (upto - F.col("_m")).alias("_below"), F.least("a", "b").alias("_keep"), upto.alias("_upto"))
    joined = placed.join(F.broadcast(counts), (placed[group] == counts["_g"]) & (placed["_bucket"] == counts["_b"]), "left")
    straddles = (F.col("_below") < F.col("_keep")) & (F.col("_upto") > F.col("_keep"))
    whole = joined.where(F.col("_g").isNull() | (F.col("_upto") <= F.col("_keep")))
    part = joined.where(straddles).withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_place", key)))
    part = part.where(F.col("_below") + F.col("_rank") <= F.col("_keep"))
    return whole.select(rows.columns).unionByName(part.select(rows.columns))


def round_robin(rows: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows for review, one of each group in turn, larger groups first, in hash order inside a group.

    A row's turn is its rank in its group; no group needs more than its first n, which a running top-n gives
    before anything is ordered.
    """
    placed = rows.withColumn("_place", hash_place(F.col(key), seed))
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    turn = F.row_number().over(Window.partitionBy(group).orderBy("_place", key))
    turned = placed.withColumn("turn", turn).where(F.col("turn") <= n)  # Spark's group limit keeps n rows a task before the exchange
    picked = on_groups(turned, sizes, [group]).orderBy("turn", F.col("_size").desc(), group).limit(n)
    return picked.select(*rows.columns, "turn")
