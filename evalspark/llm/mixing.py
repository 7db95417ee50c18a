"""Mixtures of sources by target weights, in tokens, with capped repeats.

Every source present gets the share its weight gives it among the sources present; the total is the largest
that no cap forbids, or a smaller one that is asked for. Inside a source each document has an expected number
of copies, lambda times its odds weight, at most the source's cap; lambda is solved so that the expected tokens
are the source's share. The whole part of the expected copies is certain. For the fraction the documents are
ranked by Pareto order sampling (Rosen 1997): U/(1-U) over p/(1-p) with U uniform from the document's id; they
are taken in that order until the source's tokens are full; the document that crosses the border is taken if
more than half of it fits.

The order is never sorted in one task: ranks fall into a fixed number of buckets, the buckets' token sums tell
which are taken whole, and only the bucket the border falls in is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.joins import on_groups
from evalspark.functions.text import label
from evalspark.llm.encode import NAME, VOCABULARIES, count_tokens
from evalspark.shared import written

BUCKETS = 4096
MAX_COPIES_CLASS = 40  # odds weights are powers of two from 2^0 to 2^-40


def sized_documents(documents: DataFrame, folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """(doc_id, source, n_tokens, odds) of the documents with a source and at least one token, as a written table.

    odds is the weight of a document when copies are dealt: 1, halved for every doubling of the number of
    documents of its source with the same text, so that a text isn't taken more often for having been stored
    more often.
    """
    named = documents.select("doc_id", label(F.col("source")).alias("source"), "text").where("source is not null and text <> ''")
    print_ = F.unhex(F.md5("text"))
    sized = count_tokens(named.withColumn("print", print_), "doc_id, source, print", folder=folder, name=name).where("n_tokens > 0")
    sized = written(sized, "mix-sizes")
    times = sized.groupBy("source", "print").agg(F.count("*").alias("times")).where("times > 1")
    # Null-safe keys need exchanges of their own, so a text that is stored millions of times is split over tasks.
    kept = on_groups(sized, times, ["source", "print"], "left")
    halvings = F.least(F.lit(MAX_COPIES_CLASS), F.floor(F.log2(F.coalesce(F.col("times"), F.lit(1)))).cast("int"))
    return kept.select("doc_id", "source", "n_tokens", F.pow(F.lit(2.0), -halvings).alias("odds"))


def solve(classes: list[tuple[float, int]], cap: int, target: float) -> float:
    """lambda with sum(min(cap, lambda * odds) * tokens) = target over (odds, tokens); the cap binds from the top."""
    capped, left = 0.0, sorted(classes, reverse=True)
    while left:
        scale = sum(odds * tokens for odds, tokens in left)
        found = (target - capped) / scale
        if found * left[0][0] <= cap:
            return max(0.0, found)
        capped += cap * left[0][1]
        left = left[1:]
    return cap / min(odds for odds, _ in classes) if classes else 0.0


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[tuple[str, float, int, float, float]]:
    """(source, share, cap, tokens to give, lambda) of each source that is present, and of no other.

    Reads one row for each (source, odds class): at most the targets' sources times 41 rows.
    """
    wanted = targets.select(label(F.col("source")).alias("source"), "weight", "max_repeats").where("source is not null and weight > 0 and max_repeats > 0")
    wanted = wanted.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    found = sized.join(F.broadcast(wanted), "source").groupBy("source", "odds").agg(F.first("weight").alias("weight"), F.first("max_repeats").alias("cap"), F.sum("n_tokens").alias("tokens")).collect()
    by: dict[str, tuple[float, int, list]] = {}
    for row in found:
        by.setdefault(row.source, (row.weight, row.cap, []))[2].append((row.odds, row.tokens))
    if not by:
        return []
    whole = sum(weight for weight, _, _ in by.values())
    most = min(cap * sum(t for _, t in classes) * whole / weight for weight, cap, classes in by.values())
    total = most if total_tokens is None else min(most, total_tokens)
    return [(source, weight / whole, cap, total * weight / whole, solve(classes, cap, total * weight / whole)) for source, (weight, cap, classes) in sorted(by.items())]


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**53))


def mix(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents taken, copies from 1 to the source's cap.

    Documents without text, of a null source or of a source without a target aren't taken; sources without
    documents give nothing and their weight is left out. Each source misses its tokens by at most half of
    one document's. Ties in rank go by doc_id. Empty tables give no rows.
    """
    spark = sized.sparkSession
    steps = plan(sized, targets, total_tokens)
    schema = "source string, share double, cap int, give double, lambda double"
    steps_df = F.broadcast(spark.createDataFrame(steps, schema))
    expected = F.least(F.col("cap").cast("double"), F.col("lambda") * F.col("odds"))
    sure = F.least(F.col("cap"), F.floor(expected + F.lit(1e-12)).cast("int"))
    part = F.greatest(F.lit(0.0), expected - sure)
    dealt = sized.join(steps_df, "source").withColumn("sure", sure).withColumn("part", part)
    u = uniform(F.col("doc_id"), seed)
    order = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    dealt = dealt.withColumn("rank", F.when(F.col("part") > 1e-12, order / (1 + order)))
    dealt = dealt.withColumn("bucket", F.when(F.col("rank").isNotNull(), F.least(F.lit(BUCKETS - 1), F.floor(F.col("rank") * BUCKETS).cast("int"))))
    dealt = written(dealt, "mix-dealt")

    sums = dealt.groupBy("source", "bucket").agg(F.sum(F.col("sure") * F.col("n_tokens")).alias("sure_tokens"), F.sum(F.when(F.col("rank").isNotNull(), F.col("n_tokens"))).alias("tokens"), F.first("give").alias("give"))
    by_rank = Window.partitionBy("source").orderBy(F.col("bucket").asc_nulls_first())
    sums = sums.withColumn("left", F.col("give") - F.sum("sure_tokens").over(Window.partitionBy("source")))
    sums = sums.where("bucket is not null").withColumn("above", F.sum("tokens").over(by_rank))
    # At most BUCKETS rows a source: a bound that doesn't depend on the corpus.
    border = sums.select("source", "bucket", "left", (F.col("above") - F.col("tokens")).alias("below"), (F.col("above") <= F.col("left") + F.lit(1e-6)).alias("whole"))
    marked = dealt.join(F.broadcast(border), ["source", "bucket"], "left")
    straddles = (~F.col("whole")) & (F.col("below") < F.col("left"))
    inside = marked.where(straddles).withColumn("run", F.col("below") + F.sum("n_tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id")))
    inside = inside.select("doc_id", "source", "n_tokens", "sure", (F.col("run") - F.col("n_tokens") / 2 <= F.col("left") + F.lit(1e-6)).cast("int").alias("extra"))
    outside = marked.where(F.coalesce(~straddles, F.lit(True))).select("doc_id", "source", "n_tokens", "sure", F.coalesce(F.col("whole"), F.lit(False)).cast("int").alias("extra"))
    taken = outside.unionByName(inside)
    return taken.select("doc_id", "source", "n_tokens", (F.col("sure") + F.col("extra")).alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target source: what it should and does give. Sources without documents have an actual share of 0."""
    wanted = targets.select(label(F.col("source")).alias("source"), "weight", "max_repeats").where("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    given = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    joined = wanted.join(given, "source", "left").na.fill(0, ["n_docs", "n_copies", "most_copies", "tokens"])
    everything = Window.partitionBy(F.lit(1))
    present = F.when(F.col("tokens") > 0, F.col("weight"))
    return joined.select(
        "source", "weight", "max_repeats", "n_docs", "n_copies", "most_copies", "tokens",
        (present / F.sum(present).over(everything)).alias("target_share"),
        (F.col("tokens") / F.sum("tokens").over(everything)).alias("actual_share"),
    )
