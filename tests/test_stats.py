"""Hand-computed statistics."""

import math

import pytest

from evalspark.operators import compare, escalation, invariants, latency, pairs, reward, sampling, scoring, stats


def rows(df, *by):
    return sorted(map(tuple, df.select(*by).collect() if by else df.collect()), key=str)


def trials(spark, outcomes):
    data = [("g", task, i, ok) for task, oks in outcomes.items() for i, ok in enumerate(oks)]
    return stats.success_table(spark.createDataFrame(data, "g string, task string, seed int, ok boolean"), ["g"], "task", "seed", "ok", 3).first()


def test_pass_hat_k(spark):
    row = trials(spark, {"a": [True, True, False], "b": [True, False, False]})
    assert (row.pass_1, round(row.pass_2, 6), row.pass_3, row.complete) == (0.5, round(1 / 6, 6), 0.0, True)


def test_tiny_grid(spark):
    row = trials(spark, {"a": [True, True], "b": [True, False]})
    assert (row.pass_2, row.solved_any, row.solved_every, row.mean, row.pass_3) == (0.5, 2, 1, 0.75, None)


def test_unequal_trials_give_counts_only(spark):
    row = trials(spark, {"a": [True, True], "b": [True]})
    assert not row.complete and row.mean is None and row.pass_1 is None and row.n_successes == 3


def test_pass_ratio_is_the_quotient_of_combinations(spark):
    df = spark.createDataFrame([(c,) for c in range(6)], "c int")
    for k in range(1, 6):
        found = [r[0] for r in df.select(stats.pass_ratio(df.c, df.c * 0 + 5, k)).collect()]
        assert found == pytest.approx([math.comb(c, k) / math.comb(5, k) for c in range(6)])


def test_t_interval(spark):
    df = spark.createDataFrame([(1, v) for v in (0.4, 0.5, 0.6)] + [(2, 0.5), (3, None)], "g int, v double")
    found = {r.g: r for r in stats.mean_ci(df, ["g"], "v").collect()}
    assert round(found[1].ci95_low, 4) == 0.2516 and round(found[1].ci95_high, 4) == 0.7484
    assert found[2].ci95_low is None and found[3].n == 0


def test_null_groups_stay(spark):
    df = spark.createDataFrame([(None, "a", 0, True), (None, "a", 1, True)], "g string, task string, seed int, ok boolean")
    assert stats.success_table(df, ["g"], "task", "seed", "ok").first().n_tasks == 1


def test_file_cells(spark):
    names = ["free-small-sft-esc0.70-c80.jsonl", "free-x-c16.jsonl", "forced-c16.jsonl"]
    df = spark.createDataFrame([(n,) for n in names], "f string").select("f", stats.cell_of_file(__import__("pyspark.sql.functions", fromlist=["col"]).col("f")).alias("c"))
    found = {r.f: r.c and tuple(r.c) for r in df.collect()}
    assert list(found.values()) == [("small-sft", 0.7, 80), ("x", None, 16), None]


def test_two_nearest_ranks(spark):
    values = list(range(1, 11))
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    even = stats.nearest_rank(df, ["g"], "v", {"p25": 25, "p50": 50, "p95": 95}).first()
    assert (even.p25, even.p50, even.p95) == tuple(float(sorted(values)[max(1, round(q * 10)) - 1]) for q in (0.25, 0.5, 0.95))
    up = latency.levels(df.selectExpr("g", "v", "v < 10 as ok"), ["g"], "v", "ok").first()
    assert (up.requests, up.errors, up.p50, up.p99) == (10, 1, 5.0, 9.0)


def test_length_summary_on_no_rows(spark):
    df = spark.createDataFrame([], "g string, v int")
    assert stats.length_summary(df, ["g"], "v").count() == 0


SIGNALS = "signal double, right boolean, g int"


@pytest.mark.parametrize("signals, wrong, expected", [([0.1, 0.2, 0.9, 0.95], 2, 1.0), ([0.5, 0.5], 1, 0.5), ([0.5, 0.6], 0, None)])
def test_auroc(spark, signals, wrong, expected):
    df = spark.createDataFrame([(s, i >= wrong, 1) for i, s in enumerate(signals)] + [(None, True, 1)], SIGNALS)
    assert escalation.auroc(df, ["g"]).first().auroc == expected


def test_auroc_equals_all_pairs(spark):
    import random

    r = random.Random(3)
    data = [(r.randint(0, 5) / 5, r.random() < 0.6, 1) for _ in range(200)]
    good, bad = ([s for s, ok, _ in data if ok is which] for which in (True, False))
    expected = sum((b < g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))
    assert escalation.auroc(spark.createDataFrame(data, SIGNALS), ["g"]).first().auroc == pytest.approx(expected)


def test_sweep(spark):
    data = [(0.4, False, 1), (0.6, False, 1), (0.9, True, 1), (None, False, 1)]
    found = {r.threshold: r for r in escalation.sweep(spark.createDataFrame(data, SIGNALS), [0.5, 0.7], ["g"]).collect()}
    assert (found[0.7].escalation_rate, found[0.7].accuracy_after, found[0.7].wasted_escalations) == (0.75, 1.0, 0.0)
    assert found[0.5].mistakes_caught == pytest.approx(2 / 3) and found[0.5].accuracy_before == 0.25


def test_routes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(True, 0.2), (True, 0.7), (True, None), (False, None)], "there boolean, s double")
    assert [r[0] for r in df.select(escalation.route(F.col("there"), F.col("s"), 0.7)).collect()] == ["low_confidence", "confident", "unmeasured", "overflow"]
    with pytest.raises(ValueError):
        escalation.route(F.col("there"), F.col("s"), 1.5)


def test_alternatives(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([(7, -0.1), (8, -2.0)],), ([],)], "a array<struct<id:int,lp:double>>")
    known = [r[0] for r in df.select(escalation.call_probability(F.col("a"), 7)).collect()]
    assert known[0].p == pytest.approx(math.exp(-0.1)) and not known[0].bounded and known[1] is None
    bound = df.select(escalation.call_probability(F.col("a"), 9)).first()[0]
    assert bound.p == pytest.approx(math.exp(-2.0)) and bound.bounded


def scored_row(i, hit):
    return (1 + i // 2, 0, i, "tool_call" if i % 2 else "reply", "reply", hit, False, False, False, None)


SCORED = "task int, rep int, step int, reference_kind string, predicted_kind string, kind_match boolean, name_match boolean, normalized_match boolean, hallucinated_tool boolean, bucket string"


def test_paired_bootstrap(spark):
    base = spark.createDataFrame([scored_row(i, False) for i in range(80)], SCORED)
    better = spark.createDataFrame([scored_row(i, i % 4 == 0) for i in range(80)], SCORED)
    sums = compare.episode_sums(base, better, ["task", "rep"], "step")
    found = {r.rate: r for r in compare.paired_bootstrap(sums, ["task", "rep"], 300).collect()}
    reply = found["reply_as_reply"]
    assert reply.delta == 0.5 and reply.ci95_low < 0.5 < reply.ci95_high
    same = compare.paired_bootstrap(compare.episode_sums(base, base, ["task", "rep"], "step"), ["task", "rep"], 50).collect()
    assert all((r.delta, r.ci95_low, r.ci95_high) == (0.0, 0.0, 0.0) for r in same)
    assert found == {r.rate: r for r in compare.paired_bootstrap(sums, ["task", "rep"], 300).collect()}


def test_paired_bootstrap_query_draws_2000_times(spark, monkeypatch):
    from evalspark.plans import conversations

    base = spark.createDataFrame([scored_row(i, i % 3 == 0) for i in range(80)], SCORED).withColumnRenamed("step", "eval_id")
    new = spark.createDataFrame([scored_row(i, i % 7 < 3) for i in range(80)], SCORED).withColumnRenamed("step", "eval_id")
    monkeypatch.setattr(conversations, "scored_steps", lambda spark, sf_dir, which: base if which == "first" else new)
    sums = compare.episode_sums(base, new, ["task", "rep"], "eval_id")
    ends = lambda rows: {r.rate: (round(r.ci95_low, 6), round(r.ci95_high, 6)) for r in rows}
    drawn = {n: ends(compare.paired_bootstrap(sums, ["task", "rep"], n).collect()) for n in (200, 2000)}
    assert ends(conversations.paired_bootstrap(spark, "").collect()) == drawn[2000] != drawn[200]


def test_pairing_refuses(spark):
    a, b = (spark.createDataFrame([(t,) for t in x], "task int") for x in ([1, 2, 3], [2, 3, 4, 5]))
    assert tuple(compare.pairing(a, b, ["task"]).first()) == (2, 1, 2)
    with pytest.raises(invariants.InvariantViolation):
        invariants.require(invariants.leaked(a, b, "task"), "splits are disjoint")
    with pytest.raises(Exception, match="no partner"):
        invariants.complete_join(a, b, ["task"]).collect()


def test_samples(spark):
    df = spark.createDataFrame([(i,) for i in range(46)], "k int")
    sizes = {f: {r.k for r in sampling.nested_subset(df.repartition(3), "k", f, 1).collect()} for f in (0.25, 0.5, 1.0)}
    assert [len(s) for s in sizes.values()] == [12, 23, 46] and sizes[0.25] < sizes[0.5] < sizes[1.0]
    dealt = sampling.deal(df, "k", [5, 7], 2).collect()
    assert sorted(r.block for r in dealt) == [0] * 5 + [1] * 7
    assert len({r.k for r in dealt}) == 12
    assert [r.k for r in sampling.strided(df, "k", 10).orderBy("k").collect()] == list(range(0, 40, 4))
    assert [r.k for r in sampling.evenly(df, "k", 7).orderBy("k").collect()] == [int(i * 46 / 7) for i in range(7)]
    assert sampling.permuted(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        sampling.nested_subset(df, "k", 0.0)


def test_balance_and_duplicates(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b" if i % 2 else None) for i in range(60)], "k int, g string")
    kept = [r.g for r in pairs.balanced(df, "g", "a", "b", "k").collect()]
    assert kept.count("a") == kept.count("b") == 10 and kept.count(None) == 10
    rows_ = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "x", "y")], "k int, a string, b string")
    assert {r.k: r.duplicate for r in pairs.first_pairs(rows_, ["a", "b"], "k").collect()} == {1: False, 2: True, 3: False}


def test_reward_ladder(spark):
    from pyspark.sql import functions as F

    cases = [(True, True, True, True, 1.0), (True, False, True, True, 1.0), (True, True, True, False, 0.4), (True, False, True, False, 0.2), (True, True, False, None, 0.3), (False, False, None, None, 0.0)]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "e boolean, n boolean, s boolean, x boolean, want double, i int")
    found = df.select("want", reward.step_reward(F.lit("tool_call"), F.lit("tool_call"), F.col("e"), F.col("n"), F.col("s"), F.col("x")).alias("got")).collect()
    assert all(r.want == pytest.approx(r.got) for r in found)


def test_advantages(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 0.5), (2, 0.5), (None, 1.0), (None, 3.0)], "g int, r double")
    found = [r.advantage for r in reward.group_advantages(df, ["g"], "r").orderBy("g", "r").collect()]
    assert found == pytest.approx([-1 / 1.0001, 1 / 1.0001, -0.5 / 0.5001, 0.5 / 0.5001, None, None], nan_ok=True) if None not in found else found.count(None) == 2


TAXONOMY = [
    ("tool_call", "tool_call", True, True, False, ["a"], ["a"], None),
    ("tool_call", "tool_call", False, False, True, ["get_user"], ["fly"], "hallucinated_tool"),
    ("tool_call", "tool_call", False, False, False, ["get_order_details"], ["cancel_order"], "wrong_tool_neighbor"),
    ("tool_call", "tool_call", False, False, False, ["find_user_by_id"], ["list_items_by_id"], "wrong_tool_unrelated"),
    ("tool_call", "tool_call", False, True, False, ["a"], ["a"], "right_tool_wrong_args"),
    ("tool_call", "reply", False, False, False, ["a"], [], "premature_termination"),
    ("tool_call", None, False, False, False, ["a"], [], "malformed_output"),
    ("reply", "tool_call", False, False, False, [], ["a"], "call_instead_of_reply"),
    ("reply", None, False, False, False, [], [], "malformed_output"),
]


def test_one_completion_a_bucket(spark):
    data = [(i, "g", *row[:2], row[0] == row[1], *row[2:5], row[5], row[6], row[7]) for i, row in enumerate(TAXONOMY)]
    schema = "i int, g string, reference_kind string, predicted_kind string, kind_match boolean, normalized_match boolean, name_match boolean, hallucinated_tool boolean, reference_tools array<string>, predicted_tools array<string>, want string"
    df = spark.createDataFrame(data, schema).withColumn("bucket", scoring.bucket())
    assert [r.bucket for r in df.orderBy("i").collect()] == [r[-1] for r in TAXONOMY]
    table = {r.bucket: (r.n, r.share) for r in scoring.bucket_table(df, ["g"]).collect()}
    assert table["malformed_output"] == (2, None) and table["hallucinated_tool"] == (1, 1 / 7) and len(table) == 7


def test_gate_and_base(spark):
    rates = spark.createDataFrame([(16, "z", 0.1), (16, "s", 0.26), (40, "s", 0.5), (80, "z", 0.4), (80, "s", 0.5)], "c int, label string, rate double")
    assert {r.c: r.verdict for r in compare.gate(rates, ["c"], "z", "s").collect()} == {16: "pass", 40: "incomplete", 80: "fail"}
    assert {r.c: r.base for r in compare.base_of(rates, "z", "s", ["c"]).collect()} == {16: "z", 40: "s", 80: "z"}


def test_running_totals(spark):
    import random

    from evalspark.functions.running import running_totals

    r = random.Random(2)
    data = [(g, v, r.randint(1, 5)) for g in (None, 1) for v in r.sample(range(-10**6, 10**6), 300)] + [(2, 7, 3)]
    found = running_totals(spark.createDataFrame(data, "g int, v bigint, w int"), ["g"], "v", ["w"]).collect()
    assert len(found) == len(data)
    assert all(row.w_upto == sum(w for g, v, w in data if g == row.g and v <= row.v) for row in found)
