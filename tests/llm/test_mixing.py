"""Mixtures: shares, caps, determinism, and inclusion in proportion to the odds."""

import pytest

mixing = pytest.importorskip("evalspark.llm.mixing")


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, odds double")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, weight double, max_repeats int")


def test_shares_and_caps(spark):
    rows = [(i, "big" if i % 3 else "small", 10 + i % 90, 1.0 if i % 2 else 0.5) for i in range(3000)]
    goal = targets(spark, [("Big ", 3.0, 2), ("small", 1.0, 3), ("absent", 1.0, 1)])
    mixed = mixing.mix(sized(spark, rows), goal)
    out = {r.source: r for r in mixing.shares(mixed, goal).collect()}
    assert abs(out["big"].actual_share - 0.75) < 0.002 and abs(out["small"].actual_share - 0.25) < 0.002
    assert out["big"].most_copies <= 2 and out["small"].most_copies <= 3 and out["absent"].tokens == 0
    assert out["big"].target_share == 0.75 and out["absent"].target_share is None
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(sized(spark, rows).repartition(7), goal).collect()))


def test_within_half_a_document_of_the_tokens_to_give(spark):
    rows = [(i, "a", 7 + i % 5, 1.0) for i in range(500)]
    mixed = mixing.mix(sized(spark, rows), targets(spark, [("a", 1.0, 4)]), total_tokens=6000)
    given = sum(r.copies * r.n_tokens for r in mixed.collect())
    assert abs(given - 6000) <= 6


def test_whole_copies_and_part(spark):
    rows = [(i, "a", 10, 1.0) for i in range(100)]
    copies = [r.copies for r in mixing.mix(sized(spark, rows), targets(spark, [("a", 1.0, 5)]), total_tokens=2300).collect()]
    assert sorted(set(copies)) == [2, 3] and copies.count(3) == 30


def test_inclusion_follows_the_odds(spark):
    rows = [(i, "a", 10, 1.0 if i < 200 else 0.25) for i in range(400)]
    times = [0, 0]
    for seed in range(8):
        for r in mixing.mix(sized(spark, rows), targets(spark, [("a", 1.0, 1)]), total_tokens=1250, seed=seed).collect():
            times[r.doc_id >= 200] += 1
    assert 3.0 < times[0] / times[1] < 5.5 and sum(times) == 8 * 125


def test_solve():
    assert mixing.solve([(1.0, 100), (0.5, 100)], 2, 150) == 1.0
    assert mixing.solve([(1.0, 100), (0.5, 100)], 1, 175) == 1.5
    assert mixing.solve([], 1, 5) == 0.0


def test_documents_without_text_or_source(spark):
    docs = spark.createDataFrame([(1, "one two", "A-b", 5), (2, None, "a_b", 5), (3, "", "a_b", 5), (4, "x", None, 5), (5, "one two", " A_B", 5), (6, "three", "a b", 5)], "doc_id bigint, text string, source string, n_tokens int")
    rows = {r.doc_id: (r.source, r.n_tokens, r.odds) for r in mixing.sized_documents(docs).collect()}
    assert rows == {1: ("a_b", 2, 0.5), 5: ("a_b", 2, 0.5), 6: ("a_b", 1, 1.0)}
    goal = targets(spark, [("a_b", 1.0, 2)])
    assert {r.doc_id: r.copies for r in mixing.mix(mixing.sized_documents(docs), goal).collect()} == {1: 2, 5: 2, 6: 2}
    assert mixing.mix(mixing.sized_documents(docs.limit(0)), goal).count() == 0
    assert mixing.shares(mixing.mix(mixing.sized_documents(docs), goal.limit(0)), goal.limit(0)).count() == 0
