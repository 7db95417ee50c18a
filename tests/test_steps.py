"""The smaller rules, by hand."""

import pytest
from pyspark.sql import functions as F

from evalspark.functions import canon
from evalspark.operators import nested, steps


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_step_ids_and_orders(spark):
    parts = column(spark, ["a:b:1:12", "x:0:y", None], "string", steps.step_parts)
    assert tuple(parts[0]) == ("a:b", "1", 12) and parts[1:] == [None, None]
    df = spark.createDataFrame([(k,) for k in ("10", "9", "x", "2")], "k string")
    assert [r.k for r in df.orderBy(*steps.by_length(F.col("k"))).collect()] == ["2", "9", "x", "10"]
    assert [r.k for r in df.orderBy(*steps.numbers_first(F.col("k"))).collect()] == ["2", "9", "10", "x"]


def test_limit_and_filter_in_both_orders(spark):
    ordered = spark.createDataFrame([(k, i) for i, k in enumerate("abcd")], "k string, o int")
    some = spark.createDataFrame([("b",), ("d",), ("d",)], "k string")
    assert sorted(r.k for r in steps.first_present(ordered, some, "k", "o", 1).collect()) == ["b"]
    assert sorted(r.k for r in steps.pending_first(ordered, some, "k", "o", 2).collect()) == ["a"]


def test_texts(spark):
    prompt = "".join(f"<|im_start|>user\n{t}<|im_end|>\n" for t in ("one", "two", "x" * 700)) + "<|im_start|>assistant\n"
    assert column(spark, [prompt, "", None], "string", steps.tail) == ["user\ntwo\n" + "x" * 600, "", None]
    assert column(spark, ["```json\n{1}\n```", "```x```", "a ```b```", None], "string", steps.without_fence) == ["{1}", "x", "a ```b```", None]
    assert column(spark, ["token_id:7"], "string", steps.token_number) == [7]
    with pytest.raises(Exception, match="is no token_id"):
        column(spark, ["x:7"], "string", steps.token_number)


def test_served_turns(spark):
    said = ["ok <|im_end|>x", '<tool_call>{"name": "f"}</tool_call>', "<tool_call>{bad}</tool_call> !", "  ", None]
    turns = column(spark, said, "string", lambda c: steps.served_turn(canon.parse_completion(F.coalesce(c, F.lit(""))), c, F.lit(False), "too long"))
    assert [t.content for t in turns] == ["ok", None, "<tool_call>{bad}</tool_call> !", "[empty response]", "[empty response]"] and [len(t.calls) for t in turns] == [0, 1, 0, 0, 0]
    assert column(spark, ["x"], "string", lambda c: steps.served_turn(canon.parse_completion(c), c, F.lit(True), "too long"))[0].content == "too long"
    assert column(spark, [True, False], "boolean", lambda c: steps.answered_by(c, F.lit(None))) == ["nobody", "student"]


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([1], [1, 2]), ([], [1]), ([2], [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(steps.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 1, 0, 0]
    assert [r[0] for r in df.select(steps.is_prefix(F.col("a"), F.col("b"))).collect()] == [False, True, True, False]


def test_guards_labels_and_failures(spark):
    rows = spark.createDataFrame([(1, 5, True), (2, 50, True), (3, 5, False)], "k int, n int, ok boolean")
    kept, skipped = steps.length_guard(rows, "n", 10, "ok")
    assert [r.k for r in kept.collect()] == [1] and {r.reason: r.n for r in skipped.collect()} == {"too_long": 1, "token_boundary": 1}
    sheet = spark.createDataFrame([("malformed_output", " malformed_output "), ("x", "malformed_output"), ("x", " ")], "auto_bucket string, human_bucket string")
    assert tuple(steps.label_agreement(sheet).first()) == (2, 1, 0.5, False)
    assert tuple(steps.label_agreement(sheet.limit(0)).first()) == (0, 0, None, False)
    with pytest.raises(Exception, match="unknown bucket"):
        steps.label_agreement(spark.createDataFrame([("x", "odd")], "auto_bucket string, human_bucket string")).collect()
    failed = spark.createDataFrame([(None, f"t{i:02d}") for i in range(11)] + [(1, "a"), (1, "a")], "rep int, task string")
    found = {r.rep: (r.n, r.first, r.more) for r in steps.failures(failed, ["rep"], "task").collect()}
    assert found == {None: (11, ", ".join(f"t{i:02d}" for i in range(8)), 3), 1: (2, "a", 0)}


def test_latest_metrics_and_context(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, None)], "k string, o int, v string")
    assert sorted(map(tuple, steps.latest_by_step(df, "k", "o").collect())) == [("a", 2, "x"), ("b", 1, None)]
    groups = spark.createDataFrame([(0, "g", 1.0, True, False, 0.5), (0, "g", 0.0, False, False, None), (0, "h", 1.0, True, True, None)], "s int, group string, reward double, called boolean, cut boolean, q double")
    row = steps.policy_metrics(groups, ["s"], ["q"]).first()
    assert (row.flat_groups, row.r_q) == (0.5, 0.5) and row.call_rate == pytest.approx(2 / 3)
    prior = spark.createDataFrame([([("f", "{}"), ("g", "{}")],)], "p array<struct<name:string,arguments:string>>")
    assert [len(m.tool_calls) for m in prior.select(steps.rebuilt_context(F.col("p"))).first()[0]] == [1, 1]


def test_catalogs(spark):
    catalog = spark.createDataFrame([("a", 0), ("b", 1)], "name string, ordinal int")
    native = spark.createDataFrame([("b",), ("z",)], "name string")
    assert [r.own for r in steps.in_catalog_order(catalog, native).orderBy("ordinal").collect()] == [False, True]
    assert [r.name for r in steps.missing_native(catalog, native).collect()] == ["z"]


def test_slices_bound_an_index(monkeypatch):
    monkeypatch.setattr(nested, "INDEX_CHARS", 10)
    texts = ["x" * 4, None, "x" * 7, "x" * 30, "", "x"]
    assert [texts[s] for s in nested.slices(texts)] == [["x" * 4, None, "x" * 7], ["x" * 30], ["", "x"]]
